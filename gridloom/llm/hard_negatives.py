"""Exact hard-negative mining over blocks of vectors in Hilbert order, chosen by interval arithmetic.

``write_blocks`` scales vectors to integers and stores them as Parquet, ordered by label and then along a
Hilbert curve through the dimensions of largest variance (Skilling's transform), ``ROWS`` to a block. A block's
row holds its matrix beside a zone map: the least and greatest value in each dimension, and of the labels.

Anchors, in the same order, are grouped in packs of ``PACK``. For a pack and a group of zone maps two matrix
products bound every anchor's scores in every block from below and above. Four passes choose and read:

1. positives, seeds: the ``SEEDS`` blocks with the highest upper bounds give each anchor a score that is
   reached as often as positives are asked for;
2. positives: every block whose upper bound is not below that score;
3. negatives, seeds: the blocks whose bounds lie closest around the top of each window;
4. negatives: every block whose interval meets a window at or above the score that the seeds reach.

Blocks that are chosen are shuffled to (pack, strip), a strip being a run of blocks, where exact integer products
are cut to the first few per anchor or window with the bar rising on the way; a rank over strips follows.
No block is left out unless its bounds say so, so results are exact at any size. Where vectors have no
structure the bounds choose nearly all blocks, and the work is a product of all anchors with all rows, in tiles.

Cases: rows without a label or vector, or with a null or non-finite component, take no part; vectors of unequal
length end in zeros; scaled components stop at 2**26 in size, so scores of 2,000 dimensions fit a long; equal rows
(id, label, scaled vector) count once, rows that share only an id are different rows; null ids come last among
equal scores and are no anchors; a table without rows or anchors gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import scratch

#: Rows of a block, anchors of a pack, zone maps of a group; bits a dimension and dimensions of the curve.
ROWS, PACK, ZONES = 512, 1_024, 512
BITS, CURVE_DIMS = 2, 64
#: Blocks that an anchor (or one of its windows) reads to get a bar, of each group of zone maps.
SEEDS = 2
#: Blocks in a strip: as many as give about 64 strips, but no more than this.
STRIPS, STRIP_BLOCKS = 64, 256
#: Scaled components are held within this.
MOST = 1 << 26
LAST = (1 << 63) - 1
NEVER = -(1 << 62)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Places on a Hilbert curve, as rows of bytes, of points with ``bits`` bits a dimension."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    planes = [(x[i] >> b) & 1 for b in reversed(range(bits)) for i in range(n)]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def scaled(vectors: DataFrame, anchor: Column, label: Column | str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """vec_id, label, comps (integers), anchor of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    label = F.col(label) if isinstance(label, str) else label
    held = lambda x: F.greatest(F.least(x.cast("double") * scale, F.lit(float(MOST))), F.lit(float(-MOST)))
    rows = vectors.select("vec_id", label.cast("long").alias("label"), F.col(vector).alias("_v"), F.coalesce(anchor, F.lit(False)).alias("anchor"), bad.alias("_bad"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("_v").isNotNull() & ~F.coalesce("_bad", F.lit(False)))
    comps = F.transform("_v", lambda x: F.floor(held(x)).cast("int"))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "label", comps.alias("comps"), (F.col("anchor") & F.col("vec_id").isNotNull()).alias("anchor"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of one width, zeros behind short ones."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _moments(rows: DataFrame) -> list[tuple[float, float, float, float]]:
    """(mean, deviation, least, most) of each dimension; collects a row for each dimension."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lists = b.column("comps")
            width = max(lists.value_lengths().to_numpy(zero_copy_only=False), default=0)
            m = _matrix(lists, int(width)).astype(float)
            if len(m):
                cols = [np.arange(width), np.full(width, len(m)), m.sum(0), (m * m).sum(0), m.min(0), m.max(0)]
                kinds = [pa.int32(), pa.int64(), *[pa.float64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(cols, kinds, strict=True)], ["dim", "n", "s", "ss", "lo", "hi"])

    parts = rows.select("comps").mapInArrow(run, "dim int, n long, s double, ss double, lo double, hi double")
    found = parts.groupBy("dim").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
    out = []
    for r in sorted(found, key=lambda r: r["dim"]):
        mean = r["s"] / r["n"]
        out.append((mean, max(r["ss"] / r["n"] - mean * mean, 0.0) ** 0.5, r["lo"], r["hi"]))
    return out


BLOCK = (
    "part int, seq long, n int, label_lo long, label_hi long, n_anchors int, least binary, most binary,"
    " ids array<long>, labels array<long>, anchors array<boolean>, matrix binary"
)


def write_blocks(rows: DataFrame, path: str, rows_of_block: int = ROWS) -> int:
    """Write ``scaled`` rows as blocks below ``path``; returns the number of dimensions."""
    moments = _moments(rows)
    width = len(moments)
    spread = np.array([m[1] for m in moments])
    dims = np.sort(np.argsort(-spread, kind="stable")[:CURVE_DIMS])
    dims = dims[np.argsort(-spread[dims], kind="stable")]
    middle, scale = np.array([moments[d][0] for d in dims]), np.array([moments[d][1] or 1.0 for d in dims])
    top = (1 << BITS) - 1

    def keyed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            m = _matrix(b.column("comps"), width)
            cells = np.clip(np.floor((m[:, dims] - middle) / scale) + (top + 1) // 2, 0, top)
            keys = hilbert_keys(cells, BITS) if len(dims) else np.zeros((len(m), 1), np.uint8)
            vecs = m.astype("<i4")
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), b.column("label"), b.column("anchor"), pa.array([k.tobytes() for k in keys], pa.binary()), pa.array([v.tobytes() for v in vecs], pa.binary())],
                ["vec_id", "label", "anchor", "key", "vec"],
            )

    order = ["label", "key", "vec_id"]
    flat = rows.mapInArrow(keyed, "vec_id long, label long, anchor boolean, key binary, vec binary").distinct()
    dealt = flat.repartitionByRange(*order).sortWithinPartitions(*order, "vec")
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary()]
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, n_held = TaskContext.get().partitionId(), 0, [], 0

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal seq
            m = np.frombuffer(b"".join(t.column("vec").to_pylist()), "<i4").reshape(len(t), width)
            labels = t.column("label").to_pylist()
            lo, hi = (m.min(0), m.max(0)) if width else (m[0], m[0])
            row = (part, seq, len(t), min(labels), max(labels), sum(t.column("anchor").to_pylist()), lo.tobytes(), hi.tobytes(), t.column("vec_id").to_pylist(), labels, t.column("anchor").to_pylist(), m.tobytes())
            seq += 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for b in it:
            held.append(b)
            n_held += len(b)
            if n_held >= rows_of_block:
                t = pa.Table.from_batches(held)
                stop = n_held - n_held % rows_of_block
                yield from (block(t.slice(lo, rows_of_block)) for lo in range(0, stop, rows_of_block))
                t = t.slice(stop)
                held, n_held = t.to_batches(), len(t)
        if n_held:
            yield block(pa.Table.from_batches(held))

    dealt.mapInArrow(cut, BLOCK).write.parquet(path)
    return width


class Store:
    """Written blocks with their zone maps and packs of anchors."""

    def __init__(self, spark: SparkSession, path: str, width: int, pack: int = PACK):
        self.spark, self.width, self.path = spark, width, path
        stored = spark.read.schema(BLOCK).parquet(path)
        zones = stored.select("part", "seq", "label_lo", "label_hi", "n_anchors", "least", "most")
        # a row for each written part is ranked in one task, then blocks within their part
        per = zones.groupBy("part").agg(F.count("*").alias("_b"), F.sum("n_anchors").alias("_a"))
        w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        per = per.select("part", F.coalesce(F.sum("_b").over(w), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_a").over(w), F.lit(0)).alias("_a0"))
        size = zones.agg(F.count("*").alias("b"), F.coalesce(F.sum("n_anchors"), F.lit(0)).alias("a")).first()
        self.blocks, self.anchors = int(size["b"]), int(size["a"])
        self.n_packs = -(-self.anchors // pack)
        strip = min(max(self.blocks // STRIPS, 1), STRIP_BLOCKS)
        before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
        placed = zones.select("part", "seq", "n_anchors", F.coalesce(F.sum("n_anchors").over(before), F.lit(0)).alias("_a1")).join(per, "part")
        placed = placed.select("part", "seq", (F.col("_b0") + F.col("seq")).alias("block"), (F.col("_a0") + F.col("_a1")).alias("first"))
        self.at = self._write(placed.withColumn("strip", F.floor(F.col("block") / strip).cast("long")), "at")
        self.data = stored
        self.zones = self._zone_groups(zones)
        self.packs = self._packs(pack)

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}-{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}-{name}")

    def _zone_groups(self, zones: DataFrame) -> DataFrame:
        """Zone maps by groups of ``ZONES`` blocks, one row each."""
        z = zones.join(self.at, ["part", "seq"]).select(F.floor(F.col("block") / ZONES).cast("long").alias("zone"), F.struct("block", "strip", "label_lo", "label_hi", "least", "most").alias("z"))
        return self._write(z.groupBy("zone").agg(F.array_sort(F.collect_list("z")).alias("zones")), "zones")

    def _packs(self, pack: int) -> DataFrame:
        """Anchors by packs, one row each: their ids, labels, rows (block and place) and matrix."""
        rows = self.data.filter("n_anchors > 0").join(self.at, ["part", "seq"]).select("block", "first", "ids", "labels", "anchors", "matrix")
        width = self.width

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                for r in b.to_pylist():
                    at = np.flatnonzero(r["anchors"])
                    m = np.frombuffer(r["matrix"], "<i4").reshape(len(r["ids"]), width)
                    no = r["first"] + np.arange(len(at))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(no // pack, pa.int64()), pa.array(no % pack, pa.int32()), pa.array([r["ids"][i] for i in at], pa.int64()),
                        pa.array([r["labels"][i] for i in at], pa.int64()), pa.array(r["block"] * ROW_BASE + at, pa.int64()), pa.array([m[i].tobytes() for i in at], pa.binary()),
                    ], ["pack", "pos", "id", "label", "row", "vec"])

        each = rows.mapInArrow(run, "pack long, pos int, id long, label long, row long, vec binary")
        one = F.struct("pos", "id", "label", "row", "vec")
        return self._write(each.groupBy("pack").agg(F.array_sort(F.collect_list(one)).alias("members")), "packs")


#: Rows are numbered block * ROW_BASE + place.
ROW_BASE = 1 << 20


class _Pack:
    """A pack as arrays; ``wins`` are (position, low, high, bar) of what is looked for."""

    def __init__(self, members: list[dict], wins: list[dict], width: int):
        self.ids = [m["id"] for m in members]
        self.labels = np.array([m["label"] for m in members], np.int64)
        self.rows = np.array([m["row"] for m in members], np.int64)
        self.v = np.frombuffer(b"".join(m["vec"] for m in members), "<i4").reshape(len(members), width).astype(np.float64)
        self.pos, self.low, self.high, self.bar = (np.array([w[k] for w in wins], np.int64) for k in ("pos", "low", "high", "bar"))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of rows; by floating point where it holds all sums exactly."""
    most = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


WINS = "pack long, wins array<struct<pos:int,low:long,high:long,bar:long>>"


def choose(store: Store, wins: DataFrame, same: bool, seeds: int | None) -> DataFrame:
    """(pack, strip, block, picked): for what is looked for (``wins``), the blocks that have to be read. ``same``:
    among rows of the anchor's label, else of others. With ``seeds`` only the most promising ones."""
    width = store.width
    many = store.zones.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(store.n_packs - 1)).cast("array<long>")))
    both = many.join(wins.join(store.packs, "pack"), "pack")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for r in batch.to_pylist():
                p, z = _Pack(r["members"], r["wins"], width), r["zones"]
                lo, hi = (np.frombuffer(b"".join(x[k] for x in z), "<i4").reshape(len(z), width).astype(np.float64) for k in ("least", "most"))
                up, down = np.maximum(p.v, 0), np.minimum(p.v, 0)
                above, below = _product(up, hi) + _product(down, lo), _product(up, lo) + _product(down, hi)
                first, last = np.array([x["label_lo"] for x in z]), np.array([x["label_hi"] for x in z])
                own = p.labels[:, None]
                fits = (first <= own) & (own <= last) if same else (first != own) | (last != own)
                above, below, fits = above[p.pos], below[p.pos], fits[p.pos]
                fits &= (below <= p.high[:, None]) & (above >= np.maximum(p.low, p.bar)[:, None])
                if seeds is not None:
                    far = -above if same else np.abs((above + below) // 2 - p.high[:, None])
                    far = np.where(fits, far, LAST)
                    k = min(seeds, len(z)) - 1
                    fits &= far <= np.partition(far, k, axis=1)[:, k : k + 1]
                at = np.flatnonzero(fits.any(axis=0))
                if len(at):
                    yield pa.RecordBatch.from_arrays([
                        pa.array([r["pack"]] * len(at), pa.int64()), pa.array([z[j]["strip"] for j in at], pa.int64()), pa.array([z[j]["block"] for j in at], pa.int64()),
                        pa.array([np.packbits(fits[:, j]).tobytes() for j in at], pa.binary()),
                    ], ["pack", "strip", "block", "picked"])

    return both.mapInArrow(run, "pack long, strip long, block long, picked binary")


FOUND = "pack long, win int, anchor_row long, anchor_id long, other_id long, score long"


def read(store: Store, wins: DataFrame, choice: DataFrame, same: bool, k: int) -> DataFrame:
    """For each of ``wins`` and strip the first ``k`` rows found in the chosen blocks."""
    width = store.width
    packed = store.packs.join(wins, "pack")
    left = choice.select("pack", "strip").distinct().join(packed, "pack")
    blocks = store.data.join(store.at, ["part", "seq"]).select("block", "ids", "labels", "matrix")
    right = choice.join(blocks, "block").select(F.col("pack").alias("to_pack"), F.col("strip").alias("of_strip"), "block", "picked", "ids", "labels", "matrix")

    def run(key: tuple, mine: pa.Table, theirs: pa.Table) -> pa.Table:
        (unit,) = mine.to_pylist()
        p = _Pack(unit["members"], unit["wins"], width)
        bar = np.maximum(p.low, p.bar)
        best = [np.zeros(0, np.int64) for _ in range(3)]  # window, score, id (LAST if null)
        for j in np.argsort(theirs.column("block").to_numpy()):
            r = {c: theirs.column(c)[int(j)].as_py() for c in ("block", "picked", "ids", "labels", "matrix")}
            who = np.flatnonzero(np.unpackbits(np.frombuffer(r["picked"], np.uint8), count=len(p.pos)))
            m = np.frombuffer(r["matrix"], "<i4").reshape(len(r["ids"]), width).astype(np.float64)
            used, back = np.unique(p.pos[who], return_inverse=True)
            score = _product(p.v[used], m)
            fits = p.labels[used][:, None] == np.array(r["labels"], np.int64)
            if same:
                fits &= p.rows[used][:, None] != r["block"] * ROW_BASE + np.arange(len(m))
            else:
                fits = ~fits
            score = np.where(fits, score, NEVER)[back]
            score[(score > p.high[who][:, None]) | (score < bar[who][:, None])] = NEVER
            if len(m) > k:  # of each window all scores that reach its k-th highest
                least = np.partition(score, len(m) - k, axis=1)[:, len(m) - k]
                score[score < least[:, None]] = NEVER
            row, at = np.nonzero(score > NEVER)
            ids = np.array([LAST if i is None else i for i in r["ids"]], np.int64)
            best = [np.concatenate(c) for c in zip(best, (who[row], score[row, at], ids[at]), strict=True)]
            order = np.lexsort((best[2], -best[1], best[0]))
            best = [c[order] for c in best]
            start = np.searchsorted(best[0], best[0])
            nth = np.arange(len(start)) - start
            full = nth == k - 1
            bar[best[0][full]] = np.maximum(bar[best[0][full]], best[1][full])
            best = [c[nth < k] for c in best]
        win, score, ids = best
        pos = p.pos[win]
        return pa.table({
            "pack": pa.array(np.full(len(win), unit["pack"]), pa.int64()), "win": pa.array(win, pa.int32()), "anchor_row": pa.array(p.rows[pos], pa.int64()),
            "anchor_id": pa.array([p.ids[i] for i in pos], pa.int64()), "other_id": pa.array(ids, pa.int64(), mask=ids == LAST), "score": pa.array(score, pa.int64()),
        })

    units = left.groupBy("pack", "strip").cogroup(right.groupBy("to_pack", "of_strip"))
    return units.applyInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each window, with their rank."""
    w = Window.partitionBy("pack", "win").orderBy(F.desc("score"), F.asc_nulls_last("other_id"))
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _with_bars(wins: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``wins`` with the score of the k-th row as the bar, where there are as many."""
    reached = _first(found, k).filter(F.col("rank") == k).groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct("win", "score"))).alias("_m"))
    met = wins.join(reached, "pack", "left")
    bar = lambda w, i: F.coalesce(F.element_at("_m", i.cast("int")), w["bar"])
    up = F.transform("wins", lambda w, i: F.struct(w["pos"].alias("pos"), w["low"].alias("low"), w["high"].alias("high"), bar(w, i).alias("bar")))
    return met.select("pack", F.when(F.col("_m").isNull(), F.col("wins")).otherwise(up).alias("wins"))


def mine(
    vectors: DataFrame, anchor: Column, label: Column | str = "label", vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 10,
    low: int = 30, high: int = 90, rows_of_block: int = ROWS, pack: int = PACK, step: Callable[[DataFrame, str], None] | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each row that ``anchor`` names and
    each of its first ``positives`` other rows of one label, the first ``negatives`` rows of other labels that score
    from ``low`` to ``high`` percent of the positive. ``step`` is shown each table of choices, for tests."""
    spark = vectors.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    path = scratch(spark, "vectors")
    width = write_blocks(scaled(vectors, anchor, label, vector, scale), path, rows_of_block)
    store = Store(spark, path, width, pack)
    if not store.anchors:
        return empty

    def passes(name: str, wins: DataFrame, same: bool, k: int) -> DataFrame:
        wins = store._write(wins, f"{name}-wins")
        for seeds in (SEEDS, None):
            choice = store._write(choose(store, wins, same, seeds), f"{name}-{seeds}-choice")
            if step:
                step(choice, f"{name}-{seeds}")
            found = store._write(read(store, wins, choice, same, k), f"{name}-{seeds}-found")
            if seeds:
                wins = store._write(_with_bars(wins, found, k), f"{name}-bars")
        return _first(found, k)

    whole = F.transform("members", lambda m, i: F.struct(m["pos"].alias("pos"), F.lit(NEVER + 1).alias("low"), F.lit(LAST).alias("high"), F.lit(NEVER + 1).alias("bar")))
    found = passes("positives", store.packs.select("pack", whole.alias("wins")), True, positives)
    # the place of an anchor in its pack is its window here; a window of negatives is shared by positives of equal score
    found = store._write(found.select("pack", F.col("win").alias("pos"), "anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), F.col("rank").alias("_p")), "positives")
    bounds = found.filter("positive_score >= 0").select("pack", "pos", "positive_score").distinct()
    bounds = bounds.withColumn("low", F.expr(f"({low} * positive_score + 99) div 100")).withColumn("high", F.expr(f"({high} * positive_score) div 100")).filter("low <= high")
    w = Window.partitionBy("pack").orderBy("pos", "positive_score")
    bounds = store._write(bounds.withColumn("win", (F.row_number().over(w) - 1).cast("int")), "windows")
    one = F.struct("win", "pos", "low", "high", F.lit(NEVER + 1).alias("bar"))
    wins = bounds.groupBy("pack").agg(F.array_sort(F.collect_list(one)).alias("wins"))
    wins = wins.select("pack", F.transform("wins", lambda x: F.struct(*[x[c].alias(c) for c in ("pos", "low", "high", "bar")])).alias("wins"))
    last = passes("negatives", wins, False, negatives).select("pack", "win", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    out = found.join(bounds.select("pack", "pos", "positive_score", "win"), ["pack", "pos", "positive_score"]).join(last, ["pack", "win"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def digest(embeddings: DataFrame) -> DataFrame:
    """The registered query: labels moved where the id is divisible by 7, anchors where it is by 100."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return mine(embeddings, F.col("vec_id") % 100 == 0, moved)


ORACLE = """
WITH f AS (SELECT * FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM f),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
    FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (SELECT anchor_id, positive_id, positive_score, other_id AS negative_id, score AS negative_score,
    row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
