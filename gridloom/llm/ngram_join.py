"""N-gram Jaccard join by MinHash banding.

Texts are sets of runs of five words. Every text gets ``rows`` x ``bands`` minimum hashes; the number
of bands follows from the recall wanted for a pair at the threshold. Texts that share a band's hash
meet in a bucket, and each pair of a bucket is verified on its full sets.

What keeps groups of copies from blowing up: equal word sequences are one vertex with a weight;
buckets with the same members are one bucket; large buckets are cut into blocks and each pair of
blocks is one unit of work, to which the texts' hashed n-gram sets are sent and in which pairs are
counted, not emitted; a pair that meets in several buckets counts in the one with the smallest key. A unit gives each text its number of links and one
edge to a root, so rows grow with the texts, and the components of these edges are the classes.

Cases: texts of fewer than five words are one run; texts without words, null and empty ones included,
stand alone; rows with a null doc_id stand alone with a null class; repeated rows count as copies; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import fresh, join_hot, materialise, raw_words, word_hashes
from gridloom.llm.components import components

N, THRESHOLD, ROWS, RECALL = 5, 0.8, 4, 0.9995
#: Texts in a block of a bucket. A bucket of n texts sends n * n / BLOCK sets; a unit holds 2 * BLOCK at most.
BLOCK = 256
#: A class or text with more than one in so many rows is hot; there are at most that many, so they are broadcast.
HOT_SHARE = 1_024
#: Members from which a unit is verified by matrix products.
MANY = 24
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def bands_for(threshold: float, rows: int, recall: float) -> int:
    """Bands so that a pair at the threshold meets in one of them with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _shuffled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX[3]
    return x ^ (x >> np.uint64(29))


def runs(words: np.ndarray, n: int = N) -> np.ndarray:
    """Hashes of the runs of n words, from hashes of the words; of all words if there are fewer."""
    if len(words) == 0:
        return words
    k = min(n, len(words))
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = _shuffled(out * MIX[1] + words[i : i + len(out)] * MIX[i % 5])
    return out


def signatures(docs: DataFrame, threshold: float, rows: int, recall: float, n: int = N) -> DataFrame:
    """doc_id, _tag (hash of the text), v (hash of the word sequence, null without words), keys (a hash for each band)."""
    bands = bands_for(threshold, rows, recall)
    mult = np.random.default_rng(5).integers(0, 2**63, (bands * rows,), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    words = docs.select("doc_id", F.xxhash64("text").alias("_tag"), F.col("text").alias("_x"), raw_words(F.col("text")).alias("_w"))
    hashed = words.select("doc_id", "_tag", F.coalesce(word_hashes(F.col("_x"), F.col("_w")), F.array().cast("array<long>")).alias("_h"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            col = batch.column("_h")
            flat = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            off = col.offsets.to_numpy() - col.offsets[0].as_py()
            v, keys, lo, m = [None] * batch.num_rows, [None] * batch.num_rows, 0, batch.num_rows
            while lo < m:
                hi, sets = lo, []
                size = 0
                while hi < m and (hi == lo or size < 200_000):
                    w = flat[off[hi] : off[hi + 1]]
                    sets.append(runs(w, n))
                    if len(w):
                        v[hi] = hashlib.blake2b(w.tobytes(), digest_size=16).digest()
                    size, hi = size + len(w), hi + 1
                full = [i for i, s in enumerate(sets) if len(s)]
                if full:
                    every = np.concatenate([sets[i] for i in full])
                    starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                    least = np.stack([np.minimum.reduceat(every * a, starts) for a in mult], axis=1)
                    for b in range(bands):
                        key = np.full(len(full), b + 1, np.uint64)
                        for r in range(rows):
                            key = _shuffled(key * MIX[2] + least[:, b * rows + r])
                        least[:, b] = key  # columns up to b have been used
                    for j, i in enumerate(full):
                        keys[lo + i] = least[j, :bands].view(np.int64)
                lo = hi
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("_tag"), pa.array(v, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "_tag", "v", "keys"]
            )

    return hashed.mapInArrow(run, hashed.select("doc_id", "_tag", F.lit(None).cast("binary").alias("v"), F.lit(None).cast("array<long>").alias("keys")).schema)


def gram_sets(texts: DataFrame) -> DataFrame:
    """``grams`` (sorted different hashes of the runs of words) instead of ``text``."""
    keep = [c for c in texts.columns if c != "text"]
    words = texts.select(*keep, F.col("text").alias("_x"), raw_words(F.col("text")).alias("_w"))
    hashed = words.select(*keep, F.coalesce(word_hashes(F.col("_x"), F.col("_w")), F.array().cast("array<long>")).alias("_h"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            sets = [np.unique(runs(w)) for w in _arrays(batch.column("_h"))]
            off = np.cumsum([0] + [len(x) for x in sets]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], [*keep, "grams"]
            )

    return hashed.mapInArrow(run, hashed.select(*keep, F.col("_h").alias("grams")).schema)


def _arrays(col: pa.ListArray) -> list[np.ndarray]:
    flat, off = col.flatten().to_numpy(zero_copy_only=False).view(np.uint64), col.offsets.to_numpy()
    return [flat[a - off[0] : b - off[0]] for a, b in zip(off[:-1], off[1:], strict=True)]


class Unit:
    """Texts of one pair of blocks of a bucket."""

    def __init__(self, key: int, low: int, high: int):
        self.key, self.low, self.high = key, low, high
        self.v: list[bytes] = []
        self.size: list[int] = []
        self.block: list[int] = []
        self.earlier: list[frozenset] = []
        self.sets: list[np.ndarray] = []

    def add(self, v: bytes, size: int, block: int, keys: list[int], grams: np.ndarray) -> None:
        self.v.append(v)
        self.size.append(size)
        self.block.append(block)
        self.earlier.append(frozenset(k for k in keys if k < self.key))
        self.sets.append(grams)

    def wanted(self) -> np.ndarray:
        """Pairs to verify here: across the two blocks, or within one; not met in an earlier bucket."""
        m = len(self.v)
        b = np.array(self.block)
        out = np.triu(np.ones((m, m), bool), 1)
        if self.low != self.high:
            out &= b[:, None] != b[None, :]
        names = {k: i for i, k in enumerate(sorted(set().union(*self.earlier)))}
        if names:
            inc = np.zeros((m, len(names)), np.float32)
            for i, ks in enumerate(self.earlier):
                inc[i, [names[k] for k in ks]] = 1
            out &= (inc @ inc.T) == 0
        return out

    def common(self) -> np.ndarray:
        """Sizes of all intersections, by products of 0/1 matrices over the runs that two texts share."""
        m = len(self.v)
        of = np.repeat(np.arange(m), [len(s) for s in self.sets])
        _, at, times = np.unique(np.concatenate(self.sets), return_inverse=True, return_counts=True)
        keep = times[at] > 1
        number = np.cumsum(times > 1) - 1
        of, at = of[keep], number[at[keep]]
        out = np.zeros((m, m), np.float32)
        order = np.argsort(at, kind="stable")
        of, at = of[order], at[order]
        width = 4096
        for lo in range(0, int(at[-1]) + 1 if len(at) else 0, width):
            a, b = np.searchsorted(at, [lo, lo + width])
            inc = np.zeros((m, width), np.float32)
            inc[of[a:b], at[a:b] - lo] = 1
            out += inc @ inc.T
        return out

    def links(self, threshold: float) -> Iterator[tuple[bytes, int, bytes]]:
        """(v, linked rows, root) of each text with links."""
        m = len(self.v)
        if m < 2:
            return
        n = np.array([len(s) for s in self.sets], float)
        want = self.wanted()
        # a / (x + y - a) >= t, written without a division
        enough = lambda inter, x, y: inter * (1 + threshold) + 1e-9 >= threshold * (x + y)
        if m > MANY:
            good = want & enough(self.common(), n[:, None], n[None, :])
        else:
            good = np.zeros((m, m), bool)
            for i, j in zip(*np.nonzero(want), strict=True):
                if min(n[i], n[j]) >= threshold * max(n[i], n[j]):
                    good[i, j] = enough(len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)), n[i], n[j])
        if not good.any():
            return
        good |= good.T
        count = good @ np.array(self.size)
        root = np.arange(m)
        while True:  # the least index in reach, spread until it stays
            new = np.minimum(root, np.where(good, root[None, :], m).min(axis=1))
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        for i in np.flatnonzero(good.any(axis=1)):
            yield self.v[i], int(count[i]), self.v[root[i]]


def verified(units: DataFrame, threshold: float) -> DataFrame:
    """v, links, root from rows (key, low, high, block, v, size, keys, grams) sorted by unit."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, out = None, []
        for batch in it:
            cols = [batch.column(c).to_pylist() for c in ("key", "low", "high", "block", "v", "size", "keys")]
            for key, low, high, block, v, size, keys, grams in zip(*cols, _arrays(batch.column("grams")), strict=True):
                if unit is None or (unit.key, unit.low, unit.high) != (key, low, high):
                    if unit:
                        out += unit.links(threshold)
                    unit = Unit(key, low, high)
                unit.add(v, size, block, keys, grams)
            if len(out) > 10_000:
                yield _batch(out)
                out = []
        if unit:
            out += unit.links(threshold)
        yield _batch(out)

    return units.mapInArrow(run, "v binary, links long, root binary")


def _batch(rows: list) -> pa.RecordBatch:
    v, n, r = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(v, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.binary())], ["v", "links", "root"])


def classes(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, _tag, v) and texts (v, copy_id, class_id, n_links, _keep, size); ``_keep`` is the least
    (doc_id, _tag) of the class, which also tells texts of one id apart."""
    sig = materialise(signatures(docs, threshold, rows, recall), "signatures")
    held = sig.filter("v IS NOT NULL AND doc_id IS NOT NULL")
    reps = held.groupBy("v").agg(F.min(F.struct("doc_id", "_tag")).alias("rep"), F.count("*").alias("size"), F.min("keys").alias("keys"))
    reps = materialise(reps, "texts")
    each = reps.select("v", F.explode("keys").alias("key"))
    h = F.xxhash64("v")
    bucket = each.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.bit_xor(F.xxhash64(h, F.lit(1))).alias("y"))
    bucket = materialise(bucket.filter("n > 1").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key", "n"), "buckets")
    limit = max((reps.agg(F.sum(F.size("keys"))).first()[0] or 0) // HOT_SHARE, 1)
    member = join_hot(each, bucket, ["key"], F.col("n") > limit)
    per = member.groupBy("v").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("_b"))  # one for each band at most
    need = per.join(reps.select("v", "rep.doc_id", "rep._tag", "size"), "v").select("v", "doc_id", "_tag", "size", "_b")
    once = docs.filter("doc_id IS NOT NULL").select("doc_id", F.xxhash64("text").alias("_tag"), "text").dropDuplicates(["doc_id", "_tag"])
    text = once.join(need, ["doc_id", "_tag"])
    blocks = F.ceil(F.col("_n") / BLOCK).cast("int")
    cut = gram_sets(text).select("v", "size", "grams", F.transform("_b", lambda b: b["key"]).alias("keys"), F.inline("_b").alias("key", "_n"))
    cut = cut.select("*", F.pmod(h, blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_o"))
    units = cut.select("key", F.least("block", "_o").alias("low"), F.greatest("block", "_o").alias("high"), "block", "v", "size", "keys", "grams")
    dealt = units.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    found = materialise(verified(dealt, threshold), "links")

    roots = components(found.select(F.col("v").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("v").agg(F.sum("links").alias("_l"))
    known = reps.select("v", "rep", "size").join(links, "v", "left").join(roots, "v", "left")
    known = known.select("v", "rep", "size", (F.coalesce("_l", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("root", "v").alias("root"))
    known = materialise(known, "known")
    least = known.groupBy("root").agg(F.min("rep").alias("_keep"), F.count("*").alias("_n"))
    limit = max(known.count() // HOT_SHARE, 1)
    by_text = join_hot(known, least, ["root"], F.col("_n") > limit)
    by_text = by_text.select("v", F.col("rep.doc_id").alias("copy_id"), F.col("_keep.doc_id").alias("class_id"), "n_links", "_keep", "size")
    return sig.select("doc_id", "_tag", "v"), materialise(by_text, "classes")


def _of_text(rows: DataFrame, by_text: DataFrame) -> DataFrame:
    """Rows with the columns of their text."""
    limit = max((by_text.agg(F.sum("size")).first()[0] or 0) // HOT_SHARE, 1)
    return join_hot(rows, by_text, ["v"], F.col("size") > limit)


def near_copies(docs: DataFrame, threshold: float = THRESHOLD, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs``: doc_id, copy_id (least id with the same words), class_id (least id
    of the component), n_links (other rows with a similarity of at least the threshold)."""
    ids, by_text = classes(docs, threshold, rows, recall)
    linked = _of_text(ids.filter("v IS NOT NULL AND doc_id IS NOT NULL"), by_text).select("doc_id", "copy_id", "class_id", "n_links")
    alone = ids.filter("v IS NULL OR doc_id IS NULL")
    return linked.unionAll(alone.select("doc_id", "doc_id", "doc_id", F.lit(0).cast("long")))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """One document of each class: that with the smallest id, of several texts of this id that with the
    smallest hash; repeated rows become one. Rows that stand alone stay as they are."""
    ids, by_text = classes(docs, **options)
    d, t, flag, tag, nth = fresh(docs, "d", "t", "kept", "tag", "nth")
    held = ids.filter("v IS NOT NULL AND doc_id IS NOT NULL")
    texts = held.groupBy("doc_id", "_tag").agg(F.min("v").alias("v"), F.count("*").alias("_n"))
    per = _of_text(texts, by_text)
    kept = F.col("_keep") == F.struct("doc_id", "_tag")
    per = per.filter(~kept | (F.col("_n") > 1)).select(F.col("doc_id").alias(d), F.col("_tag").alias(t), kept.alias(flag))
    # documents are shuffled once, at every size alike: rows that aren't named stay, of kept repeats the first
    named = docs.filter("doc_id IS NOT NULL").withColumn(tag, F.xxhash64("text"))
    both = named.join(materialise(per, "gone").hint("merge"), (F.col("doc_id") == F.col(d)) & (F.col(tag) == F.col(t)), "left")
    first = F.row_number().over(Window.partitionBy("doc_id", tag).orderBy(tag)) == 1
    held = both.withColumn(nth, first).filter(F.col(flag).isNull() | F.col(flag) & F.col(nth))
    held = held.select(*[F.col(f"`{c}`") for c in docs.columns])
    return held.unionAll(docs.filter("doc_id IS NULL"))  # they are told apart by nothing, so all stay and none is shuffled


ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
t AS (SELECT array_to_string(w, ' ') AS t, any_value(w) AS w, min(doc_id) AS rep, count(*) AS size FROM w WHERE len(w) > 0 GROUP BY 1),
s AS (SELECT DISTINCT rep, array_to_string(w[p:p + 4], ' ') AS g
    FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM t)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rep AS a, b.rep AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE k * 1.8 + 1e-9 >= 0.8 * (x.n + y.n)),
sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT rep AS v, rep AS r FROM t UNION SELECT sym.b, reach.r FROM reach JOIN sym ON sym.a = reach.v),
cl AS (SELECT v, min(r) AS class_id FROM reach GROUP BY 1),
l AS (SELECT sym.a AS v, sum(t.size) AS l FROM sym JOIN t ON t.rep = sym.b GROUP BY 1)
SELECT w.doc_id, coalesce(t.rep, w.doc_id) AS copy_id, coalesce(class_id, w.doc_id) AS class_id,
    cast(coalesce(l, 0) + coalesce(size - 1, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN t ON len(w.w) > 0 AND t.t = array_to_string(w.w, ' ') LEFT JOIN cl ON cl.v = t.rep LEFT JOIN l ON l.v = t.rep
"""
