"""Toxicity by a convolutional text classifier, trained in numpy on shards of all labelled texts.

A word's vector is the sum of two hashed embeddings, one of the word and one of its first letters.
Filters one, two and three words wide slide over the vectors, each keeps its maximum over the whole
text, and a logistic unit weighs the maxima. Embeddings start from shrunken log odds of their bucket
in the labelled texts, counted by Spark, and are trained on with everything else: each shard of labelled texts takes
its passes from the same weights, and the shards' weights are averaged, an embedding's over the shards that met it.
A threshold is calibrated for each language on labelled rows that the net wasn't fitted on; it decides the extra column ``flagged`` and
never the score.

Cases: null and empty texts get the score of a text without words; repeated rows each get a result
row; with labels of one class only the score is their share, without labels 0.5; without a column
``lang``, or for a language without both classes among the calibration rows, the threshold is 0.5;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import NOT_WORD, materialise
from gridloom.llm.labelled import remainder

BUCKETS = 1 << 15
PREFIX = 4
WIDTHS = (1, 2, 3)
#: The part of the labelled documents that calibrates the thresholds, one in so many, and the steps of its scores from 0 to 1.
CALIBRATE, STEPS = 5, 10_000
#: Texts and words of a shard, about; rounds after which the weights of several shards are averaged.
SHARD_TEXTS, SHARD_WORDS, ROUNDS = 4_096, 1 << 23, 2
PAD = 2 * BUCKETS


@dataclass
class Model:
    dim: int = 8
    filters: int = 6
    emb: np.ndarray = field(default=None)
    conv: np.ndarray = field(default=None)  # dim x (sum of widths * filters), by width, offset, filter
    bias: np.ndarray = field(default=None)
    out: np.ndarray = field(default=None)
    out_bias: float = 0.0
    thresholds: dict = field(default_factory=dict)

    def columns(self) -> list[list[slice]]:
        at, cols = 0, []
        for w in WIDTHS:
            cols.append([slice(at + o * self.filters, at + (o + 1) * self.filters) for o in range(w)])
            at += w * self.filters
        return cols

    def maps(self, word: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        """Filter outputs at each position; the last rows must be padding."""
        y = (self.emb[word] + self.emb[prefix]) @ self.conv
        n = len(word)
        out = np.zeros((n, len(WIDTHS) * self.filters), np.float32)
        for i, cols in enumerate(self.columns()):
            f = slice(i * self.filters, (i + 1) * self.filters)
            for o, c in enumerate(cols):
                out[: n - o, f] += y[o:, c]
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias


def ids(df: DataFrame, *keep: str) -> DataFrame:
    """``_word`` and ``_prefix``: bucket ids of the words of a text."""
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), NOT_WORD, -1), "").alias("_w")
    bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")
    return df.select(*keep, words).select(
        *keep, F.transform("_w", bucket).alias("_word"),
        F.transform("_w", lambda w: bucket(F.substring(w, 1, PREFIX)) + BUCKETS).alias("_prefix"),
    )


def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows one after the other with padding behind each, and where they start."""
    pad = np.full(max(WIDTHS), PAD, np.int32)
    parts = [x for r in rows for x in (r, pad)]
    starts = np.cumsum([0] + [len(r) + len(pad) for r in rows[:-1]])
    return np.concatenate(parts), starts


def start(n: int, ones: int, seen: np.ndarray, seed: int = 11) -> Model:
    """The weights that training starts from: ``n`` texts, ``ones`` of them toxic, and how many texts of each label
    have a bucket."""
    rng = np.random.default_rng(seed)
    m = Model()
    k = sum(WIDTHS) * m.filters
    m.emb = np.zeros((2 * BUCKETS + 1, m.dim), np.float32)
    share = ones / n if n else 0.5
    m.conv = rng.normal(0, 0.2, (m.dim, k)).astype(np.float32)
    m.bias = np.zeros(len(WIDTHS) * m.filters, np.float32)
    m.out = np.zeros(len(WIDTHS) * m.filters, np.float32)
    m.out_bias = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if share in (0.0, 1.0) or n == 0:
        return m
    seen = np.zeros((2, 2 * BUCKETS + 1))
    p1, p0 = (seen[1] + 4 * share) / (ones + 4), (seen[0] + 4 * (1 - share)) / (n - ones + 4)
    odds = np.log(np.maximum(p1, 1e-6) / np.maximum(p0, 1e-6))
    weight = seen.sum(0) / (seen.sum(0) + 8)
    m.emb[:, 0] = odds * weight
    m.emb[:, 1:] = rng.normal(0, 0.01, (2 * BUCKETS + 1, m.dim - 1))
    m.emb[PAD] = 0
    m.conv[0, :] = np.abs(m.conv[0, :])
    m.out[:] = 0.3
    return m


def peaks(m: Model, w: np.ndarray, p: np.ndarray, starts: np.ndarray, limit: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """The greatest output of each filter in each text, and where; ``limit`` words are worked on at once."""
    ends = np.append(starts[1:], len(w))
    best, at = np.full((len(starts), len(m.bias)), -np.inf, np.float32), np.zeros((len(starts), len(m.bias)), np.int64)
    for lo in range(0, len(w), limit):
        hi = min(lo + limit, len(w))
        maps = m.maps(w[lo : hi + max(WIDTHS)], p[lo : hi + max(WIDTHS)])[: hi - lo]
        for i in range(np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi, "left")):
            a, b = max(starts[i], lo), min(ends[i], hi)
            part = maps[a - lo : b - lo]
            k = part.argmax(0)
            v = np.take_along_axis(part, k[None], 0)[0]
            more = v > best[i]
            best[i, more], at[i, more] = v[more], a + k[more]
    return best, at


def descend(m: Model, words: list[np.ndarray], prefixes: list[np.ndarray], y: np.ndarray, passes: int, seed: int = 11) -> np.ndarray:
    """Train on whole texts with Adam, one step for each batch of 32 texts; how many steps met each embedding."""
    rng, n = np.random.default_rng(seed), len(y)
    steps = np.zeros(2 * BUCKETS + 1)
    params = [m.emb, m.conv, m.bias, m.out]
    mom, var, step, rate = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0, 0.007
    ob_m = ob_v = 0.0
    order = np.arange(n)
    for _ in range(passes):
        rng.shuffle(order)
        for b in range(0, n, 32):
            rows = order[b : b + 32]
            w, starts = _padded([words[i] for i in rows])
            p, _s = _padded([prefixes[i] for i in rows])
            pooled, at = peaks(m, w, p, starts)
            act = np.maximum(pooled + m.bias, 0)
            z = act @ m.out + m.out_bias
            d = (1 / (1 + np.exp(-z)) - y[rows]) / len(rows)
            g_out, g_act = act.T @ d + 1e-4 * m.out, np.outer(d, m.out) * (act > 0)
            g_conv = 1e-4 * m.conv
            touched, grads = [], []
            for i, cols in enumerate(m.columns()):
                for o, c in enumerate(cols):
                    for f in range(m.filters):
                        col, g = i * m.filters + f, g_act[:, i * m.filters + f]
                        pos = np.minimum(at[:, col] + o, len(w) - 1)
                        vec = m.emb[w[pos]] + m.emb[p[pos]]
                        j = c.start + f
                        g_conv[:, j] += vec.T @ g
                        e = np.outer(g, m.conv[:, j])
                        touched += [w[pos], p[pos]]
                        grads += [e, e]
            ids_, inv = np.unique(np.concatenate(touched), return_inverse=True)
            g_emb = np.zeros((len(ids_), m.dim), np.float32)
            np.add.at(g_emb, inv, np.concatenate(grads))
            g_emb += 0.001 * m.emb[ids_]
            g_emb[ids_ == PAD] = 0
            steps[ids_] += 1
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for q, (par, g) in enumerate(zip(params, (g_emb, g_conv, g_act.sum(0), g_out), strict=True)):
                rows_ = ids_ if q == 0 else slice(None)
                mom[q][rows_] = 0.9 * mom[q][rows_] + 0.1 * g
                var[q][rows_] = 0.999 * var[q][rows_] + 0.001 * g * g
                par[rows_] -= rate * fix * mom[q][rows_] / (np.sqrt(var[q][rows_]) + 1e-8)
            gb = float(d.sum())
            ob_m, ob_v = 0.9 * ob_m + 0.1 * gb, 0.999 * ob_v + 0.001 * gb * gb
            m.out_bias -= rate * fix * ob_m / (ob_v**0.5 + 1e-8)
    return steps


def _rows(m: Model) -> np.ndarray:
    """All weights in rows as long as an embedding, embeddings first."""
    rest = np.concatenate([m.conv.ravel(), m.bias, m.out, [m.out_bias]])
    return np.concatenate([m.emb, np.append(rest, np.zeros(-len(rest) % m.dim)).reshape(-1, m.dim)]).astype(float)


def _weights(rows: np.ndarray, like: Model) -> Model:
    cut = len(like.emb)
    rest, out, lo = rows[cut:].ravel(), [], 0
    for x in (like.conv, like.bias, like.out):
        out.append(rest[lo : lo + x.size].reshape(x.shape).astype(np.float32))
        lo += x.size
    return Model(like.dim, like.filters, rows[:cut].astype(np.float32), *out, out_bias=float(rest[lo]))


def averaged(fit: DataFrame, m: Model, shards: int, passes: int, seed: int) -> Model:
    """One round: every text takes part in its shard's passes from ``m``. The driver gets one row for each embedding."""
    def run(table: pa.Table) -> pa.Table:
        w, p, y = _arrays(table.sort_by("doc_id"))
        mine = _weights(_rows(m), m)
        steps = descend(mine, w, p, y, passes, seed)
        rows = _rows(mine)
        n = np.append(steps, np.full(len(rows) - len(steps), float(len(y))))
        at = np.flatnonzero(n)
        return pa.table([pa.array(at, pa.int32()), pa.array(n[at]), *(pa.array(rows[at, i]) for i in range(m.dim))], ["at", "n", *cols])

    cols = [f"v{i}" for i in range(m.dim)]
    dealt = fit.select("*", F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(shards)).alias("_shard"))
    each = dealt.groupBy("_shard").applyInArrow(run, "at int, n double, " + ", ".join(f"{c} double" for c in cols))
    got = each.groupBy("at").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in cols]).toArrow()
    rows = _rows(m)
    rows[got.column("at").to_numpy()] = np.stack([got.column(c).to_numpy() for c in cols], 1)
    return _weights(rows, m)


def predict(m: Model, words: list[np.ndarray], prefixes: list[np.ndarray], limit: int = 400_000) -> np.ndarray:
    """Scores from 0 to 1 of whole texts; memory follows ``limit`` words or the longest text."""
    out, lo = [], 0
    while lo < len(words):
        hi, size = lo, 0
        while hi < len(words) and (hi == lo or size + len(words[hi]) <= limit):
            size, hi = size + len(words[hi]), hi + 1
        w, starts = _padded(words[lo:hi])
        p, _ = _padded(prefixes[lo:hi])
        out.append(m.logits(np.maximum.reduceat(m.maps(w, p), starts, axis=0)))
        lo = hi
    z = np.concatenate(out) if out else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def calibrate(scores: np.ndarray, y: np.ndarray, lang: list, n: np.ndarray | None = None) -> dict:
    """For each language with both classes, the threshold of the best F1; 0.5 else. Each score counts ``n`` times."""
    best = {}
    n = np.ones(len(y)) if n is None else n
    for name in {x for x in lang if x is not None}:
        at = np.array([x == name for x in lang])
        s, t, k = scores[at], y[at] * n[at], n[at]
        if not 0 < t.sum() < k.sum():
            continue
        o = np.argsort(-s, kind="stable")
        f1 = 2 * np.cumsum(t[o]) / (np.cumsum(k[o]) + t.sum())
        last = np.append(s[o][1:] < s[o][:-1], True)  # equal scores fall on the same side
        i = int(np.where(last, f1, -1).argmax())
        below = s[o][i + 1] if i + 1 < len(o) else 0.0
        best[name] = float((s[o][i] + below) / 2)
    return best


def thresholds(rows: DataFrame, m: Model) -> dict:
    """Thresholds by language from all calibration rows: scores are counted in steps of 1 / ``STEPS``, and each language is
    decided in a task of its own on at most twice as many counts."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            w, p, y = _arrays(pa.Table.from_batches([batch]))
            at = np.rint(predict(m, w, p) * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(y.astype(np.int32)), pa.array(at)], ["lang", "y", "at"])

    def decide(table: pa.Table) -> pa.Table:
        at, y, n = (table.column(c).to_numpy() for c in ("at", "y", "n"))
        got = calibrate(at / STEPS, y, table.column("lang").to_pylist(), n)
        return pa.table([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.float64())], ["lang", "t"])

    counts = rows.filter(F.col("lang").isNotNull()).mapInArrow(run, "lang string, y int, at int").groupBy("lang", "y", "at").agg(F.count("*").alias("n"))
    return {r["lang"]: r["t"] for r in counts.groupBy("lang").applyInArrow(decide, "lang string, t double").collect()}


def _lists(col: pa.Array) -> list[np.ndarray]:
    if isinstance(col, pa.ChunkedArray):
        col = col.chunk(0) if col.num_chunks else pa.array([], col.type)
    flat, off = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    base = off[0]
    return [flat[a - base : b - base] for a, b in zip(off[:-1], off[1:], strict=True)]


def _with_lang(docs: DataFrame) -> DataFrame:
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.select("doc_id", "text", lang.cast("string").alias("lang"))


def _arrays(table: pa.Table) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Bucket ids and labels of rows of ``labelled_ids``."""
    w, p = (_lists(table.column(c).combine_chunks()) for c in ("_word", "_prefix"))
    y = np.array(table.column("_y").to_pylist(), dtype=np.float32)
    return [x.astype(np.int32) for x in w], [x.astype(np.int32) + BUCKETS for x in p], y


def labelled_ids(docs: DataFrame, labels: DataFrame, held_out: Column) -> DataFrame:
    """Bucket ids (16 bits each) and ``_y`` (0 or 1) of every labelled id that isn't held out, from one whole text of each,
    the one with the least hash. Rows with a null label are left out; of repeated labels the greatest counts."""
    known = labels.filter(F.col("toxic").isin(0, 1) & ~held_out).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("_y"))
    mine = _with_lang(docs).filter(F.col("doc_id").isNotNull() & ~held_out).withColumn("_h", F.xxhash64("text"))
    small = F.transform("_prefix", lambda p: (p - BUCKETS).cast("short")).alias("_prefix")
    rows = ids(mine, "doc_id", "lang", "_h").select("doc_id", F.struct("_h", "lang", F.col("_word").cast("array<short>").alias("_word"), small).alias("_r"))
    one = rows.groupBy("doc_id").agg(F.min("_r").alias("_r"))  # before the join: many texts of an id meet within tasks first
    return one.join(known, "doc_id").select("doc_id", "_y", "_r.lang", "_r._word", "_r._prefix")


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0) -> Model:
    """Fit and calibrate on all labelled rows outside the held-out fold, in 4 passes (more over few texts, until
    there are 400 steps, 20 passes at most)."""
    rows = materialise(labelled_ids(docs, labels, remainder(F.col("doc_id"), folds) == held), "labelled")
    rest = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(CALIBRATE)) == 0
    fit = rows.filter(~rest)
    n, ones, size = fit.agg(F.count("*"), F.coalesce(F.sum("_y"), F.lit(0)), F.coalesce(F.sum(F.size("_word")), F.lit(0))).first()
    both = F.concat(F.col("_word").cast("array<int>"), F.transform("_prefix", lambda p: p.cast("int") + BUCKETS))
    met = fit.select("_y", F.explode(F.array_distinct(both)).alias("at")).groupBy("at").agg(F.sum("_y").alias("ones"), F.count("*").alias("n")).toArrow()
    seen, at, toxic = np.zeros((2, 2 * BUCKETS + 1)), met.column("at").to_numpy(), met.column("ones").to_numpy()
    seen[1, at], seen[0, at] = toxic, met.column("n").to_numpy() - toxic
    m = start(n, ones, seen)
    if 0 < ones < n:
        shards = max(1, -(-n // SHARD_TEXTS), -(-size // SHARD_WORDS))
        passes, rounds = min(20, max(4, 400 * 32 // n)), ROUNDS if shards > 1 else 1
        for i in range(rounds):
            m = averaged(fit, m, shards, -(-passes // rounds), 11 + i)
    m.thresholds = thresholds(rows.filter(rest), m)
    return m


def score(docs: DataFrame, m: Model, *keep: str) -> DataFrame:
    """``score`` of each row, with its doc_id and the columns named."""
    names = ["doc_id", *keep]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = predict(m, _lists(batch.column("_word")), _lists(batch.column("_prefix")))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(s, pa.float64())], [*names, "score"])

    rows = ids(docs, *names)
    return rows.mapInArrow(run, rows.select(*names, F.lit(0.0).alias("score")).schema)


def digest(docs: DataFrame, m: Model, folds: int = 5, held: int = 0) -> DataFrame:
    """The registered query's columns and ``flagged`` (by the language's threshold)."""
    by_lang = F.lit(0.5)
    for name, t in sorted(m.thresholds.items()):
        by_lang = F.when(F.col("lang") == name, F.lit(t)).otherwise(by_lang)
    return score(_with_lang(docs), m, "lang").select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= by_lang).alias("flagged"),
    )
