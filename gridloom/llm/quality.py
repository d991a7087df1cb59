"""Quality by a linear-chain conditional random field over the lines of a text.

Each line gets features of its bytes and words and those of its neighbours; the field labels every
line good or bad. Only documents have labels, so those of lines are found by hard expectation-maximisation:
at first a line carries its document's label, then the one that the field gives it, but for the lines
that lean most towards their document's label, which keep it up to half of its length. The marginals of
the forward-backward pass, weighted by line length, aggregate into a document share, which a logistic
curve fitted on the same sample turns into the score.

Cases: null and empty texts have one line without bytes and score 0; repeated rows each get a result
row; with labels of one class only the score is their share, without labels 0.5; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.labelled import remainder, sample

#: Labelled documents, at most, that training gathers in one task.
SAMPLE = 4_000
#: Steps of each round of training; lines are labelled anew before all but the first.
STEPS = (150, 60, 60)
#: Fixed classes of bytes whose shares are features.
CLASSES = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"-()", b"!", b"|",
    b"%$#&*@^~=+<>{}[]\\/_`", bytes(range(128, 256)),
]
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
MIX = np.uint64(0x9E3779B97F4A7C15)


def _of_class() -> np.ndarray:
    out = np.full(256, len(CLASSES), np.uint8)
    for i, c in enumerate(CLASSES):
        out[list(c)] = i
    return out


CLASS = _of_class()


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines of all texts, bytes of each line, and the index of each text's first line.

    One pass over the joined bytes: counts by class, words, words equal to the one before, lines seen
    before in the text. Every text has one line at least.
    """
    raw = [(t or "").encode("utf-8", "replace") + b"\n" for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.int64)
    kind = CLASS[data]
    n = len(ends)
    line_of = np.repeat(np.arange(n), ends - starts + 1)
    counts = np.bincount(line_of * 16 + kind, minlength=16 * n).reshape(n, 16)[:, : len(CLASSES)].astype(np.float32)

    inside = ~GAP[data]
    first = np.flatnonzero(inside & np.concatenate(([True], ~inside[:-1])))
    nf = len(first)
    words = np.bincount(line_of[first], minlength=n).astype(np.float32) if nf else np.zeros(n, np.float32)
    same = np.zeros(n, np.float32)
    line_hash = size.astype(np.uint64)
    if nf:
        # a word's hash: bytes times powers of an odd number, by place in the word
        place = np.arange(len(data)) - np.repeat(np.concatenate(([0], first)), np.diff(np.concatenate(([0], first, [len(data)]))))
        power = np.cumprod(np.full(64, MIX | np.uint64(1), np.uint64))
        coded = (data.astype(np.uint64) + np.uint64(1)) * power[place & 63] * inside
        word_hash = np.add.reduceat(coded, first)
        equal = np.concatenate(([False], (word_hash[1:] == word_hash[:-1])))
        same = np.bincount(line_of[first], weights=equal, minlength=n).astype(np.float32)
        order = np.arange(nf) - np.searchsorted(first, starts)[line_of[first]]
        shaken = (word_hash ^ (word_hash >> np.uint64(29))) * (MIX + np.uint64(2) * order.astype(np.uint64))
        at = np.unique(line_of[first], return_index=True)
        line_hash[at[0]] ^= np.add.reduceat(shaken, at[1])
    text_starts = np.concatenate(([0], np.cumsum([len(r) for r in raw])[:-1])).astype(np.int64)
    begin = np.searchsorted(starts, text_starts)
    text_of = np.zeros(n, np.int64)
    text_of[begin[1:]] = 1
    text_of = np.cumsum(text_of)
    key = line_hash ^ (text_of.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, inv, times = np.unique(key, return_inverse=True, return_counts=True)
    repeated = ((times[inv] > 1) & (size > 0)).astype(np.float32)

    wide = np.maximum(size, 1).astype(np.float32)[:, None]
    w = np.maximum(words, 1)
    feats = np.column_stack([
        counts / wide, np.minimum(counts[:, 4:7], 8) / 8, np.log1p(size) / 5, np.log1p(words) / 4,
        np.minimum(size / w, 40) / 10, same / w, np.minimum(same, 10) / 10, repeated, size == 0,
    ]).astype(np.float32)
    return feats, size, begin


def batched_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of many texts, a bounded part of them at a time; bytes take many times their room."""
    parts = [line_features(texts[a:b]) for a, b in _slices(texts)]
    lines = np.cumsum([0] + [len(x) for x, _, _ in parts[:-1]])
    return (
        np.concatenate([x for x, _, _ in parts]), np.concatenate([s for _, s, _ in parts]),
        np.concatenate([b + n for (_, _, b), n in zip(parts, lines, strict=True)]),
    )


def _slices(texts: list, limit: int = 500_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters, of one text at least."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < limit):
            size, hi = size + len(texts[hi] or ""), hi + 1
        yield lo, hi
        lo = hi


def with_neighbours(x: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Own features, those of the line before and after (zeros at a text's ends), and a constant."""
    n = len(x)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[begin] = 0
    after[np.concatenate((begin[1:] - 1, [n - 1]))] = 0
    return np.column_stack([x, before, after, np.ones(n, np.float32)])


@dataclass
class Model:
    weights: np.ndarray  # of the features, for good against bad
    moves: np.ndarray  # 2 x 2, from and to
    slope: float
    shift: float
    constant: float | None = None


#: A model as a row.
MODEL = pa.schema([
    ("weights", pa.list_(pa.float64())), ("moves", pa.list_(pa.list_(pa.float64()))), ("slope", pa.float64()), ("shift", pa.float64()), ("constant", pa.float64()),
])


def marginals(u: np.ndarray, begin: np.ndarray, moves: np.ndarray, pairs: bool = False):
    """Probability that each line is good; all texts are stepped through together, longest first.

    u: score of good against bad. With ``pairs`` also the summed probabilities of neighbouring labels.
    """
    n = len(u)
    length = np.diff(np.append(begin, n))
    order = np.argsort(-length, kind="stable")
    first, length = begin[order], length[order]
    still = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")  # texts longer than t
    e = np.zeros((n, 2))
    e[:, 1] = u
    fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
    for t in range(len(still)):
        i = first[: still[t]] + t
        if t == 0:
            a = e[i]
        else:
            p = fwd[i - 1]
            a = np.logaddexp(p[:, :1] + moves[0], p[:, 1:] + moves[1]) + e[i]
        fwd[i] = a - np.logaddexp(a[:, 0], a[:, 1])[:, None]
    for t in range(len(still) - 2, -1, -1):
        i = first[: still[t + 1]] + t
        q = e[i + 1] + bwd[i + 1]
        b = np.logaddexp(q[:, :1] + moves[:, 0], q[:, 1:] + moves[:, 1])
        bwd[i] = b - np.logaddexp(b[:, 0], b[:, 1])[:, None]
    z = (fwd + bwd)[:, 1] - (fwd + bwd)[:, 0]
    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    if not pairs:
        return p
    inner = np.ones(n, bool)
    inner[begin] = False
    j = np.flatnonzero(inner)
    s = fwd[j - 1][:, :, None] + moves + (e[j] + bwd[j])[:, None, :]
    s = np.exp(s - s.max(axis=(1, 2), keepdims=True))
    return p, (s / s.sum(axis=(1, 2), keepdims=True)).sum(0)


def share(p: np.ndarray, size: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals; 0 for a text without bytes."""
    total = np.add.reduceat(size, begin).astype(float)
    return np.where(total > 0, np.add.reduceat(p * size, begin) / np.maximum(total, 1), 0.0)


def _logit(s: np.ndarray) -> np.ndarray:
    s = np.clip(s, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def line_labels(p: np.ndarray, size: np.ndarray, begin: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A label for each line: that which its marginal leans to, but the lines that lean most towards their
    document's label carry it until they make up half of the document's bytes."""
    n = len(p)
    text_of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    want = y[text_of].astype(int)
    order = np.lexsort((-np.where(want == 1, p, 1 - p), text_of))
    before = np.concatenate(([0], np.cumsum(size[order])[:-1]))
    before -= before[begin][text_of]
    must = np.zeros(n, bool)
    must[order] = 2 * before < np.maximum(np.add.reduceat(size, begin), 1)[text_of]
    return np.where(must, want, (p >= 0.5).astype(int))


def fit(texts: list[str], y: np.ndarray, steps: tuple = STEPS) -> Model:
    """Maximum conditional likelihood of the line labels by Adam over whole texts, then the logistic curve."""
    mean = float(y.mean()) if len(y) else 0.5
    if len(y) == 0 or mean in (0.0, 1.0):
        return Model(np.zeros(1), np.zeros((2, 2)), 0.0, 0.0, mean)
    x, size, begin = batched_features(texts)
    x = with_neighbours(x, begin)
    n = len(x)
    inner = np.ones(n, bool)
    inner[begin] = False
    inner = np.flatnonzero(inner)
    t = np.repeat(y, np.diff(np.append(begin, n))).astype(int)
    w, moves = np.zeros(x.shape[1]), np.zeros((2, 2))
    per = 1 / len(begin)
    for k_round, n_steps in enumerate(steps):
        if k_round:
            t = line_labels(marginals(x @ w, begin, moves), size, begin, y)
        seen = np.bincount(2 * t[inner - 1] + t[inner], minlength=4).reshape(2, 2).astype(float)
        mom = [np.zeros_like(w), np.zeros_like(moves)]
        var = [np.zeros_like(w), np.zeros_like(moves)]
        for k in range(1, n_steps + 1):
            p, both = marginals(x @ w, begin, moves, True)
            grads = [x.T @ (p - t) * per + 1e-3 * w, (both - seen) * per + 3e-2 * moves]
            for q, (par, g) in enumerate(zip((w, moves), grads, strict=True)):
                mom[q], var[q] = 0.9 * mom[q] + 0.1 * g, 0.99 * var[q] + 0.01 * g * g
                par -= 0.15 * (mom[q] / (1 - 0.9**k)) / (np.sqrt(var[q] / (1 - 0.99**k)) + 1e-8)
    z = _logit(share(marginals(x @ w, begin, moves), size, begin))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps with a weak prior
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        r, v = p - y, p * (1 - p) + 1e-6
        g = np.array([r @ z + 0.1 * (a - 1), r.sum() + 0.1 * b])
        h = np.array([[v @ (z * z) + 0.1, v @ z], [v @ z, v.sum() + 0.1]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    return Model(w, moves, float(a), float(b))


def predict(m: Model, texts: list[str]) -> np.ndarray:
    """Scores from 0 to 1 of whole texts."""
    if not texts:
        return np.zeros(0)
    if m.constant is not None:
        return np.full(len(texts), m.constant)
    x, size, begin = line_features(texts)
    s = share(marginals(with_neighbours(x, begin) @ m.weights, begin, m.moves), size, begin)
    p = 1 / (1 + np.exp(-np.clip(m.slope * _logit(s) + m.shift, -60, 60)))
    return np.where(np.add.reduceat(size, begin) > 0, p, 0.0)


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold, in a task: the driver gets the model and no texts."""
    out = remainder(F.col("doc_id"), folds) == held
    got = sample(docs.select("doc_id", "text"), labels, "quality", out, rows)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        if not batches:
            return
        whole = pa.Table.from_batches(batches).sort_by("doc_id")
        m = fit(whole.column("text").to_pylist(), np.array(whole.column("_y").to_pylist(), dtype=float))
        yield pa.RecordBatch.from_pylist([vars(m) | {"weights": m.weights.tolist(), "moves": m.moves.tolist()}], MODEL)

    # the sample is bounded, so one task fits it; only the model goes to the driver
    fitted = got.repartition(1).mapInArrow(run, "weights array<double>, moves array<array<double>>, slope double, shift double, constant double").collect()
    if not fitted:
        return fit([], np.zeros(0))
    m = fitted[0].asDict()
    return Model(**m | {"weights": np.array(m["weights"]), "moves": np.array(m["moves"])})


def _scores(m: Model, texts: list) -> np.ndarray:
    """Scores of a batch, in parts of bounded size."""
    return np.concatenate([np.zeros(0), *[predict(m, texts[a:b]) for a, b in _slices(texts)]])


def with_score(docs: DataFrame, m: Model, name: str = "score") -> DataFrame:
    """All columns and the score."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = _scores(m, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias(name)).schema)


def score(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id and ``score`` of each row; only these go back to the JVM."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = _scores(m, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64())], ["doc_id", "score"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0.0).alias("score")).schema)


def label_lines(docs: DataFrame, m: Model) -> DataFrame:
    """doc_id, line (from 0), n_bytes, good (the line's marginal) and label of every line of every row."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = batch.column("text").to_pylist()
            for a, b in _slices(texts):
                x, size, begin = line_features(texts[a:b])
                n = np.diff(np.append(begin, len(x)))
                whose = np.repeat(np.arange(a, b), n)
                if m.constant is None:
                    p = marginals(with_neighbours(x, begin) @ m.weights, begin, m.moves)
                else:
                    p = np.full(len(x), m.constant)
                no = np.arange(len(x)) - np.repeat(begin, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(whose)), pa.array(no), pa.array(size), pa.array(p), pa.array((p >= 0.5).astype(np.int32))],
                    ["doc_id", "line", "n_bytes", "good", "label"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {key}, line long, n_bytes long, good double, label int")


def digest(docs: DataFrame, m: Model, folds: int = 4, held: int = 2) -> DataFrame:
    """The registered query's columns."""
    return score(docs, m).select(
        "doc_id", (remainder(F.col("doc_id"), folds) == held).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )
