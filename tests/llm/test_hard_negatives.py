"""Hard-negative mining against every pair, the curve against its definition, and the bounds against scores."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, pack int, block string, win string"


def test_curve_visits_neighbours():
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=n)))
        keys = [bytes(k) for k in hard_negatives.hilbert_keys(points, bits)]
        assert len(set(keys)) == len(points)
        walk = points[sorted(range(len(keys)), key=keys.__getitem__)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain(rows):
    """The rules read out, over (vec_id, embedding, label)."""
    kept = {}
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % 7 == 0 else label
        comps = tuple(max(min(math.floor(256 * float(np.float32(x))), 1 << 26), -(1 << 26)) for x in v)
        kept[i, label, comps] = None
    kept, out = list(kept), []
    first = lambda scored, k: sorted(scored, key=lambda t: (-t[0], t[1] is None, t[1] or 0))[:k]
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2]))  # noqa: B023, E731
        for p, pid in first([(score(b), b[0]) for b in kept if b is not a and b[1] == a[1]], 5):
            found = first([(s, b[0]) for b in kept if b[1] != a[1] for s in [score(b)] if 30 * p <= 100 * s <= 90 * p], 10)
            out += [(a[0], pid, k, nid, p, s) for k, (s, nid) in enumerate(found, 1)]
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, x, 1, "b", "w") for i, v, x in rows], SCHEMA)


def got(spark, rows, **more):
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return sorted(map(tuple, hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 100 == 0, moved, **more).collect()), key=str)


def clustered(seed, n, dims=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(5, dims))
    return [(int(i) * 10, (middle[i % 5] + 0.2 * rng.normal(size=dims)).astype("f4").tolist(), int(rng.integers(0, 4))) for i in range(n)]


def test_pairs_and_pruning(spark):
    rows, seen = clustered(1, 900), {}
    found = got(spark, rows, rows_of_block=16, pack=7, step=lambda df, name: seen.update({name: df.count()}))
    assert found == plain(rows) and found
    blocks = 900 / 16
    packs = -(-90 // 7)
    assert seen["positives-None"] < 0.7 * blocks * packs  # bounds leave blocks out
    assert seen["positives-2"] < seen["positives-None"]


def test_edges(spark):
    rng = random.Random(2)
    rows = clustered(3, 120, 3)
    rows += [(i, [rng.choice([0.0, 1.0, -1.0]) for _ in range(rng.choice([0, 1, 3, 4]))], rng.choice([0, 1, 2])) for i in range(700, 760)]  # ties, unequal lengths
    rows += [(800, None, 1), (900, [1.0, None, 2.0], 1), (1000, [float("nan")] * 3, 1), (1100, [float("inf"), 0.0, 0.0], 1), (1200, [1.0, 2.0, 3.0], None)]
    rows += [(None, [1.0, 1.0, 1.0], 1), (None, [0.9, 1.0, 1.0], 2), (1300, [], 1), (-100, [0.5, 0.5, 0.5], 0)]
    rows += [(1400, [1.0, 1.0, 0.5], 1)] * 5 + [(1400, [1.0, 1.0, 0.25], 1), (1500, [0.8, 0.8, 0.8], 3)]
    rows += [(1600 + i, [1.0, 1.0, 1.0], i % 2) for i in range(200)]  # one vector with many ids
    assert got(spark, rows, rows_of_block=16) == plain(rows)


def test_large_values_are_exact(spark):
    rng = random.Random(4)
    rows = [(i * 20, [rng.uniform(-3e5, 3e5) for _ in range(4)], i % 3) for i in range(60)] + [(5, [3e38, -3e38, 1.0, 1e9], 1)]
    assert got(spark, rows, rows_of_block=8) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, [1.0], 1), (2, [2.0], 2)], [(100, [], 1), (200, [], 1), (3, [], 2)]])
def test_little(spark, rows):
    assert sorted(map(tuple, hard_negatives.digest(frame(spark, rows)).collect()), key=str) == plain(rows)
