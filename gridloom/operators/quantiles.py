"""Exact quantiles without a buffer of all distinct values: rank selection over ranges of values.

Where no group has more than ``MOST_RANKED`` rows, ``percentile`` itself is bounded and is taken. Else:

1. A sketch of bounded size gives for each wanted quantile two values that should enclose it closely.
2. One pass of counts says how many rows lie below and within each enclosure, so whether it holds the wanted
   ranks; where it doesn't, the side that failed is opened to the least or greatest value.
3. Only rows inside enclosures are kept, counted by value and ranked; one with more than ``MOST_RANKED`` rows
   is narrowed again by the same steps, its ranks counted from its own start.

Several columns and groups go through the same passes. Results are those of ``percentile``, interpolated between
the two neighbouring ranks, whatever the sketch says: it only decides how much is ranked.
Nulls are left out; a group without values has null quantiles. NaN counts as the greatest value.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.shared import fresh, materialise

#: Size of the sketch: its ranks are off by one in so many rows.
ACCURACY = 5_000
#: Rows strictly inside an enclosure that one task may rank.
MOST_RANKED = 50_000
#: Ranges of the sketch where an enclosure is narrowed again.
GRID = 256


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(and_, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right, strict=True)], F.lit(True))


def attach(df: DataFrame, other: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on equal keys, nulls included; ``other`` has a row for each key, or one row where there are no keys."""
    (one,) = fresh(df, "_one")
    names = fresh(df, *[f"_k{i}" for i in range(len(keys))])
    right = other.withColumnsRenamed(dict(zip(keys, names, strict=True))).withColumn(one, F.lit(1))
    cond = _same(keys, names) if keys else F.lit(1) == F.col(one)
    return df.join(right, cond, how).drop(one, *names)


def melt(df: DataFrame, columns: Mapping[str, Column], by: list[str]) -> DataFrame:
    """by, feature, value of columns, nulls left out."""
    parts = [F.struct(F.lit(n).alias("feature"), c.cast("double").alias("value")) for n, c in columns.items()]
    return df.select(*by, F.inline(F.array(*parts))).filter("value IS NOT NULL")


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Ranks before and after the place of a quantile, and the weight of the latter."""
    at = F.lit(float(p)) * (n - 1)
    return F.floor(at).cast("long"), F.ceil(at).cast("long"), at - F.floor(at)


def _enclosed(n: Column, lo: Column, hi: Column, below: Column, upto: Column, least: Column, most: Column, a: Column, b: Column) -> dict[str, Column]:
    """An enclosure that holds the ranks ``a`` and ``b``: lo, hi, and the rows below it."""
    low, high = below <= a, upto > b
    return {"lo": F.when(low, lo).otherwise(least), "hi": F.when(high, hi).otherwise(most), "before": F.when(low, below).otherwise(F.lit(0)).cast("long")}


def _narrowed(rows: DataFrame, keys: list[str], most_ranked: int) -> DataFrame:
    """keys, value, before, r_lo, r_hi: rows of enclosures (each with wanted ranks) cut down until they are small."""
    while True:
        grid = [i / GRID for i in range(GRID + 1)]
        per = rows.groupBy(*keys).agg(
            F.count("*").alias("n"), F.any_value("before").alias("before"), F.any_value("r_lo").alias("r_lo"), F.any_value("r_hi").alias("r_hi"),
            F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", grid, ACCURACY).alias("s"),
        )
        place = lambda r: (F.col(r) - F.col("before")) / F.greatest(F.col("n") - 1, F.lit(1)) * GRID
        lo = F.element_at("s", F.greatest(F.floor(place("r_lo")).cast("int") - 1, F.lit(0)) + 1)
        hi = F.element_at("s", F.least(F.ceil(place("r_hi")).cast("int") + 1, F.lit(GRID)) + 1)
        per = materialise(per.select(*keys, "n", "before", "r_lo", "r_hi", "least", "most", lo.alias("lo"), hi.alias("hi")), "narrow")
        met = attach(rows.select(*keys, "value"), per, keys, "inner")
        inside = lambda lo, hi: F.count_if((F.col("value") > lo) & (F.col("value") < hi))
        counts = met.groupBy(*keys, *[c for c in per.columns if c not in keys]).agg(F.count_if(F.col("value") < F.col("lo")).alias("below"), F.count_if(F.col("value") <= F.col("hi")).alias("upto"))
        own = _enclosed(F.col("n"), F.col("lo"), F.col("hi"), F.col("below"), F.col("upto"), F.col("least"), F.col("most"), F.col("r_lo") - F.col("before"), F.col("r_hi") - F.col("before"))
        cut = counts.select(*keys, "r_lo", "r_hi", own["lo"].alias("lo"), own["hi"].alias("hi"), (F.col("before") + own["before"]).alias("before"))
        cut = materialise(cut, "narrow")
        rows = attach(rows.select(*keys, "value"), cut, keys, "inner").filter((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
        largest = rows.groupBy(*keys).agg(inside(F.col("lo"), F.col("hi")).alias("n")).agg(F.max("n")).first()[0] or 0
        rows = rows.drop("lo", "hi")
        if largest <= most_ranked:
            return rows


def quantiles(df: DataFrame, columns: Mapping[str, Column], ps: list[float], by: list[str] | None = None, most_ranked: int = MOST_RANKED, accuracy: int = ACCURACY) -> DataFrame:
    """by, feature, n (values) and q (the quantiles ``ps`` in order) of each column in each group."""
    by, want = list(by or []), range(len(ps))
    keys = [*by, "feature"]
    rows = melt(df, columns, by)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= most_ranked:  # no buffer can hold more than this
        return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("value", F.lit([float(p) for p in ps])).alias("q"))
    near = 2 / accuracy
    grid = [x for p in ps for x in (max(p - near, 0.0), min(p + near, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile_approx("value", grid, accuracy).alias("s")
    )
    sketch = materialise(sketch, "sketch")
    lo, hi, v = (lambda i: F.col("s")[2 * i]), (lambda i: F.col("s")[2 * i + 1]), F.col("value")
    counts = attach(rows, sketch, keys, "inner").groupBy(*keys, "n", "least", "most", "s").agg(*[
        c for i in want for c in (F.count_if(v < lo(i)).alias(f"b{i}"), F.count_if(v <= hi(i)).alias(f"u{i}"), F.count_if((v > lo(i)) & (v < hi(i))).alias(f"i{i}"))
    ])
    parts = []
    for i, p in enumerate(ps):
        a, b, _ = _ranks(F.col("n"), p)
        own = _enclosed(F.col("n"), lo(i), hi(i), F.col(f"b{i}"), F.col(f"u{i}"), F.col("least"), F.col("most"), a, b)
        opened = (F.col(f"b{i}") > a) | (F.col(f"u{i}") <= b)
        size = F.when(opened, F.col("n")).otherwise(F.col(f"i{i}"))
        parts.append(F.struct(F.lit(i).alias("i"), a.alias("r_lo"), b.alias("r_hi"), *[c.alias(k) for k, c in own.items()], size.alias("size")))
    cells = materialise(counts.select(*keys, "n", F.array(*parts).alias("cells")), "cells")
    largest = cells.agg(F.max(F.array_max(F.transform("cells", lambda c: c["size"])))).first()[0] or 0

    held = F.filter("cells", lambda c: (F.col("value") >= c["lo"]) & (F.col("value") <= c["hi"]))
    inner = attach(rows, cells.select(*keys, "cells"), keys, "inner").select(*keys, "value", F.inline(held))
    inner = inner.select(*keys, "i", "value", "before", "r_lo", "r_hi")
    if largest > most_ranked:
        inner = _narrowed(inner, [*keys, "i"], most_ranked)
    each = inner.groupBy(*keys, "i", "before", "r_lo", "r_hi", "value").agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys, "i").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.withColumn("end", F.col("before") + F.sum("c").over(w))
    here = lambda r: (F.col(r) < F.col("end")) & (F.col(r) >= F.col("end") - F.col("c"))
    pick = lambda i, r: F.max(F.when((F.col("i") == i) & here(r), F.col("value")))
    found = ranked.groupBy(*keys).agg(*[c for i in want for c in (pick(i, "r_lo").alias(f"a{i}"), pick(i, "r_hi").alias(f"z{i}"))])
    out = attach(cells.select(*keys, "n"), found, keys)
    q = []
    for i, p in enumerate(ps):
        a, b, weight = _ranks(F.col("n"), p)
        q.append(F.when(a == b, F.col(f"a{i}")).otherwise(F.col(f"a{i}") * (1 - weight) + F.col(f"z{i}") * weight))
    return out.select(*keys, "n", F.array(*q).alias("q"))


def with_quantiles(stats: DataFrame, df: DataFrame, col: Column | str, names: Mapping[str, float], by: list[str] | None = None, **more) -> DataFrame:
    """``stats``, a row for each group of ``by``, with the named exact quantiles of a column of ``df``."""
    c = F.col(col) if isinstance(col, str) else col
    found = quantiles(df, {"v": c}, list(names.values()), by, **more)
    found = found.select(*(by or []), *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    return attach(stats, found, list(by or []))
