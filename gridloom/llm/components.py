"""Connected components of edges by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import join_hot, materialise

HOT_SHARE = 1_024


def _state(edges: DataFrame) -> tuple[int, bool]:
    """Edges (u, v), u larger, and whether they are stars: every u has one v, which hangs on nothing."""
    ends = edges.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, bad = each.agg(F.sum("up"), F.count_if((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0))).first()
    return n or 0, not bad


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (u, v): the smallest vertex of its component.

    Each round hangs the larger neighbours of every vertex on its smallest one, then the smaller
    ones, until the edges are stars; the number of rounds grows with the logarithm of the vertices, and each
    costs the driver some twenty stages, so none is run just to see that nothing changes. Neighbours are never
    gathered: a vertex's smallest neighbour is an aggregate that is joined back to its edges; vertices
    with more than one in ``HOT_SHARE`` of them, as many at most, are broadcast for this.
    """
    e = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialise(e, "edges")
    n, done = _state(e)
    while not done:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = F.col("_n") > max(2 * n // HOT_SHARE, 1)
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n")).select("u", F.least("u", "m").alias("m"), "_n")
        large = join_hot(both.filter("v > u"), least, ["u"], hot).filter("v <> m")
        large = materialise(large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("_n"))
        small = join_hot(large, low, ["u"], hot)
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialise(small, "edges")
        n, done = _state(e)
    roots = e.select(F.col("v")).distinct().select("v", F.col("v").alias("root"))
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionAll(roots)
