"""Running sums and runs over ordered rows in blocks, so that one long series is many tasks.

A block of rows gives a summary, summaries are scanned by series (a row or two for each block), and each
block goes on from what the scan says. For runs the summary is associative: a run that touches a block's
start or end may go on in its neighbour, all others are finished where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.quantiles import attach
from gridloom.operators.splits import row_index
from gridloom.shared import fresh

BLOCK = 4_096


def running_sum(df: DataFrame, name: str, value: Column, keys: list[str], at: str, block: int = BLOCK) -> DataFrame:
    """Sum of ``value`` over the series' rows up to each, by position ``at`` (see ``row_index``)."""
    b, v, before = fresh(df, "_sb", "_sv", "_so")
    rows = df.withColumns({b: F.floor(F.col(at) / block).cast("long"), v: F.coalesce(value.cast("long"), F.lit(0))})
    sums = rows.groupBy(*keys, b).agg(F.sum(v).alias(before))
    so_far = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, b, F.coalesce(F.sum(before).over(so_far), F.lit(0)).alias(before))
    inner = Window.partitionBy(*keys, b).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    out = attach(rows.withColumn(v, F.sum(v).over(inner)), offsets, [*keys, b])
    return out.withColumn(name, F.col(before) + F.col(v)).select(*[c for c in df.columns if c != name], name)


def runs(df: DataFrame, condition: Column, keys: list[str], ts: str, block: int = BLOCK) -> DataFrame:
    """keys, started, ended, n_samples of unbroken runs of rows that meet a condition, by time."""
    at, b, on, seg = fresh(df, "_i", "_sb", "_on", "_seg")
    rows = row_index(df.select(*keys, ts, condition.alias(on)), at, ts, keys)
    rows = rows.withColumn(b, F.floor(F.col(at) / block).cast("long"))
    inner = Window.partitionBy(*keys, b).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    ends = rows.withColumn(seg, F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(inner)).filter(on)
    # a run's first and last positions say whether it touches the block's ends
    part = ends.groupBy(*keys, b, seg).agg(
        F.min(at).alias("_a"), F.max(at).alias("_z"), F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count("*").alias("n_samples")
    )
    touches = (F.col("_a") % block == 0) | (F.col("_z") % block == block - 1)
    done = part.filter(~touches).select(*keys, "started", "ended", "n_samples")
    edge = part.filter(touches)  # two rows for each block at most
    order = Window.partitionBy(*keys).orderBy("_a")
    linked = F.coalesce(F.lag("_z").over(order) == F.col("_a") - 1, F.lit(False))
    chain = edge.withColumn("_new", (~linked).cast("int")).withColumn("_run", F.sum("_new").over(order))
    merged = chain.groupBy(*keys, "_run").agg(F.min("started").alias("started"), F.max("ended").alias("ended"), F.sum("n_samples").alias("n_samples"))
    return done.unionByName(merged.drop("_run"))
