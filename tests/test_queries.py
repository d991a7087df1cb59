"""A few registered queries against their SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
NAMES = ["a1_regional_hourly", "f11_bridge_days", "w2_rolling", "w3_ewma", "a23_metrics_summary", "d1_psi", "w11_anomalies", "st3_stream_anomalies", "j6_donor_swap", "w15_folds_walk_forward"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return con


def shown(x):
    return f"{x:.4f}" if isinstance(x, float) else str(x)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    r = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(shown(x[names.index(c)]) for c in cols) for x in r.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_serving_stream_with_equal_latencies(spark, duck, tmp_path):
    """Copies of events share their latency and hour, and the last hour is closed in part; some have no latency."""
    import __spark_entry__ as entry

    events = spark.read.parquet(f"{DATA}/events.parquet")
    value = F.when(F.hour("ts") == 3, None).otherwise(F.col("value")).alias("value")
    copies = events.select("event_id", "ts", "user_id", "event_type", value, "props").crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    copies.withColumn("event_id", F.col("event_id") + 100_000 * F.col("copy")).drop("copy").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    got = entry.queries()["st6_stream_serving"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    r = con.execute(entry.oracle_sql()["st6_stream_serving"])
    at = [[d[0] for d in r.description].index(c) for c in got.columns]
    want = sorted(tuple(shown(x[i]) for i in at) for x in r.fetchall())
    assert len(want) > 100 and sorted(tuple(map(shown, x)) for x in got.collect()) == want


def test_every_query_is_callable():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
