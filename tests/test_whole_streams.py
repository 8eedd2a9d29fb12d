"""Events without a time are in every stream's result, as in its oracle."""

import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF001

NAMES = ["st1_monitor", "st2_alerts", "st3_history", "st4_current", "st5_dead_letter", "st7_sequence", "io8_vitals_source", "io9_vitals_sink"]


@pytest.fixture(scope="module")
def folder(spark):
    d = tempfile.mkdtemp(prefix="riskloom-test-null-ts-")
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev = ev.withColumn("ts", F.when(F.col("event_id") % 7 != 0, F.col("ts")))
    ev.coalesce(1).write.parquet(f"{d}/events.parquet")
    spark.read.parquet(f"{SF001}/customer.parquet").write.parquet(f"{d}/customer.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_events_without_time(spark, folder, name):
    con = duckdb.connect()
    for t in ("events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    cols = sorted(want.columns)
    got = entry.queries()[name](spark, folder).select(*cols).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want.project(", ".join(cols)).fetchall()))
