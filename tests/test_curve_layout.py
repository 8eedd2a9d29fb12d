"""One layout, four lookups: results unchanged and row groups skipped for each."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.sources import curve as Z
from riskloom.sources import tables as T


def rows_read(df):
    """Rows that the scan hands on after skipping row groups."""
    df.collect()
    scan = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return scan.metrics().apply("numOutputRows").value()


@pytest.fixture(scope="module")
def scored(spark):
    rng = random.Random(4)
    n = 60_000
    rows = [(i, rng.randrange(20_000) * 17, rng.randrange(25), rng.choice(["Low", "Moderate", "High", "Critical"]), rng.random()) for i in range(n)]
    return spark.createDataFrame(rows, "admission_id long, patient_id long, hospital_id int, risk_tier string, score double")


def test_every_lookup_skips_row_groups(spark, scored):
    path = T.roundtrip_path(spark, "curve")
    Z.write_curve(scored, path, ["hospital_id", "risk_tier", "score"], keys=["patient_id"], num_partitions=64, row_group_bytes=1 << 20, key_values=2_000)
    back, n = spark.read.parquet(path), scored.count()
    assert back.count() == n and back.columns == scored.columns
    known = scored.first()["patient_id"]
    for cond, most in (("hospital_id = 7", 0.5), ("risk_tier = 'Critical'", 0.5), ("score >= 0.95", 0.5), (f"patient_id = {known}", 0.2),
                       ("patient_id = 5", 0.2), (f"patient_id IN ({known}, 5)", 0.2), ("hospital_id = 7 AND score >= 0.95", 0.2)):
        got = back.where(cond)
        assert rows_read(got) <= most * n, cond
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, scored.where(cond).collect()))


def test_awkward_columns(spark):
    rows = [(None, None, None), (1.5, "a", 1), (float("nan"), "", 2), (0.0, "é", None)] * 50
    df = spark.createDataFrame(rows, "x double, s string, k int")
    path = T.roundtrip_path(spark, "curve")
    Z.write_curve(df, path, ["x", "s"], keys=["k"], bits=3, num_partitions=4)
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))
    Z.write_curve(df.limit(0), path, ["x", "s"], bits=3)
    assert spark.read.parquet(path).count() == 0
    with pytest.raises(ValueError):
        Z.with_position(df, ["x", "s"], 40)


def test_ranges_are_even(spark):
    df = spark.range(40_000).withColumn("v", (F.col("id") * F.col("id")).cast("double"))
    cuts = Z.cut_points(df, ["v"], 4)["v"]
    counts = [r["count"] for r in df.groupBy(Z.range_number(df, "v", cuts, 4).alias("b")).count().collect()]
    assert len(counts) == 16 and max(counts) < 2 * min(counts)
