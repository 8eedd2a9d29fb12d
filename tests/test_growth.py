"""What a task reads and how often a step runs do not grow with the tables."""

import pytest
from pyspark.sql import functions as F

from riskloom.functions import features as FE
from riskloom.operators import aggregates as AG
from riskloom.operators.ordered import running_totals
from riskloom.session import fits_at_once, spread_rows
from riskloom.spec import Derived, FeatureSpec


@pytest.fixture
def large_tables(spark):
    """Nothing is small enough to be broadcast by its estimated size."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_class_weights_do_not_shuffle_rows_by_label(spark, large_tables):
    df = spark.range(0, 20_000, 1, 6).select("id", F.when(F.col("id") % 50 == 0, None).otherwise((F.col("id") % 10 == 0).cast("int")).alias("label"))
    out = AG.class_weights(df, "label", "w")
    assert out.withColumn("p", F.spark_partition_id()).groupBy("p").count().count() == 6
    got = {(r["label"], round(r["w"], 9) if r["w"] is not None else None): r["count"] for r in out.groupBy("label", "w").count().collect()}
    n = 20_000 - 400
    assert got == {(0, round(n / (2 * 18_000), 9)): 18_000, (1, round(n / (2 * 1_600), 9)): 1_600, (None, None): 400}


def test_running_totals_do_not_shuffle_rows_by_group(spark, large_tables):
    df = spark.range(0, 20_000, 1, 4).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("k"), F.lit(1).alias("c"))
    out = running_totals(df, "k", ["c"], ["g"], n_ranges=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [g" in plan
    assert out.where(F.col("cum_c") != F.floor(F.col("k") / 2) + 1).count() == 0


def test_spread_rows_bounds_a_task(spark):
    cores = spark.sparkContext.defaultParallelism
    df = spark.range(100 * cores)
    assert spread_rows(df).rdd.getNumPartitions() == cores and fits_at_once(df, 4) == 4
    sizes = [r["count"] for r in spread_rows(df, 25).groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 * cores and max(sizes) <= 30


def test_medians_do_not_repeat_what_features_are_made_of(spark):
    runs = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    df = spark.range(0, 100, 1, 1).select("id", F.when(F.col("id") % 4 > 0, F.col("id").cast("double")).alias("x")).mapInPandas(count, "id long, x double")
    spec = FeatureSpec(numeric=["x"], categorical={}, derived=[Derived("y", "gt", "x", threshold=3.0)])
    got = {r["id"]: r["x"] for r in FE.derive_features(df, spec, keep=["id"], impute=True).collect()}
    assert runs.value == 100
    assert got[5] == 5.0 and got[0] == 50.0  # the median of what is there
