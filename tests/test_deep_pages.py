"""Deep pages by order-statistic selection: equal to the sorted list, bounded tasks."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import ordering as SL

NAN = float("nan")


def listed(rows, direction):
    """Rows (value, id) in the order of sort_by."""
    missing = lambda v: v is None or v != v
    have = sorted((r for r in rows if not missing(r[0])), key=lambda r: (r[1] is not None, r[1]))
    have.sort(key=lambda r: r[0], reverse=direction == "desc")
    return have + sorted((r for r in rows if missing(r[0])), key=lambda r: (r[1] is not None, r[1]))


@pytest.mark.parametrize("kind,direction", [("double", "desc"), ("double", "asc"), ("string", "asc"), ("string", "desc")])
def test_pages_of_every_depth(spark, monkeypatch, kind, direction):
    monkeypatch.setattr(SL, "SELECT_KEYS", 64)
    rng = random.Random(2)
    value = (lambda: rng.choice([None, NAN, 0.5, round(rng.random(), 2)])) if kind == "double" else (lambda: rng.choice([None, "", "é", "Z", "zz", "日本"]))
    rows = [(value(), i) for i in range(3000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, f"v {kind}, id long").repartition(5)
    want = listed(rows, direction)
    for page in (1, 3, 40, 200, 300, 301):
        got = [r["id"] for r in SL.page(df, "v", direction, ["id"], page, 10).collect()]
        assert got == [r[1] for r in want[(page - 1) * 10:page * 10]], page


def test_one_value_for_a_third_and_equal_keys(spark, monkeypatch):
    monkeypatch.setattr(SL, "SELECT_KEYS", 32)
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.col("id") / 7000).alias("v"), (F.col("id") % 4).alias("id"))
    want = [tuple(r) for r in df.orderBy(F.desc("v"), "id").collect()]
    for page in (10, 60, 100):
        assert [tuple(r) for r in SL.page(df, "v", "desc", ["id"], page, 20).collect()] == want[(page - 1) * 20:page * 20]


def test_page_9000_takes_a_page_of_rows(spark, monkeypatch):
    df = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003 / 1_000_003).alias("v"), "id")
    out = SL.page(df, "v", "desc", ["id"], 9000, 100)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=100" in plan and "899900" not in plan
    want = df.orderBy(F.desc("v"), "id").limit(900_000).orderBy("v", F.desc("id")).limit(100)
    assert {tuple(r) for r in out.collect()} == {tuple(r) for r in want.collect()}
    assert SL.page(df, "v", "desc", ["id"], 10_001, 100).count() == 0
