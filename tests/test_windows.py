import datetime as dt
import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskloom.operators import windows as WI


def _events(spark, n=400, keys=4, seed=9):
    rnd = random.Random(seed)
    base = dt.datetime(2020, 1, 1)
    rows = [(i, rnd.randint(1, keys), base + dt.timedelta(days=rnd.randint(0, 900), seconds=rnd.randint(0, 3)))
            for i in range(n)]
    return spark.createDataFrame(rows, "id long, k int, ts timestamp_ntz")


def test_return_within_bucketed_equals_plain_lead(spark):
    df = _events(spark)
    got = {r["id"]: r["label"] for r in WI.return_within(df, "k", "ts", "id", days=30, bucket_days=7).collect()}
    w = Window.partitionBy("k").orderBy("ts", "id")
    nxt = F.lead("ts").over(w)
    ref = df.select("id", F.coalesce(F.datediff(F.to_date(nxt), F.to_date("ts")) <= 30, F.lit(False))
                    .cast("int").alias("label"))
    assert got == {r["id"]: r["label"] for r in ref.collect()}


def test_prior_count_matches_brute_force(spark):
    df = _events(spark)
    rows = df.collect()
    got = {r["id"]: r["prior_count"] for r in WI.prior_count(df, "k", "ts", days=365).collect()}
    for r in rows:
        t = r["ts"]
        exp = sum(1 for o in rows if o["k"] == r["k"] and t - dt.timedelta(days=365) <= o["ts"] <= t - dt.timedelta(seconds=1))
        assert got[r["id"]] == exp


def test_last_n_is_limited_before_shuffle(spark):
    df = _events(spark)
    plan = WI.last_n(df, "k", "ts", 5, tiebreak="id")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
