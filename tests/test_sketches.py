"""Sketches of batches, merged, against the exact figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import sketches as K
from riskloom.sources import tables as T

PROBS = [0.0, 0.01, 0.1, 0.5, 0.9, 0.99, 1.0]


@pytest.mark.parametrize("shape", ["id", "id * id", "id % 7", "exp(id / 3000.0)"])
def test_quantiles_of_batches_within_the_bound(spark, shape):
    df = spark.range(40_000).select((F.col("id") % 4).alias("b"), F.expr(f"cast({shape} as double)").alias("v"), (F.col("id") % 5000).alias("u"))
    path = T.roundtrip_path(spark, "sketches")
    for b in range(4):
        K.write_batch(K.batch_sketches(df.where(F.col("b") == b), ["v"], ["u"]), path, b)
    K.write_batch(K.batch_sketches(df.where(F.col("b") == 2), ["v"], ["u"]), path, 2)  # once more
    all_ = K.merged(spark, path, ["v"], ["u"])
    values = np.sort(df.toPandas()["v"].to_numpy())
    for r in K.quantiles(all_, "v", PROBS).collect():
        low, high = np.searchsorted(values, r["value"], "left") / len(values), np.searchsorted(values, r["value"], "right") / len(values)
        assert low - K.rank_error() <= r["prob"] <= high + K.rank_error()
    row = K.summary(all_, ["v"], ["u"]).first()
    assert row["n"] == 40_000 and row["v_min"] == values[0] and row["v_max"] == values[-1]
    assert row["v_mean"] == pytest.approx(values.mean()) and abs(row["u_distinct"] / 5000 - 1) < 0.06


def test_groups_missing_values_and_no_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", float("nan")), ("b", None), (None, 5.0)], "g string, v double")
    rows = {r["g"]: r for r in K.summary(K.merge(K.batch_sketches(df, ["v"], by=["g"]), ["v"], by=["g"]), ["v"], by=["g"]).collect()}
    assert rows["a"]["n"] == 3 and rows["a"]["v_median"] == 1.0 and rows["b"]["v_median"] is None and rows[None]["v_mean"] == 5.0
    assert K.quantiles(K.batch_sketches(df, ["v"], by=["g"]), "v", [0.5], by=["g"]).count() == 2
    assert K.batch_sketches(df.limit(0), ["v"], by=["g"]).count() == 0
