"""Exact top groups by bounds, wide vocabularies as tables, logs with snapshots."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from riskloom.functions import features as FE
from riskloom.operators import aggregates as AG
from riskloom.operators import heavy as HG
from riskloom.session import scratch_path
from riskloom.streaming import monitor as M
from riskloom.streaming import snapshots as SN


def _coded(spark, codes):
    rows = [(c, (i % 100) / 100, i % 2) for i, c in enumerate(codes)]
    return spark.createDataFrame(rows, "code string, score double, label int").repartition(8)


@pytest.mark.parametrize("buckets,hashes", [(1 << 16, 3), (64, 2), (1, 1)])
def test_top_groups_by_bounds_are_exact(spark, buckets, hashes):
    rng = random.Random(7)
    codes = [f"rare{i}" for i in range(30_000)] + [f"c{int(rng.paretovariate(0.8))}" for _ in range(10_000)] + [None] * 500
    df = _coded(spark, codes).cache()
    want = AG.breakdown(df, "code", "score", "label").collect()
    assert HG.breakdown_bounded(df, "code", "score", "label", buckets=buckets, hashes=hashes).collect() == want
    few = HG.candidates(df, "code", 15, buckets, hashes).select("code").distinct().count()
    assert few < 200 if buckets > 64 else few >= 15


def test_top_groups_of_ties_few_values_and_no_rows(spark):
    for codes in ([f"t{i:03d}" for i in range(100)] * 3, ["a", "b", "a", None], [None], []):
        df = _coded(spark, codes)
        assert HG.breakdown_bounded(df, "code", "score", "label").collect() == AG.breakdown(df, "code", "score", "label").collect()
        bound = HG.count_bound(df, "code", 15, HG.likely_top(df, "code", 15))
        counts = sorted(Counter(c for c in codes if c is not None).values(), reverse=True)
        assert bound <= (counts[14] if len(counts) > 14 else 1)


def test_a_dictionary_has_the_positions_of_one_hot(spark):
    rows = [(1, "b", "x"), (2, "a", None), (3, None, None), (4, "b", "y"), (5, "", "x")]
    df = spark.createDataFrame(rows, "id long, c string, d string")
    wide = FE.one_hot(df, ["c", "d"], keep=["id"])
    names = [n for n in wide.columns if n != "id"]
    words = FE.dictionary(df, ["c", "d"])
    assert [f"{r['column']}_{r['value']}" for r in words.orderBy("index").collect()] == names
    got = {r["id"]: r["indices"] for r in FE.encode(df, ["c", "d"], "id", words).collect()}
    assert got == {r["id"]: [i for i, n in enumerate(names) if r[n]] for r in wide.collect()}
    vectors = FE.sparse_vectors(FE.encode(df, ["c", "d"], "id", words), len(names)).collect()
    assert {r["id"]: r["features"].toArray().tolist() for r in vectors} == {r["id"]: [float(r[n]) for n in names] for r in wide.collect()}
    unseen = spark.createDataFrame([(9, "zz", "y")], df.schema)
    assert FE.encode(unseen, ["c", "d"], "id", words).first()["indices"] == [names.index("d_y")]
    assert FE.dictionary(df.limit(0), ["c"]).count() == 0


def test_a_vocabulary_of_100000_values(spark):
    df = spark.range(200_000).select("id", F.concat(F.lit("v"), F.col("id") % 100_000).alias("c"))
    words = FE.dictionary(df, ["c"]).cache()
    order = sorted(f"v{i}" for i in range(100_000))
    assert words.count() == 100_000 and {r["value"]: r["index"] for r in words.collect()} == {v: i for i, v in enumerate(order)}
    spread = FE.encode(df, ["c"], "id", words).agg(F.count("id"), F.count_if(F.size("indices") == 1), F.sum(F.col("indices")[0])).first()
    assert tuple(spread) == (200_000, 200_000, 100_000 * 99_999)


def _folders(spark, path):
    return {k: M.folder_versions(spark, f"{path}/{k}") for k in ("batches", "snapshots", "manifest")}


def test_snapshots_bound_the_folders_and_survive_replays(spark):
    path, truth = scratch_path(spark, f"snap-{uuid.uuid4().hex[:8]}"), {}
    rng = random.Random(3)
    with pytest.raises(ValueError):
        SN.read_snapshot(spark, path, ["k"])
    for b in range(9):
        rows = {rng.choice([None, *range(12)]): float(b * 100 + i) for i in range(6)}
        batch = spark.createDataFrame(list(rows.items()), "k long, v double").coalesce(2)
        truth |= rows
        for _ in range(2 if b % 2 else 1):   # every other batch is run again
            SN.write_batch(batch, b, path, ["k"], every=3)
            assert dict(map(tuple, SN.read_snapshot(spark, path, ["k"]).collect())) == truth
        found = _folders(spark, path)
        assert len(found["manifest"]) <= 2 and len(found["batches"]) <= 6 and len(found["snapshots"]) <= 2


def test_a_batch_that_fails_before_its_manifest_changes_nothing(spark):
    path = scratch_path(spark, f"snap-{uuid.uuid4().hex[:8]}")
    for b in range(3):
        SN.write_batch(spark.createDataFrame([(1, float(b))], "k long, v double"), b, path, ["k"], every=2)
    lost = spark.createDataFrame([(1, 99.0)], "k long, v double")
    lost.withColumn("_batch", F.lit(3)).write.parquet(f"{path}/batches/v=3")   # and no manifest
    assert SN.read_snapshot(spark, path, ["k"]).first()["v"] == 2.0
    SN.write_batch(spark.createDataFrame([(1, 3.0)], "k long, v double"), 3, path, ["k"], every=2)
    assert SN.read_snapshot(spark, path, ["k"]).first()["v"] == 3.0
