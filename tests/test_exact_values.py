"""Values that must come back as they went in: ids beside missing ones, CSV fields,
the latest row without a time; sequence counters on replay and on a hot key."""

import os
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from riskloom.operators import windows as WI
from riskloom.session import input_bytes, scratch_path, spread_small
from riskloom.sources import tables as T
from riskloom.streaming import monitor as M

BIG = 2**62
SCHEMA = "user_id bigint, ts timestamp, event_id bigint, value double"


def base_path(spark):
    return scratch_path(spark, f"ev-{uuid.uuid4().hex[:8]}").removeprefix("file:")


def events(spark, rows):
    return spark.createDataFrame(rows, "user_id bigint, sec bigint, event_id bigint, value double").select(
        "user_id", F.timestamp_seconds("sec").alias("ts"), "event_id", "value")


def test_ids_beside_a_missing_one_in_histories(spark):
    base = base_path(spark)
    rows = [(1, 10, None, 1.0), (1, 11, BIG + 1, None), (1, 12, BIG + 3, 2.0), (1, None, BIG + 5, 3.0), (2, 5, BIG + 7, None)]
    events(spark, rows).coalesce(1).write.parquet(f"{base}/in")
    h = M.history(M.vitals_source(spark, f"{base}/in", SCHEMA), "user_id", "ts", "event_id", "value", n=3)
    M.run_to_completion(M.batch_sink(h, f"{base}/out", f"{base}/ck", "update"))
    got = {r["user_id"]: r for r in spark.read.parquet(f"{base}/out").collect()}
    assert got[1]["event_ids"] == [None, BIG + 1, BIG + 3] and got[1]["values"] == [1.0, None, 2.0] and got[1]["n_seen"] == 4
    assert got[2]["event_ids"] == [BIG + 7] and got[2]["ts_us"] == [5_000_000]


def test_idle_keys_leave_the_state(spark):
    """The watermark passes key 1 and key 3, then not key 2; results stay the batch twin's."""
    base = base_path(spark)
    parts = [[(1, 10, BIG + 1, 1.0), (1, 10, None, 0.0), (2, 10, BIG + 3, None), (3, 5, 1, 1.0)], [(2, 900, 4, 2.0), (1, 400, 5, 9.0)], [(2, 1000, 6, 3.0)], [(2, 1001, 7, 4.0)]]
    rows = []
    for part in parts:
        rows += part
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = M.vitals_source(spark, f"{base}/in", SCHEMA, max_files_per_trigger=1)
        cur = M.current_evicting(stream, "user_id", "ts", "event_id", ("value",), idle_ms=300_000, watermark="10 seconds")
        M.run_to_completion(M.batch_sink(cur, f"{base}/out", f"{base}/ck", "update"))
    snap = M.latest_snapshot(spark.read.parquet(f"{base}/out"), "user_id")
    want = WI.latest(events(spark, rows), "user_id", "ts", ["value"], tiebreak="event_id")
    cols = ["user_id", "ts", "event_id", "value"]
    assert {tuple(r) for r in snap.select(*cols).collect()} == {tuple(r) for r in want.select(*cols).collect()}
    held = spark.read.format("statestore").option("path", f"{base}/ck").option("stateVarName", "newest").load()
    assert {r["key"][0] for r in held.collect()} == {2}


def test_sequences_on_replay_and_with_missing_values(spark):
    base = base_path(spark)
    rows = [[(1, 10, BIG + 3, 0.0), (1, 10, None, 0.0), (1, 10, BIG + 1, 0.0), (None, 3, 7, 0.0)], [(1, 5, 4, 0.0), (2, 6, 5, 0.0), (None, None, 8, 0.0)],
            [(1, None, 9, 0.0), (1, 900, 6, 0.0)]]
    for i, part in enumerate(rows):
        events(spark, part).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = M.vitals_source(spark, f"{base}/in", SCHEMA, max_files_per_trigger=1)
        M.run_to_completion(M.sequence_sink(stream, "user_id", "ts", "event_id", f"{base}/out", f"{base}/ck"))
    want = {(1, BIG + 1, 0), (1, BIG + 3, 1), (1, None, 2), (1, 4, 3), (1, 6, 4), (1, 9, 5), (2, 5, 0), (None, 7, 0), (None, 8, 1)}

    def result():
        return {tuple(r) for r in spark.read.parquet(f"{base}/out/rows").select("user_id", "event_id", "t").collect()}

    assert result() == want
    assert sorted(x for x in os.listdir(f"{base}/out/counts")) == ["v=1", "v=2"]  # older versions are gone
    os.rename(f"{base}/ck/commits/2", f"{base}/ck-commit-2")  # the last batch counts as unfinished
    os.rename(f"{base}/ck/commits/.2.crc", f"{base}/ck-commit-2.crc")
    stream = M.vitals_source(spark, f"{base}/in", SCHEMA, max_files_per_trigger=1)
    M.run_to_completion(M.sequence_sink(stream, "user_id", "ts", "event_id", f"{base}/out", f"{base}/ck"))
    assert result() == want


def test_sequence_of_a_hot_key_is_split(spark):
    rows = spark.range(3000).select((F.col("id") % 3 == 0).cast("bigint").alias("k"), F.timestamp_seconds(F.col("id") * 977 % 3001).alias("ts"), "id")
    none = spark.createDataFrame([(1, 5)], "k bigint, n bigint")
    out = M.sequence_batch(rows, "k", "ts", "id", none)
    got = {r["id"]: r["t"] for r in out.collect()}
    for k, start in ((0, 0), (1, 5)):
        ids = [r["id"] for r in rows.where(F.col("k") == k).orderBy("ts").collect()]
        assert [got[i] for i in ids] == list(range(start, start + len(ids)))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_latest_of_a_key_without_a_time(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (2, 5, "c")], "k int, ts int, v string")
    assert {tuple(r) for r in WI.latest(df, "k", "ts", ["v"]).collect()} == {(1, None, "a"), (2, 5, "c")}


TEXTS = ["plain", "", None, " lead ", "tail\t", 'a "b", c', '"', '""', "two\nlines", "x\r\ny", "a,b", "\\", 'back\\"slash', "#no comment", "é 日本", "'", "NULL", "nan"]


def test_csv_round_trip(spark):
    path = T.roundtrip_path(spark, "csv")
    df = spark.createDataFrame([(i, t, None if i % 3 else i / 7) for i, t in enumerate(TEXTS)], "k int, t string, x double")
    T.write_csv(df.coalesce(2), path)
    assert sorted(map(tuple, T.read_csv(spark, path, df.schema).collect())) == sorted(map(tuple, df.collect()))


def test_csv_of_pandas(spark):
    path = T.roundtrip_path(spark, "pandas-csv").removeprefix("file:")
    os.makedirs(path)
    pdf = pd.DataFrame({"k": range(len(TEXTS)), "t": TEXTS, "x": [float(i) for i in range(len(TEXTS))]})
    pdf.to_csv(f"{path}/a.csv", index=False)
    got = [r["t"] for r in T.read_csv(spark, path, "k int, t string, x double").orderBy("k").collect()]
    assert got == [t or None for t in TEXTS]  # pandas writes empty text and missing alike
    back = T.roundtrip_path(spark, "csv").removeprefix("file:")
    T.write_csv(spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").coalesce(1), back)
    part = next(f for f in os.listdir(back) if f.endswith(".csv"))
    read = pd.read_csv(f"{back}/{part}", keep_default_na=False).sort_values("k")["t"].tolist()
    assert read == [t or "" for t in TEXTS]


def test_spreading_runs_no_job(spark):
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count().orderBy("g")
    group = f"spread-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "plans only")
    try:
        out = spread_small(df)
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert out.count() == 7 and input_bytes(df) > 0
