"""The events as a topic: a micro-batch per slice, however many files it has."""

import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from riskloom.plans import streams


def test_topic_runs_in_a_micro_batch_per_slice(spark, tmp_path, monkeypatch):
    """The counter of a key follows event time although a slice has several files."""
    monkeypatch.setattr(streams, "FILE_ROWS", 50)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(minutes=(i * 7919) % 2000), i % 3, "view", float(i), "") for i in range(1000)] + [(1000, None, 1, "view", 1.0, "")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    df.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    path, files = streams._topic(spark, str(tmp_path))
    written = [f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".parquet")]
    assert files == 6 and len(written) == 4 * files
    got = {r["event_id"]: (r["user_id"], r["t"]) for r in streams.q_sequence(spark, str(tmp_path)).collect()}
    want = {}
    for user in range(3):
        mine = sorted((r for r in rows if r[2] == user), key=lambda r: (r[1] is None, r[1] or start, r[0]))
        want |= {r[0]: (user, t) for t, r in enumerate(mine)}
    assert got == want


def test_topic_of_one_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    df = spark.range(100).select(F.col("id").alias("event_id"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"),
                                 F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("").alias("props"))
    df.write.parquet(str(tmp_path / "events.parquet"))
    assert sorted(r["t"] for r in streams.q_sequence(spark, str(tmp_path)).collect()) == list(range(100))
