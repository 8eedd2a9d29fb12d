import uuid

from pyspark.sql import functions as F

from riskloom.operators import windows as WI
from riskloom.plans.streams import EVENTS_SCHEMA
from riskloom.session import scratch_path
from riskloom.streaming import monitor as M

from conftest import SF01


import pytest


@pytest.mark.parametrize("timeout", [None, (90 * 86_400_000, "60 days")])
def test_history_over_many_batches_equals_batch_last_n(spark, timeout):
    # Split events into files whose arrival order is NOT event-time order.
    base = scratch_path(spark, f"st-{uuid.uuid4().hex[:8]}")
    ev = spark.read.parquet(f"{SF01}/events.parquet")
    ev.repartition(6, F.col("event_id") % 6).write.parquet(f"{base}/in")
    stream = M.vitals_source(spark, f"{base}/in", EVENTS_SCHEMA, max_files_per_trigger=1)
    # Files arrive out of event-time order; with a timeout the watermark delay
    # must cover that lateness, or late events are (correctly) dropped.
    kw = {} if timeout is None else {"idle_timeout_ms": timeout[0], "watermark": timeout[1]}
    h = M.history(stream, "user_id", "ts", "event_id", "value", n=20, **kw)
    M.run_to_completion(M.batch_sink(h, f"{base}/out", f"{base}/ck", "update"))
    got = M.explode_history(M.latest_snapshot(spark.read.parquet(f"{base}/out"), "user_id"), "user_id")
    exp = WI.last_n(ev.select("user_id", "ts", "event_id", "value"), "user_id", "ts", 20, tiebreak="event_id")
    cols = ["user_id", "ts", "event_id", "value", "recency"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, exp.select(*cols).collect()))
    n_seen = M.latest_snapshot(spark.read.parquet(f"{base}/out"), "user_id").agg(F.sum("n_seen")).first()[0]
    assert n_seen == ev.count()
