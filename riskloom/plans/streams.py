"""Streaming bindings: events play the vitals topic, customers the patients.

Each query runs a real Structured Streaming job (availableNow trigger,
checkpointed in the shared scratch area) and returns what its sink holds;
the oracle is the batch twin of the same question.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.plans.fixture import EVENT_CLIP, EVENT_RANGES, table
from riskloom.plans.surface import _ranges_sql
from riskloom.sources.tables import roundtrip_path
from riskloom.streaming import monitor as M
from riskloom.streaming import snapshots as SN

QUERIES: dict = {}
SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


EVENTS_SCHEMA = ("event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
                 "props string")


N_SLICES = 4
#: Rows of a file of the topic, which one task writes.
FILE_ROWS = 250_000
_TOPIC: dict = {}


def _topic(spark, d) -> tuple[str, int]:
    """The events as a topic in a few slices, written one after the other in event-time
    order, events without a time in the last.  Every slice has the same number of files,
    which is returned: a stream that takes so many at a time runs in a micro-batch per
    slice, however large the table is."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TOPIC:
        path = roundtrip_path(spark, "topic")
        sec = F.unix_seconds(F.col("ts").cast("timestamp"))
        ev = table(spark, d, "events")
        cuts = ev.select(sec.cast("double").alias("s")).approxQuantile("s", [k / N_SLICES for k in range(1, N_SLICES)], 0.01)
        rows = ev.agg(*[F.count_if(sec < F.lit(c)).alias(f"c{i}") for i, c in enumerate(cuts)], F.count(F.lit(1)).alias("n")).first()
        files = max(1, -(-rows["n"] // (N_SLICES * FILE_ROWS)))
        if files > 1:  # a slice needs a row for every file, else it joins the next one
            kept, below = [], 0
            for i, c in enumerate(cuts):
                if rows[f"c{i}"] - below >= files and rows["n"] - rows[f"c{i}"] >= files:
                    kept, below = [*kept, c], rows[f"c{i}"]
            cuts = kept
        for lo, hi in zip([None, *cuts], [*cuts, None]):
            part = ev
            if lo is not None:
                part = part.where(sec >= F.lit(lo))
            if hi is not None:
                part = part.where(sec < F.lit(hi))
            elif lo is not None:
                part = ev.where((sec >= F.lit(lo)) | sec.isNull())
            part.repartition(files).write.mode("append").parquet(path)
        _TOPIC[key] = path, files
    return _TOPIC[key]


def _stream(spark, d):
    path, files = _topic(spark, d)
    return M.vitals_source(spark, path, EVENTS_SCHEMA, max_files_per_trigger=files)


def _paths(spark, name):
    base = roundtrip_path(spark, name)
    return f"{base}/out", f"{base}/_checkpoint"


def _clip_sql() -> str:
    hi = " ".join(f"WHEN event_type = '{k}' THEN {b!r}" for k, (_, b) in EVENT_CLIP.items())
    lo = " ".join(f"WHEN event_type = '{k}' THEN {a!r}" for k, (a, _) in EVENT_CLIP.items())
    return (f"round(CASE WHEN value IS NULL OR isnan(value) THEN value ELSE "
            f"greatest(least(value, CASE {hi} END), CASE {lo} END) END, 1)")


@register("st1_monitor", f"""
SELECT e.event_id, e.user_id, e.event_type, c.c_name, {_clip_sql()} AS reading
FROM events e JOIN customer c ON e.user_id = c.c_custkey""")
def q_monitor(spark, d):
    out, ck = _paths(spark, "monitor")
    mon = M.monitor(_stream(spark, d), table(spark, d, "customer"), "user_id", "c_custkey", "value",
                    "event_type", EVENT_CLIP, keep_static=("c_name",))
    q = M.vitals_sink(mon.select("event_id", "user_id", "event_type", "c_name", "reading"), out, ck)
    M.run_to_completion(q)
    return spark.read.parquet(out)


@register("st2_alerts", f"""
SELECT event_id, user_id, event_type, value FROM events WHERE {_ranges_sql('event_type', 'value')}""")
def q_alerts(spark, d):
    out, ck = _paths(spark, "alerts")
    al = M.alerts(_stream(spark, d), "value", "event_type", EVENT_RANGES)
    q = M.vitals_sink(al.select("event_id", "user_id", "event_type", "value"), out, ck)
    M.run_to_completion(q)
    return spark.read.parquet(out)


@register("st3_history", """
SELECT user_id, ts, event_id, value, CAST(recency AS INTEGER) AS recency FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS recency FROM events)
WHERE recency <= 60""")
def q_history(spark, d):
    out, ck = _paths(spark, "history")
    h = M.history(_stream(spark, d), "user_id", "ts", "event_id", "value", n=60)
    M.run_to_completion(M.batch_sink(h, out, ck, "update"))
    snap = M.latest_snapshot(spark.read.parquet(out), "user_id")
    return M.explode_history(snap, "user_id")


@register("st4_current", """
SELECT user_id, ts, event_id, event_type, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def q_current(spark, d):
    out, ck = _paths(spark, "current")
    cur = M.current(_stream(spark, d), "user_id", "ts", "event_id", ("event_type", "value"))
    M.run_to_completion(M.batch_sink(cur, out, ck, "update"))
    snap = M.latest_snapshot(spark.read.parquet(out), "user_id")
    return snap.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value")


@register("st4_current_evicting", SQL["st4_current"])
def q_current_evicting(spark, d):
    """The same with a state that idle keys leave; the delay covers the files' order."""
    out, ck = _paths(spark, "current-evicting")
    cur = M.current_evicting(_stream(spark, d), "user_id", "ts", "event_id", ("event_type", "value"), 86_400_000, "3650 days")
    M.run_to_completion(M.batch_sink(cur, out, ck, "update"))
    snap = M.latest_snapshot(spark.read.parquet(out), "user_id")
    return snap.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value")


@register("st3_history_snapshots", SQL["st3_history"])
def q_history_snapshots(spark, d):
    """The same into a table of snapshots: two batches beside the last one at most."""
    out, ck = _paths(spark, "history-snapshots")
    h = M.history(_stream(spark, d), "user_id", "ts", "event_id", "value", n=60)
    M.run_to_completion(SN.snapshot_sink(h, out, ck, ["user_id"], every=2))
    return M.explode_history(SN.read_snapshot(spark, out, ["user_id"]), "user_id")


@register("st5_dead_letter", """
SELECT event_id, user_id, 'unknown key' AS error FROM events e
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = e.user_id AND c.c_mktsegment <> 'MACHINERY')""")
def q_dead_letter(spark, d):
    base = roundtrip_path(spark, "deadletter")
    good, dead, ck = f"{base}/good", f"{base}/dead", f"{base}/_checkpoint"
    # Registered patients: every segment but one, so some messages are unknown.
    known = table(spark, d, "customer").where(F.col("c_mktsegment") != "MACHINERY")
    q = M.dead_letter_sink(_stream(spark, d), known, "user_id", "c_custkey", good, dead, ck)
    M.run_to_completion(q)
    return spark.read.parquet(dead).select("event_id", "user_id", "error")


@register("st7_sequence", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t FROM events""")
def q_sequence(spark, d):
    out, ck = _paths(spark, "sequence")
    M.run_to_completion(M.sequence_sink(_stream(spark, d).select("user_id", "ts", "event_id"), "user_id", "ts", "event_id", out, ck))
    return spark.read.parquet(f"{out}/rows").select("user_id", "event_id", "t")


@register("io8_vitals_source", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def q_vitals_source(spark, d):
    """Streaming source read to completion into a memory-free file sink."""
    out, ck = _paths(spark, "source")
    q = M.vitals_sink(_stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp_ntz")), out, ck)
    M.run_to_completion(q)
    return spark.read.parquet(out)


@register("io9_vitals_sink", f"""
SELECT user_id AS patient_id, event_type AS channel, {_clip_sql()} AS reading, ts AS recorded_at FROM events""")
def q_vitals_sink(spark, d):
    """Declared vitals table layout: (patient, channel, reading, recorded_at)."""
    out, ck = _paths(spark, "vitals")
    s = _stream(spark, d)
    from riskloom.functions import scalar as S
    lo, hi = S.range_lookup("event_type", EVENT_CLIP)
    rows = s.select(F.col("user_id").alias("patient_id"), F.col("event_type").alias("channel"),
                    F.round(S.clip("value", lo, hi), 1).alias("reading"),
                    F.col("ts").cast("timestamp_ntz").alias("recorded_at"))
    M.run_to_completion(M.vitals_sink(rows, out, ck))
    return spark.read.parquet(out)
