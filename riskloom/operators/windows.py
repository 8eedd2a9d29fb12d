"""Window operators (WI-*).

Per-key windows are the one place where a hot key (say a third of all rows)
lands in a single task.  The history windows here therefore split each key's
timeline into time buckets: the window runs per (key, bucket) and the few
values that cross a bucket boundary are stitched back exactly.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import scalar as S
from riskloom.session import cut_lineage


# WI-1 -----------------------------------------------------------------------
def rank_groups(agg: DataFrame, by: str, key: str, out: str = "rank") -> DataFrame:
    """Ordinal rank (1 = highest ``by``) over an already aggregated table.

    Meant for aggregated input (one row per group).  The rank is a running count
    over value ranges, so even a table of very many groups is never sorted in one
    task.  Missing values (NULL or NaN) rank last.
    """
    return global_rank(agg, [F.desc_nulls_last(S.order_key(agg, by)), F.asc(key)], out)


def global_rank(df: DataFrame, order: Sequence, out: str) -> DataFrame:
    """1-based position in the order over all rows: rows are range-partitioned and
    numbered per partition; the partitions' counts give the offsets."""
    cols = df.columns
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Written once: the number of a row's partition must not change on a re-run.
    parts = cut_lineage(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()))
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_first"))
    before = counts.select("_p", "_first", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return parts.join(before, "_p").select(
        *cols, (F.col("_before") + F.col("_i") - F.col("_first") + 1).cast("int").alias(out))


# WI-2 -----------------------------------------------------------------------
def top_drivers(long_df: DataFrame, row_id: str, feature: str, value: str, n: int,
                out: str = "rank") -> DataFrame:
    """Top-n features by |value| per row (feature name breaks ties).

    ``row_number() <= n`` is planned as a WindowGroupLimit, which keeps only n
    rows per key on the map side before the shuffle.
    """
    w = Window.partitionBy(row_id).orderBy(F.desc(F.abs(F.col(value))), F.asc(feature))
    return long_df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


# WI-3 -----------------------------------------------------------------------
def last_n(df: DataFrame, key: str, ts: str, n: int = 60, tiebreak: str | None = None,
           out: str = "recency") -> DataFrame:
    """Keep the newest n rows per key (1 = newest).

    Planned with a partial WindowGroupLimit before the shuffle, so a hot key
    ships at most n rows per input partition.
    """
    order = [F.desc(ts)] + ([F.desc(tiebreak)] if tiebreak else [])
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= n)


# WI-4 -----------------------------------------------------------------------
def latest(df: DataFrame, key: str, ts: str, cols: Sequence[str], tiebreak: str | None = None) -> DataFrame:
    """Latest row per key as an aggregate (max_by), no sort; partial
    aggregation keeps a hot key to one buffer per map task.  A row without a time
    is the oldest, and the latest of a key that has no other (a struct is never null)."""
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.struct(F.col(ts))
    payload = F.struct(*[F.col(c) for c in [ts, *([tiebreak] if tiebreak else []), *cols]])
    return (df.groupBy(key).agg(F.max_by(payload, order).alias("_last"))
            .select(key, "_last.*"))


# WI-5 -----------------------------------------------------------------------
def relative_band(df: DataFrame, value: str, out: str = "band",
                  bands: Sequence[tuple[float, str]] = spec.RELATIVE_BANDS,
                  other: str = spec.RELATIVE_BAND_ELSE) -> DataFrame:
    """Band by share of the maximum (max attached as a scalar subquery); missing
    values (NULL or NaN) have no share and are not the maximum."""
    mx = df.agg(F.max(S.missing_as_null(value)).alias("m")).scalar()
    share = F.try_divide(S.missing_as_null(value), mx.cast("double"))
    expr = None
    for t, lab in bands:
        expr = F.when(share > F.lit(t), F.lit(lab)) if expr is None else expr.when(share > F.lit(t), F.lit(lab))
    return df.withColumn("share_of_max", F.round(share, 4)).withColumn(out, expr.otherwise(F.lit(other)))


# WI-6 -----------------------------------------------------------------------
def return_within(df: DataFrame, key: str, ts: str, row_id: str, days: int = 30,
                  out: str = "label", bucket_days: float = 1 / 144) -> DataFrame:
    """1 if the key's next row (by ts, row_id) falls within ``days`` calendar days.

    Skew-safe lead: a key's rows are cut into slices of ``bucket_days`` (ten
    minutes) of its timeline; the lead runs in a slice, and the last row of a slice takes the
    first timestamp of the key's next non-empty slice, found on the per-slice
    summary (one row per slice, however many rows it holds).
    """
    slice_ = F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / F.lit(86_400.0 * bucket_days))
    x = df.withColumn("_b", slice_)
    w = Window.partitionBy(key, "_b").orderBy(F.col(ts), F.col(row_id))
    x = x.withColumn("_next_in", F.lead(ts).over(w))
    firsts = x.groupBy(key, "_b").agg(F.min(ts).alias("_first"))
    wb = Window.partitionBy(key).orderBy("_b")
    nxt = firsts.select(key, "_b", F.lead("_first").over(wb).alias("_next_bucket"))
    x = x.join(nxt, [key, "_b"], "left")
    nxt_ts = F.coalesce(F.col("_next_in"), F.col("_next_bucket"))
    label = F.coalesce(F.datediff(F.to_date(nxt_ts), F.to_date(F.col(ts))) <= F.lit(days), F.lit(False))
    return x.withColumn(out, label.cast("int")).drop("_b", "_next_in", "_next_bucket")


# WI-7 -----------------------------------------------------------------------
def prior_count(df: DataFrame, key: str, ts: str, days: int = 365, out: str = "prior_count",
                salts: int = 64) -> DataFrame:
    """Rows of the same key in [ts - days, ts - 1 s].

    The count is (rows of the key before ts) - (rows before ts - days), two
    lookups in the key's running totals.  The totals are built per (key, second),
    one row however many rows share it, in slices of ``days`` / ``salts``, whose
    sums give the offsets, so neither a hot key nor a hot year is one task's rows.
    """
    width = int(days) * 86400
    step = max(1, width // salts)
    sec = F.unix_seconds(F.col(ts).cast("timestamp"))
    x = df.withColumn("_sec", sec)
    per = x.where(F.col("_sec").isNotNull()).groupBy(key, "_sec").agg(F.count(F.lit(1)).alias("_n"))
    # Points where the running total is asked for: at a row's second, and days before.
    asked = per.select(key, "_sec", F.explode(F.array(
        F.struct(F.col("_sec").alias("at"), F.col("_n").alias("n"), F.lit(False).alias("back")),
        F.struct((F.col("_sec") - width).alias("at"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("back")))).alias("p"))
    asked = asked.select(key, "_sec", "p.*").withColumn("_b", F.floor(F.col("at") / F.lit(step)))
    w = Window.partitionBy(key, "_b").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    inside = asked.withColumn("_in", F.coalesce(F.sum("n").over(w), F.lit(0)))
    sums = asked.groupBy(key, "_b").agg(F.sum("n").alias("_s"))
    sums = sums.withColumn("_off", F.sum("_s").over(Window.partitionBy(key).orderBy("_b")) - F.col("_s")).drop("_s")
    total = (inside.join(sums, [key, "_b"]).withColumn("_t", F.col("_off") + F.col("_in"))
             .groupBy(key, "_sec").agg((F.sum(F.when(~F.col("back"), F.col("_t"))) - F.sum(F.when(F.col("back"), F.col("_t")))).alias(out)))
    return x.join(total, [key, "_sec"], "left").withColumn(out, F.coalesce(out, F.lit(0)).cast("long")).drop("_sec").select(*df.columns, out)


# SC-25 / SC-27 helpers over bounded (per-key last-n) input --------------------
def history_arrays(df: DataFrame, key: str, ts: str, cols: Sequence[str], tiebreak: str | None = None) -> DataFrame:
    """Per key: time-ordered arrays of ts and each column (input must be bounded
    per key, e.g. the output of :func:`last_n`)."""
    order = [F.col(ts)] + ([F.col(tiebreak)] if tiebreak else [])
    st = F.sort_array(F.collect_list(F.struct(*order, *[F.col(c) for c in cols])))
    g = df.groupBy(key).agg(st.alias("_h"))
    return g.select(key, F.col(f"_h.{ts}").alias(ts), *[F.col(f"_h.{c}").alias(c) for c in cols])


def abnormal_flags(df: DataFrame, value: str, channel: str, ranges: Mapping[str, tuple[float, float]],
                   out: str = "abnormal") -> DataFrame:
    lo, hi = S.range_lookup(channel, dict(ranges))
    return df.withColumn(out, S.abnormal(value, lo, hi))
