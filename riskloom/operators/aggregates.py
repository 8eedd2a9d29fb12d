"""Aggregations (AG-*).

Each summary is a single ``agg`` so Spark makes one pass with map-side partial
aggregation; only per-group partial buffers cross the shuffle.  Group keys
that are NULL are dropped (pandas groupby semantics).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import spec
from riskloom.functions import scalar as S
from riskloom.operators.ordered import exact_quantiles, running_totals


def _share(c: str, value) -> Column:
    """Share of rows where c == value (NULL counts as not equal)."""
    return F.avg(F.coalesce(F.col(c) == F.lit(value), F.lit(False)).cast("double"))


def _mean(c: str) -> Column:
    """pandas mean: skip NULL and NaN."""
    return F.avg(S.missing_as_null(c))


# AG-1 -----------------------------------------------------------------------
def kpis(df: DataFrame, label: str, score: str, los: str, group: str) -> DataFrame:
    """Total rows, label rate, mean score (4 dp), mean LOS (2 dp), distinct groups."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.round(_mean(label), 4).alias("label_rate"),
        F.round(_mean(score), 4).alias("avg_score"),
        F.round(_mean(los), 2).alias("avg_los"),
        F.countDistinct(group).alias("n_groups"),
    )


# AG-2 -----------------------------------------------------------------------
def tier_counts(df: DataFrame, tier: str) -> DataFrame:
    """Value counts, NULL tier dropped, largest first."""
    return (df.where(F.col(tier).isNotNull()).groupBy(tier).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), F.asc(tier)))


# AG-3 -----------------------------------------------------------------------
def tier_counts_ordered(df: DataFrame, tier: str, labels: Sequence[str] = spec.TIER_LABELS) -> DataFrame:
    """Counts in tier order; every tier present (absent tier -> 0)."""
    spark = df.sparkSession
    spine = spark.createDataFrame([(i, lab) for i, lab in enumerate(labels)], "tier_rank int, tier string")
    counts = df.where(F.col(tier).isNotNull()).groupBy(F.col(tier).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
    return (spine.join(counts, "tier", "left")   # spine is len(labels) rows; counts is len(labels) rows
            .select("tier_rank", "tier", F.coalesce("n", F.lit(0)).alias("n"))
            .orderBy("tier_rank"))


# AG-4 -----------------------------------------------------------------------
def group_summary(df: DataFrame, group: str, score: str, label: str, los: str, tier: str,
                  share_tiers: Sequence[str] = ("Critical", "High")) -> DataFrame:
    """Per group: n, mean score, label rate, mean LOS, share of selected tiers."""
    shares = [F.round(_share(tier, t), 4).alias(f"pct_{t.lower()}") for t in share_tiers]
    return (df.where(F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(_mean(score), 4).alias("avg_score"),
        F.round(_mean(label), 4).alias("label_rate"),
        F.round(_mean(los), 2).alias("avg_los"),
        *shares))


# AG-5 -----------------------------------------------------------------------
def group_mean_count(df: DataFrame, group: str, value: str) -> DataFrame:
    return (df.where(F.col(group).isNotNull()).groupBy(group)
            .agg(F.round(_mean(value), 4).alias("avg_value"), F.count(F.lit(1)).alias("n")))


# AG-6 -----------------------------------------------------------------------
def breakdown(df: DataFrame, code: str, score: str, label: str, n: int = 15) -> DataFrame:
    """Count, mean score, label rate per code; top n by count (code breaks ties)."""
    return (df.where(F.col(code).isNotNull()).groupBy(code).agg(
        F.count(F.lit(1)).alias("count"),
        F.round(_mean(score), 4).alias("avg_score"),
        F.round(_mean(label), 4).alias("label_rate"))
        .orderBy(F.desc("count"), F.asc(code)).limit(n))


# AG-7 -----------------------------------------------------------------------
def histogram_edges(bins: int = spec.HIST_BINS, lo: float = spec.HIST_LO, hi: float = spec.HIST_HI) -> list[float]:
    """Equal-width edges as numpy's linspace builds them (i*step + lo, last = hi)."""
    step = (hi - lo) / bins
    return [i * step + lo for i in range(bins)] + [float(hi)]


def histogram(df: DataFrame, c: str, bins: int = spec.HIST_BINS, lo: float = spec.HIST_LO,
              hi: float = spec.HIST_HI) -> DataFrame:
    """Fixed-edge histogram: left-closed bins, last bin closed, outside values
    dropped, empty bins kept; edges compared as an explicit array."""
    edges = histogram_edges(bins, lo, hi)
    inner = F.array(*[F.lit(e) for e in edges[1:-1]])
    v = S.missing_as_null(c)
    binned = (df.select(v.alias("_v"))
              .where((F.col("_v") >= F.lit(edges[0])) & (F.col("_v") <= F.lit(edges[-1])))
              .select(F.size(F.filter(inner, lambda e: e <= F.col("_v"))).alias("bin")))
    counts = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("count"))
    spine = df.sparkSession.createDataFrame(
        [(i, round(edges[i], 2)) for i in range(bins)], "bin int, bin_start double")
    return (spine.join(counts, "bin", "left")
            .select("bin", "bin_start", F.coalesce("count", F.lit(0)).alias("count")).orderBy("bin"))


# AG-8 -----------------------------------------------------------------------
def quantile_buckets(df: DataFrame, c: str, q: int = 10, digits: int = 4) -> DataFrame:
    """qcut: edges = exact quantiles at 0, 1/q, ..., 1; duplicate edges dropped;
    right-closed buckets, lowest value included; count per bucket."""
    rows = exact_quantiles(df, {c: F.col(c)}, [i / q for i in range(q + 1)]).collect()  # q + 1 numbers
    edges = sorted({r["value"] for r in rows})
    v = S.missing_as_null(c)
    n_buckets = max(0, len(edges) - 1)
    bucket = F.lit(0)
    for e in edges[1:-1]:
        bucket = bucket + (F.col("_v") > F.lit(e)).cast("int")
    counts = (df.select(v.alias("_v")).where(F.col("_v").isNotNull()).groupBy(bucket.alias("bucket"))
              .agg(F.count(F.lit(1)).alias("n")))
    bounds = df.sparkSession.createDataFrame([(i, float(edges[i]), float(edges[i + 1])) for i in range(n_buckets)],
                                             "bucket int, lo double, hi double")
    return (bounds.join(counts, "bucket", "left")
            .select("bucket", F.round("lo", digits).alias("lo"), F.round("hi", digits).alias("hi"),
                    F.coalesce("n", F.lit(0)).alias("n")).orderBy("bucket"))


# AG-9 -----------------------------------------------------------------------
def class_balance(df: DataFrame, label: str) -> DataFrame:
    """Positive rate and negative/positive ratio (the positive class weight)."""
    lab = F.col(label)
    pos = F.sum(F.when(lab == 1, 1).otherwise(0))
    neg = F.sum(F.when(lab == 0, 1).otherwise(0))
    return df.where(lab.isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"),
        F.round(F.avg(lab.cast("double")), 6).alias("positive_rate"),
        F.round(F.try_divide(neg.cast("double"), pos.cast("double")), 6).alias("neg_pos_ratio"))


# AG-10 ----------------------------------------------------------------------
def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """'balanced' weights n / (k * n_class) attached per row.

    Per-class weights are one row per class and broadcast: a shuffle by the label
    would make a task of each class.  Rows without a label get no weight.
    """
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    weights = counts.select(label, (F.sum("_nc").over(w) / (F.count(F.lit(1)).over(w) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(weights), label, "left")


# AG-11 ----------------------------------------------------------------------
def medians(df: DataFrame, cols: Sequence[str], exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """Interpolated median of each column, one row (column name -> median).

    exact=True ranks only the values near the median (see ``exact_quantiles``);
    exact=False uses percentile_approx in one pass.
    """
    if not exact:
        return df.agg(*[F.percentile_approx(S.missing_as_null(c), 0.5, accuracy).cast("double").alias(c)
                        for c in cols])
    q = exact_quantiles(df, {c: F.col(c) for c in cols}, [0.5])
    return q.groupBy().pivot("column", list(cols)).agg(F.first("value")).select(*cols)


# AG-13 ----------------------------------------------------------------------
def cv_summary(df: DataFrame, group: str, metric: str, digits: int = 4) -> DataFrame:
    """Mean and population std of a metric per group (numpy default ddof=0)."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.round(F.avg(metric), digits).alias("mean"),
        F.round(F.stddev_pop(metric), digits).alias("std"))


# AG-14 / AG-15 ---------------------------------------------------------------
def score_counts(df: DataFrame, label: str, score: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups..., score, tp, fp): positives and negatives per distinct score; rows
    with a missing score (NULL or NaN) or label are left out."""
    lab = F.col(label).cast("int")
    return (df.where(S.missing_as_null(score).isNotNull() & lab.isNotNull())
            .groupBy(*group_cols, F.col(score).cast("double").alias("_s"))
            .agg(F.sum(F.when(lab == 1, 1).otherwise(0)).cast("long").alias("tp"),
                 F.sum(F.when(lab == 1, 0).otherwise(1)).cast("long").alias("fp")))


def _maybe_round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def auc(df: DataFrame, label: str, score: str, digits: int | None = 6,
        group_cols: Sequence[str] = ()) -> DataFrame:
    """Exact ROC AUC with ties counted half (per group if ``group_cols``).

    AUC = sum_s fp_s * (TP_above(s) + tp_s / 2) / (P * N), over distinct
    scores; running totals are distributed (see ordered.running_totals).
    """
    g = list(group_cols)
    sc = score_counts(df, label, score, g)
    run = running_totals(sc, "_s", ["tp"], partition_cols=g, descending=True)
    above = F.col("cum_tp") - F.col("tp")
    value = F.sum(F.col("fp").cast("double") * (above + F.col("tp") / F.lit(2.0))) / (F.sum("tp").cast("double") * F.sum("fp").cast("double"))
    return run.groupBy(*g).agg(_maybe_round(value, digits).alias("auc"))


def average_precision(df: DataFrame, label: str, score: str, digits: int | None = 6,
                      group_cols: Sequence[str] = ()) -> DataFrame:
    """AP = sum_s (R_s - R_prev) * P_s over distinct thresholds (step sum)."""
    g = list(group_cols)
    sc = score_counts(df, label, score, g)
    run = running_totals(sc, "_s", ["tp", "fp"], partition_cols=g, descending=True)
    precision = F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))
    value = F.sum(F.col("tp") * precision) / F.sum("tp")
    return run.groupBy(*g).agg(_maybe_round(value, digits).alias("average_precision"))


def auc_ap(df: DataFrame, label: str, score: str, digits: int | None = 6,
           group_cols: Sequence[str] = ()) -> DataFrame:
    """AUC and average precision from one pass of running totals."""
    g = list(group_cols)
    sc = score_counts(df, label, score, g)
    run = running_totals(sc, "_s", ["tp", "fp"], partition_cols=g, descending=True)
    above = F.col("cum_tp") - F.col("tp")
    auc_v = F.sum(F.col("fp").cast("double") * (above + F.col("tp") / F.lit(2.0))) / (F.sum("tp").cast("double") * F.sum("fp").cast("double"))
    ap_v = F.sum(F.col("tp") * (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp")))) / F.sum("tp")
    return run.groupBy(*g).agg(_maybe_round(auc_v, digits).alias("auc"),
                               _maybe_round(ap_v, digits).alias("average_precision"))


# AG-16 ----------------------------------------------------------------------
def profile(df: DataFrame, groups: dict[str, Sequence[str]], label: str | None = None) -> DataFrame:
    """Rows, columns, columns per named group, positives of the label (one row)."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    aggs += [F.lit(len(cols)).alias(f"n_{g}") for g, cols in groups.items()]
    if label:
        aggs.append(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).cast("long").alias("n_positive"))
    return df.agg(*aggs)


# AG-17 ----------------------------------------------------------------------
def constraint_audit(df: DataFrame, pk: Sequence[str], not_null: Sequence[str] = (),
                     max_len: dict[str, int] | None = None, unique: Sequence[str] = ()) -> DataFrame:
    """Violations of a declared key, NOT NULL columns, VARCHAR(n) lengths and
    UNIQUE columns.

    One row: duplicate key groups, rows in them, NULL keys, one count per NOT NULL
    and max-length rule, and per UNIQUE column the values held by several rows
    (NULLs are not compared, as in SQL).
    """
    keyed = df.groupBy(*pk).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.count_if(F.col(c).isNull()).alias(f"_nn_{i}") for i, c in enumerate(not_null)],
        *[F.count_if(F.length(F.col(c).cast("string")) > F.lit(n)).alias(f"_tl_{i}")
          for i, (c, n) in enumerate((max_len or {}).items())])
    null_key = F.lit(False)
    for k in pk:
        null_key = null_key | F.col(k).isNull()
    dup = (F.col("_n") > 1) & ~null_key
    out = keyed.agg(
        F.count_if(dup).alias("dup_keys"),
        F.coalesce(F.sum(F.when(dup, F.col("_n"))), F.lit(0)).cast("long").alias("dup_rows"),
        F.coalesce(F.sum(F.when(null_key, F.col("_n"))), F.lit(0)).cast("long").alias("null_keys"),
        *[F.coalesce(F.sum(f"_nn_{i}"), F.lit(0)).cast("long").alias(f"null_{c}") for i, c in enumerate(not_null)],
        *[F.coalesce(F.sum(f"_tl_{i}"), F.lit(0)).cast("long").alias(f"toolong_{c}")
          for i, c in enumerate(max_len or {})])
    for c in unique:
        held = df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
        out = out.withColumn(f"notunique_{c}", held.agg(F.count_if(F.col("_n") > 1)).scalar())
    return out
