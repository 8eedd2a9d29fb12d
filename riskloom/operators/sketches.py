"""Counts, quantiles and distinct counts that are kept per batch and merged (AG-1, AG-8,
AG-11 where the input only grows).

The exact operators read all rows again whenever some are added.  These are for opt-in
use beside them: a batch is read once, its sketches are one row per group, and any set
of batches is answered by merging rows.  Ranks of quantiles are off by at most
:func:`rank_error` (with 99 % confidence), distinct counts by about 1.04 / 2^(lg_k / 2);
counts, sums, minima and maxima are exact.  A batch overwrites its own partition, so a
batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import scalar as S

#: Sizes of the quantile and distinct sketches.
KLL_K, HLL_LG_K = 800, 12


def rank_error(k: int = KLL_K) -> float:
    """Bound of a quantile's rank error, as a share of the rows; k is the sketch size."""
    return 2.296 / k**0.9723


def batch_sketches(df: DataFrame, values: Sequence[str], distinct: Sequence[str] = (), by: Sequence[str] = (),
                   k: int = KLL_K) -> DataFrame:
    """One row per group: n, and per value column count, sum, least, greatest and a
    quantile sketch, per distinct column a sketch of its values.  NULL and NaN are left
    out of a column's figures."""
    made = [F.count(F.lit(1)).alias("n")]
    for c in values:
        v = S.missing_as_null(c)
        made += [F.count(v).alias(f"{c}_n"), F.sum(v).alias(f"{c}_sum"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max"),
                 F.kll_sketch_agg_double(v, F.lit(k)).alias(f"{c}_kll")]
    made += [F.hll_sketch_agg(F.col(c).cast("string"), F.lit(HLL_LG_K)).alias(f"{c}_hll") for c in distinct]
    return df.groupBy(*by).agg(*made)


def write_batch(sketches: DataFrame, path: str, batch_id: int) -> None:
    sketches.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def merged(spark: SparkSession, path: str, values: Sequence[str], distinct: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """The sketches of all batches below ``path``, merged per group; the same columns."""
    return merge(spark.read.parquet(path).drop("batch_id"), values, distinct, by)


def merge(sketches: DataFrame, values: Sequence[str], distinct: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    out = [F.sum("n").alias("n")]
    for c in values:
        out += [F.sum(f"{c}_n").alias(f"{c}_n"), F.sum(f"{c}_sum").alias(f"{c}_sum"), F.min(f"{c}_min").alias(f"{c}_min"),
                F.max(f"{c}_max").alias(f"{c}_max"), F.kll_merge_agg_double(f"{c}_kll").alias(f"{c}_kll")]
    out += [F.hll_union_agg(f"{c}_hll").alias(f"{c}_hll") for c in distinct]
    return sketches.groupBy(*by).agg(*out)


def quantiles(sketches: DataFrame, column: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by..., prob, value) from merged sketches; a group without values has none."""
    some = sketches.where(F.col(f"{column}_n") > 0)
    found = F.array(*[F.struct(F.lit(float(p)).alias("prob"), F.kll_sketch_get_quantile_double(F.col(f"{column}_kll"), F.lit(float(p))).alias("value"))
                      for p in probs])
    return some.select(*by, F.explode(found).alias("q")).select(*by, "q.prob", "q.value")


def summary(sketches: DataFrame, values: Sequence[str], distinct: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """n, means, least and greatest values, medians and distinct counts."""
    out = [F.col("n")]
    for c in values:
        median = F.when(F.col(f"{c}_n") > 0, F.kll_sketch_get_quantile_double(F.col(f"{c}_kll"), F.lit(0.5)))
        out += [(F.col(f"{c}_sum") / F.col(f"{c}_n")).alias(f"{c}_mean"), F.col(f"{c}_min"), F.col(f"{c}_max"), median.alias(f"{c}_median")]
    out += [F.hll_sketch_estimate(f"{c}_hll").alias(f"{c}_distinct") for c in distinct]
    return sketches.select(*by, *out)
