"""The exact top n groups of a column with very many values (AG-6).

Grouping by such a column shuffles a row per value and task, although all but n of
them are thrown away.  Here three passes find out first which values can be among the
top n:

1. a frequent-items sketch names some likely values, and the rows are counted per
   bucket of several hashes, a fixed number of counters;
2. the likely values are counted exactly; the n-th largest count is a lower bound of
   the n-th largest of all;
3. a value can only reach the bound if each of its buckets does, since a bucket counts
   at least the rows of any value in it.  Only the rows of such values are grouped.

The sketch and the hashes decide how much is left out of the last shuffle, never the
result: a poor bound only leaves more candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.aggregates import breakdown
from riskloom.session import cut_lineage

#: Counters per hash, and hashes.
BUCKETS, HASHES = 1 << 16, 3


def _buckets(code: Column, buckets: int, hashes: int) -> list[Column]:
    """The value's bucket under each hash; each hash has its own range of numbers."""
    return [F.pmod(F.xxhash64(F.lit(i), code), F.lit(buckets)) + F.lit(i * buckets) for i in range(hashes)]


def likely_top(df: DataFrame, code: str, n: int, tracked: int = 4096) -> list:
    """About 4 n values that a frequent-items sketch (``tracked`` counters) holds for the
    most frequent; on the driver, as they are bounded by n."""
    k = min(4 * n, tracked)
    named = df.where(F.col(code).isNotNull()).select(F.expr(f"approx_top_k(`{code}`, {k}, {tracked})").alias("t"))
    return [r["item"] for r in named.first()["t"] or []]


def count_bound(df: DataFrame, code: str, n: int, values: list) -> int:
    """A count that the n-th most frequent value reaches: the n-th largest exact count
    among ``values``; 1 if they are fewer than n."""
    counts = (df.where(F.col(code).isin(values)).groupBy(code).agg(F.count(F.lit(1)).alias("c"))
              .orderBy(F.desc("c")).limit(n).collect()) if values else []
    return counts[-1]["c"] if len(counts) == n else 1


def candidates(df: DataFrame, code: str, n: int, buckets: int = BUCKETS, hashes: int = HASHES) -> DataFrame:
    """The rows of ``df`` whose value may be among the n most frequent; of a column with
    many rare values these are few, and no row of the top n is missing.

    Bucket counts add up inside the tasks: at most ``buckets * hashes`` rows a task are
    shuffled.  The buckets that reach the bound are written once and broadcast per hash,
    at most ``buckets`` numbers each.
    """
    rows = df.where(F.col(code).isNotNull())
    bound = count_bound(rows, code, n, likely_top(rows, code, n))
    if bound <= 1:
        return rows
    numbers = _buckets(F.col(code), buckets, hashes)
    full = cut_lineage(rows.select(F.explode(F.array(*numbers)).alias("_b"))
                       .groupBy("_b").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= bound).select("_b"))
    for i, b in enumerate(numbers):
        mine = full.where(F.col("_b").between(i * buckets, (i + 1) * buckets - 1))
        rows = rows.join(F.broadcast(mine), b == F.col("_b"), "left_semi")
    return rows


def breakdown_bounded(df: DataFrame, code: str, score: str, label: str, n: int = 15, buckets: int = BUCKETS,
                      hashes: int = HASHES) -> DataFrame:
    """:func:`~riskloom.operators.aggregates.breakdown` for a code of very many values:
    the same rows, ties included, with only the candidates' rows grouped."""
    return breakdown(candidates(df, code, n, buckets, hashes), code, score, label, n)
