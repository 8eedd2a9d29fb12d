"""Running totals and exact quantiles without a single-partition window.

A cumulative sum in sort order is usually written as an unpartitioned window,
which moves every row into one task.  Here the ordered key is cut into value
ranges whose boundaries come from ``percentile_approx`` (a bounded array), the
window runs per range (one hash shuffle, ranges are balanced), and range
totals are turned into offsets on the small per-range table, which is
broadcast back (its size is the number of ranges, a parameter).

The result is exact: approximation only decides where the ranges are cut.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.session import cut_lineage


def running_totals(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                   partition_cols: Sequence[str] = (), descending: bool = False,
                   n_ranges: int | None = None, accuracy: int = 10000) -> DataFrame:
    """Add ``cum_<c>`` = sum of c over rows with key <= this key (>= if descending),
    ties included, within ``partition_cols``.  ``order_col`` must be numeric and
    should be distinct per partition group (aggregate first: one row per key).

    The number of ranges is the session's number of shuffle partitions unless
    given; it shapes the plan, never the result.  ``grand_<c>`` (the group total)
    is added for free from the range table.
    """
    nr = int(n_ranges or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.col(order_col).cast("double")
    okey = -key if descending else key
    work = df.withColumn("_okey", okey)
    probs = [i / nr for i in range(1, nr)]
    parts = list(partition_cols)

    # Range boundaries per partition group: bounded (len(probs) per group).
    bounds = work.groupBy(*parts).agg(F.percentile_approx("_okey", probs, accuracy).alias("_bounds"))
    if parts:
        # One row per group: bounded only by the number of groups, so no
        # broadcast hint.  Written, so that its size is known to the planner: at
        # run time a few groups would be shuffled, each a task's rows.
        work = work.join(cut_lineage(bounds), parts, "inner")
    else:
        # Materialise the subquery as a column first: subqueries may not sit
        # inside a higher-order function.
        work = work.withColumn("_bounds", bounds.scalar())
    # How many bounds lie below the key, by binary search: one comparison per level.
    work = work.withColumn("_rng", F.lit(0))
    for step in (2**k for k in reversed(range(max(1, (nr - 1).bit_length())))):
        hit = F.get("_bounds", F.col("_rng") + F.lit(step - 1)) < F.col("_okey")
        work = work.withColumn("_rng", F.col("_rng") + F.when(hit, F.lit(step)).otherwise(F.lit(0)))
    work = work.drop("_bounds")

    w = (Window.partitionBy(*parts, "_rng").orderBy("_okey")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for c in sum_cols:
        work = work.withColumn(f"_in_{c}", F.sum(c).over(w))

    # Offsets: totals of all lower ranges, computed on the small range table.
    totals = work.groupBy(*parts, "_rng").agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    wo = (Window.partitionBy(*parts).orderBy("_rng")
          .rowsBetween(Window.unboundedPreceding, -1))
    wg = Window.partitionBy(*parts)
    offsets = totals.select(*parts, "_rng", *[
        F.coalesce(F.sum(f"_tot_{c}").over(wo), F.lit(0)).alias(f"_off_{c}") for c in sum_cols], *[
        F.sum(f"_tot_{c}").over(wg).alias(f"grand_{c}") for c in sum_cols])
    # offsets has (#groups x n_ranges) rows.  Without groups it is at most
    # n_ranges rows and is broadcast; with groups it joins on (groups, range),
    # the partitioning the window already gave the big side.
    out = work.join(offsets if parts else F.broadcast(offsets), [*parts, "_rng"], "inner")
    for c in sum_cols:
        out = out.withColumn(f"cum_{c}", F.col(f"_off_{c}") + F.col(f"_in_{c}"))
    drop = ["_okey", "_rng"] + [f"_in_{c}" for c in sum_cols] + [f"_off_{c}" for c in sum_cols]
    return out.drop(*drop)


def exact_quantiles(df: DataFrame, columns: str | dict[str, Column], probs: Sequence[float],
                    n_ranges: int | None = None, accuracy: int = 10000) -> DataFrame:
    """Linear-interpolated quantiles (numpy / pandas / DuckDB ``quantile_cont``) of
    a column, or of several by name: one row per (column, prob index) with ``column, q_index,
    prob, value``.  NULL and NaN are skipped; a column without values has no rows.

    One pass brackets every quantile by approximate ones that are sure to enclose
    it and counts the values; a second counts below the bracket; only the values
    inside, about 4 / ``accuracy`` of the rows per quantile, are grouped and
    ranked.  The driver sees a few numbers per column and quantile.
    """
    columns = {columns: F.col(columns)} if isinstance(columns, str) else columns
    spark, names = df.sparkSession, list(columns)
    v = df.select(*[F.nanvl(columns[c].cast("double"), F.lit(None).cast("double")).alias(f"v{i}") for i, c in enumerate(names)])
    sides = [x for p in probs for x in (max(0.0, p - 2 / accuracy), min(1.0, p + 2 / accuracy))]
    stats = v.agg(*[e for i in range(len(names)) for e in (
        F.percentile_approx(f"v{i}", sides, accuracy).alias(f"b{i}"), F.count(f"v{i}").alias(f"n{i}"),
        F.min(f"v{i}").alias(f"lo{i}"), F.max(f"v{i}").alias(f"hi{i}"))]).first()
    ask = []  # (column number, q_index, prob, low, high, wanted position)
    for i in range(len(names)):
        for k, p in enumerate(probs if stats[f"n{i}"] else ()):
            low = stats[f"lo{i}"] if p - 2 / accuracy <= 0 else stats[f"b{i}"][2 * k]
            high = stats[f"hi{i}"] if p + 2 / accuracy >= 1 else stats[f"b{i}"][2 * k + 1]
            ask.append((i, k, float(p), low, high, (stats[f"n{i}"] - 1) * float(p)))
    if not ask:
        return spark.createDataFrame([], "column string, q_index int, prob double, value double")
    below = v.agg(*[F.count_if(F.col(f"v{i}") < F.lit(low)).alias(f"c{j}") for j, (i, _, _, low, _, _) in enumerate(ask)]).first()
    inside = F.filter(F.array(*[F.when(F.col(f"v{i}").between(low, high), F.struct(F.lit(j).alias("j"), F.col(f"v{i}").alias("x")))
                                for j, (i, _, _, low, high, _) in enumerate(ask)]), lambda s: s.isNotNull())
    counts = v.select(F.explode(inside).alias("s")).groupBy("s.j", "s.x").agg(F.count(F.lit(1)).alias("_cnt"))
    ranked = running_totals(counts, "x", ["_cnt"], partition_cols=["j"], n_ranges=n_ranges)
    table = spark.createDataFrame([(j, names[a[0]], a[1], a[2], below[f"c{j}"], a[5]) for j, a in enumerate(ask)],
                                  "j int, column string, q_index int, prob double, below long, h double")
    r = ranked.join(table, "j")
    end = F.col("below") + F.col("cum__cnt") - F.lit(1)      # last 0-based rank that the value holds
    start = end - F.col("_cnt") + F.lit(1)
    agg = r.groupBy("j", "column", "q_index", "prob", "h").agg(
        F.max(F.when(F.floor("h").between(start, end), F.col("x"))).alias("lo"),
        F.max(F.when(F.ceil("h").between(start, end), F.col("x"))).alias("hi"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("h") - F.floor("h"))
    return agg.select("column", "q_index", "prob", value.alias("value"))
