"""Projections (PR-*), filters (FI-*) and joins (JO-*).

All of these are logical-plan builders: they return a lazily planned DataFrame
so Catalyst can push filters into the Parquet scan and prune columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S


# --------------------------------------------------------------------------
# Projections
# --------------------------------------------------------------------------
def project(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """PR-1: keep the listed columns in order."""
    return df.select(*cols)


def project_except(df: DataFrame, drop: Sequence[str]) -> DataFrame:
    """PR-2: all columns except ``drop`` (case-insensitive, as Spark resolves names)."""
    dropset = {c.lower() for c in drop}
    return df.select(*[c for c in df.columns if c.lower() not in dropset])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """PR-3: rename columns."""
    return df.withColumnsRenamed(dict(mapping))


def cast_all(df: DataFrame, cols: Sequence[str], dtype: str = "float") -> DataFrame:
    """PR-4: cast the listed columns, keep the others."""
    cset = set(cols)
    return df.select(*[F.col(c).cast(dtype).alias(c) if c in cset else F.col(c) for c in df.columns])


def assemble_array(df: DataFrame, feature_names: Sequence[str], out: str = "features",
                   keep: Sequence[str] = (), dtype: str = "float") -> DataFrame:
    """PR-5: features in the exact saved order, absent column or NULL -> 0.0.

    Emitted as array<float>; :func:`riskloom.models.gbt.to_vector` turns it into
    an ML vector for MLlib.
    """
    present = set(df.columns)
    items = [F.coalesce(F.col(f).cast(dtype), F.lit(0.0).cast(dtype)) if f in present
             else F.lit(0.0).cast(dtype) for f in feature_names]
    return df.select(*keep, F.array(*items).alias(out))


# --------------------------------------------------------------------------
# Filters
# --------------------------------------------------------------------------
def filter_optional(df: DataFrame, eq: Mapping[str, object]) -> DataFrame:
    """FI-1: equality filters; a falsy value (None, '', 0) means "no filter"."""
    for c, v in eq.items():
        if v:
            df = df.where(F.col(c) == F.lit(v))
    return df


def filter_range(df: DataFrame, c: str, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """FI-2: inclusive bounds; only None disables a bound (0.0 is a bound).
    A missing value (NULL or NaN) is outside every bound."""
    if lo is not None:
        df = df.where(F.col(c) >= F.lit(lo))
        if S.is_floating(df, c):
            df = df.where(~F.isnan(c))  # NaN sorts above every number
    if hi is not None:
        df = df.where(F.col(c) <= F.lit(hi))
    return df


def lookup(df: DataFrame, key: str, value, order_by: Sequence[str] | None = None) -> DataFrame:
    """FI-3: first row for ``key == value`` (first by ``order_by``); empty if absent."""
    hit = df.where(F.col(key) == F.lit(value))
    if order_by:
        hit = hit.orderBy(*order_by)
    return hit.limit(1)


def top_of_tier(df: DataFrame, tier_col: str, tier: str, score: str, n: int,
                tiebreak: Sequence[str] = ()) -> DataFrame:
    """FI-4: the n highest scores inside one tier (TakeOrderedAndProject)."""
    return (df.where(F.col(tier_col) == F.lit(tier))
            .orderBy(F.desc_nulls_last(S.order_key(df, score)), *[F.asc(c) for c in tiebreak]).limit(n))


def abnormal_only(df: DataFrame, value: str, channel: str,
                  ranges: Mapping[str, tuple[float, float]]) -> DataFrame:
    """FI-5: rows whose reading is outside its channel's inclusive normal range."""
    lo, hi = S.range_lookup(channel, dict(ranges))
    return df.where(S.abnormal(value, lo, hi))


# --------------------------------------------------------------------------
# Joins
# --------------------------------------------------------------------------
def assemble_entities(core: DataFrame, parts: Sequence[DataFrame], on: str | Sequence[str]) -> DataFrame:
    """JO-1: glue column groups of the same entity by key (inner equi-joins)."""
    out = core
    for p in parts:
        out = out.join(p, on, "inner")
    return out


def join_dimension(df: DataFrame, dim: DataFrame, on: str, defaults: Mapping[str, object] | None = None,
                   key_default: Mapping[str, str] | None = None) -> DataFrame:
    """JO-2: left join a dimension with per-column fallbacks.

    No join hint: the optimizer broadcasts a dimension whose size in bytes is
    under its threshold and shuffles a larger one.

    ``defaults``: column -> literal when the key is absent from ``dim``;
    ``key_default``: column -> use the key itself (as string) when absent.
    """
    out = df.join(dim, on, "left")
    cols = []
    for c in out.columns:
        if defaults and c in defaults:
            cols.append(F.coalesce(F.col(c), F.lit(defaults[c])).alias(c))
        elif key_default and c in key_default:
            cols.append(F.coalesce(F.col(c), F.col(key_default[c]).cast("string")).alias(c))
        else:
            cols.append(F.col(c))
    return out.select(*cols)


def map_codes(df: DataFrame, code: str, dim: DataFrame, dim_key: str,
              label_col: str, unknown: str = "Unknown") -> DataFrame:
    """JO-3: code -> label (and any other dimension attributes); 'Unknown' fallback."""
    d = dim.withColumnRenamed(dim_key, "_code_key")
    out = df.join(d, F.col(code) == F.col("_code_key"), "left").drop("_code_key")
    return out.withColumn(label_col, F.coalesce(F.col(label_col), F.lit(unknown)))


def with_defaults(payload: DataFrame, base: DataFrame, cols: Sequence[str]) -> DataFrame:
    """JO-4 / SC-11: overlay payload on one base row.

    Payload values win; a NULL or absent payload column takes the base row's
    value.  The base row is one row by construction (``limit(1)``), fetched
    once and applied as typed literals: no cross join, no per-column job.
    """
    types = {f.name: f.dataType for f in base.schema.fields}
    row = base.select(*cols).limit(1).collect()
    values = row[0].asDict() if row else {c: None for c in cols}
    present = set(payload.columns)
    out = []
    for c in cols:
        b = F.lit(values[c]).cast(types[c])
        out.append((F.coalesce(F.col(c), b) if c in present else b).alias(c))
    extra = [c for c in payload.columns if c not in set(cols)]
    return payload.select(*extra, *out)


def overlay(payload: DataFrame, table: DataFrame, cols: Sequence[str], mode: str = "row",
            order_by: Sequence[str] | None = None) -> DataFrame:
    """SC-11: fill absent/NULL payload columns from an explicit defaults row.

    mode='row': the first row of ``table`` (by ``order_by``), as the serving
    code does; mode='median': the interpolated median of each (numeric)
    column of ``table``, as its docstring promises.
    """
    if mode == "row":
        base = table.orderBy(*order_by) if order_by else table
        return with_defaults(payload, base.limit(1), cols)
    if mode == "median":
        from riskloom.operators.aggregates import medians
        return with_defaults(payload, medians(table, cols), cols)
    raise ValueError("mode must be 'row' or 'median'")


def attach_scores(rows: DataFrame, scores: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """PR-6: every row with the columns of its scores, which replace columns of
    the same name; rows without a score keep NULLs."""
    keys = {on} if isinstance(on, str) else set(on)
    return rows.drop(*[c for c in scores.columns if c not in keys]).join(scores, on, "left")


def select_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """JO-5: rows whose key appears in ``keys`` (left semi join)."""
    return df.join(keys, on, "left_semi")


def orphans(child: DataFrame, parent: DataFrame, on: str | Sequence[str] | Column) -> DataFrame:
    """JO-6: child rows without a parent (left anti join)."""
    return child.join(parent, on, "left_anti")
