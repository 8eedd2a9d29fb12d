"""Scalar column functions (SC-*): pure Column -> Column, all JVM-side.

Every function returns a Column expression, so it stays inside whole-stage
codegen and composes into one projection.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom import spec


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_as_null(c: str | Column) -> Column:
    """NaN -> NULL for doubles, so comparisons treat NaN as missing.

    Spark (and DuckDB) order NaN above every number, so ``NaN > t`` is TRUE;
    pandas gives False.  ``nanvl`` folds NaN into NULL first.
    """
    c = col(c).cast("double")
    return F.nanvl(c, F.lit(None).cast("double"))


def is_floating(df, c: str) -> bool:
    return df.schema[c].dataType.typeName() in ("float", "double")


def order_key(df, c: str) -> Column:
    """The column to sort by: NaN counts as NULL, so that it is last with it."""
    return missing_as_null(c) if is_floating(df, c) else F.col(c)


# SC-3 -----------------------------------------------------------------------
def safe_ratio(a, b, eps: float = spec.DERIVE_EPS) -> Column:
    """a / (b + eps); NULL (not an error) when the denominator is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double") + F.lit(eps))


# SC-4 -----------------------------------------------------------------------
def difference(a, b) -> Column:
    return col(a).cast("double") - col(b).cast("double")


def product(a, b) -> Column:
    return col(a).cast("double") * col(b).cast("double")


def total(a, b) -> Column:
    return col(a).cast("double") + col(b).cast("double")


# SC-5 -----------------------------------------------------------------------
def flag(c, op: str, threshold: float) -> Column:
    """Strict threshold flag as int; missing (NULL or NaN) -> 0."""
    v = missing_as_null(c)
    cond = v > F.lit(threshold) if op == "gt" else v < F.lit(threshold)
    return F.coalesce(cond, F.lit(False)).cast("int")


def threshold_flags(spec_items: Iterable[tuple[str, str, str, float]]) -> list[Column]:
    """[(name, column, 'gt'|'lt', threshold)] -> aliased int flags."""
    return [flag(c, op, t).alias(name) for name, c, op, t in spec_items]


# SC-6 -----------------------------------------------------------------------
def clip(c, lo, hi) -> Column:
    """Clamp into [lo, hi]; NULL and NaN pass through (as numpy does).

    least/greatest skip NULL and rank NaN highest, so unguarded they would
    turn a missing value into the upper bound.
    """
    c = col(c)
    clamped = c
    if hi is not None:
        clamped = F.least(clamped, hi if isinstance(hi, Column) else F.lit(hi))
    if lo is not None:
        clamped = F.greatest(clamped, lo if isinstance(lo, Column) else F.lit(lo))
    return F.when(c.isNull() | F.isnan(c), c).otherwise(clamped)


# SC-7 -----------------------------------------------------------------------
def tier(score, edges: Sequence[float] = spec.TIER_EDGES, labels: Sequence[str] = spec.TIER_LABELS,
         closed: str = "right") -> Column:
    """Label by interval.

    closed='right': (e0, e1], (e1, e2], ...; values outside (e0, eN] -> NULL
    (training rule).  closed='left': >= e_k picks the highest k, the last
    label also takes everything above (serving rule: >= .75 is Critical).
    """
    s = missing_as_null(score)
    if closed == "right":
        expr = None
        for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
            cond = (s > F.lit(lo)) & (s <= F.lit(hi))
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        return expr
    if closed == "left":
        expr = None
        for lo, lab in reversed(list(zip(edges[:-1], labels))):
            cond = s >= F.lit(lo)
            expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
        # Below the first edge is still the lowest label (serving has no floor).
        return expr.when(s.isNotNull(), F.lit(labels[0]))
    raise ValueError("closed must be 'right' or 'left'")


def tier_rank(tier_col, labels: Sequence[str] = spec.TIER_LABELS) -> Column:
    """Position of a tier label in the tier order (0-based), NULL if unknown."""
    m = F.create_map(*[x for i, lab in enumerate(labels) for x in (F.lit(lab), F.lit(i))])
    return m[col(tier_col)]


# SC-8 -----------------------------------------------------------------------
def blend(cols: Sequence, weights: Sequence[float] = spec.BLEND_WEIGHTS) -> Column:
    expr = None
    for c, w in zip(cols, weights):
        term = F.lit(w) * col(c).cast("double")
        expr = term if expr is None else expr + term
    return expr


# SC-9 -----------------------------------------------------------------------
def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def scorecard(terms: Sequence[tuple], intercept: float = spec.SCORECARD_INTERCEPT) -> Column:
    """Additive log-odds then sigmoid.

    Term kinds: ('linear', col, coef, center), ('log1p', col, coef),
    ('hinge_up', col, coef, knot) = coef*max(x-knot, 0),
    ('hinge_down', col, coef, knot) = coef*min(x-knot, 0),
    ('is', col, coef, value) = coef*[x == value].

    A missing number (NULL or NaN) gives NULL, whatever the term; a missing
    category is no match.
    """
    z = F.lit(float(intercept))
    for t in terms:
        kind, c, coef = t[0], missing_as_null(t[1]) if t[0] != "is" else col(t[1]), float(t[2])
        if kind == "linear":
            center = float(t[3]) if len(t) > 3 else 0.0
            z = z + F.lit(coef) * (c - F.lit(center))
        elif kind == "log1p":
            z = z + F.lit(coef) * F.log1p(c)
        elif kind == "hinge_up":
            z = z + F.lit(coef) * F.when(c.isNotNull(), F.greatest(c - F.lit(float(t[3])), F.lit(0.0)))
        elif kind == "hinge_down":
            z = z + F.lit(coef) * F.when(c.isNotNull(), F.least(c - F.lit(float(t[3])), F.lit(0.0)))
        elif kind == "is":
            z = z + F.lit(coef) * F.coalesce(c == F.lit(t[3]), F.lit(False)).cast("double")
        else:
            raise ValueError(f"unknown scorecard term {kind}")
    return sigmoid(z)


# SC-12 ----------------------------------------------------------------------
def coerce_numeric(c) -> Column:
    """Numeric-looking text -> double; empty / non-numeric -> NULL (raw kept by caller)."""
    return F.nullif(F.trim(col(c).cast("string")), F.lit("")).try_cast("double")


# SC-13 ----------------------------------------------------------------------
def top_abs(arr, n: int, name_field: str = "feature", value_field: str = "value",
            digits: int = 4) -> Column:
    """Sort an array<struct<name, value>> by |value| desc (name asc on ties),
    keep n, round, and label the direction.

    The sort key is a struct (-|value|, name) under the natural ordering, so
    no comparator lambda is evaluated per pair.
    """
    keyed = F.transform(col(arr), lambda e: F.struct((-F.abs(e[value_field])).alias("k"),
                                                     e[name_field].alias("n"), e[value_field].alias("v")))
    return F.transform(
        F.slice(F.array_sort(keyed), 1, n),
        lambda e: F.struct(
            e["n"].alias(name_field),
            F.round(e["v"], digits).alias("shap_value"),
            F.when(e["v"] > 0, F.lit(spec.DIRECTION_UP)).otherwise(F.lit(spec.DIRECTION_DOWN)).alias("direction"),
        ),
    )


# SC-14 ----------------------------------------------------------------------
def abnormal(v, lo, hi) -> Column:
    """Outside the inclusive normal range; missing -> not abnormal."""
    v = missing_as_null(v)
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.coalesce((v < lo) | (v > hi), F.lit(False))


def range_lookup(channel, ranges: dict[str, tuple[float, float]]) -> tuple[Column, Column]:
    """(lo, hi) columns for a channel name from a literal map (no join)."""
    lo = F.create_map(*[x for k, (a, _) in ranges.items() for x in (F.lit(k), F.lit(float(a)))])
    hi = F.create_map(*[x for k, (_, b) in ranges.items() for x in (F.lit(k), F.lit(float(b)))])
    return lo[col(channel)], hi[col(channel)]


# SC-15 ----------------------------------------------------------------------
def round_n(c, n: int) -> Column:
    """HALF_UP rounding (Python/DuckDB behaviour; numpy's half-even is bround)."""
    return F.round(col(c), n)


# SC-16 / SC-17 -------------------------------------------------------------
def code_list(text, sep: str = ",") -> Column:
    return F.split(col(text), F.lit(sep))


def code_list_size(text, sep: str = ",") -> Column:
    return F.when(col(text).isNull(), F.lit(None)).otherwise(F.size(code_list(text, sep)))


def code_list_join(arr, sep: str = ",") -> Column:
    return F.concat_ws(sep, col(arr))


def exclude_from_list(arr, value) -> Column:
    value = value if isinstance(value, Column) else F.lit(value)
    return F.array_remove(col(arr), value)


# SC-18 / SC-19 -------------------------------------------------------------
def format_id(prefix: str, width: int, n) -> Column:
    return F.format_string(f"{prefix}%0{width}d", col(n).cast("long"))


def grid_point(i) -> tuple[Column, Column]:
    """Synthetic (lat, lon) for integer i: 25 + (3.1 i mod 25), -125 + (4.7 i mod 55)."""
    i = col(i).cast("double")
    return F.lit(25.0) + (i * F.lit(3.1)) % F.lit(25.0), F.lit(-125.0) + (i * F.lit(4.7)) % F.lit(55.0)


# SC-20 ----------------------------------------------------------------------
def epoch_to_ts(sec) -> Column:
    """Float epoch seconds -> timestamp (microsecond precision)."""
    return F.timestamp_micros(F.round(col(sec).cast("double") * F.lit(1_000_000)).cast("long"))


def ts_to_epoch(ts) -> Column:
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1_000_000.0)


# SC-21 ----------------------------------------------------------------------
def pct_of_cap(v, cap: float | None) -> Column:
    a = F.abs(col(v).cast("double"))
    return a if cap is None else F.least(F.lit(1.0), a / F.lit(cap))


# SC-23 ----------------------------------------------------------------------
def percent_label(x, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(col(x).cast("double") * F.lit(100.0), digits))


def percent_value(x, digits: int = 1) -> Column:
    return F.round(col(x).cast("double") * F.lit(100.0), digits)


# SC-28 ----------------------------------------------------------------------
def decode(c, mapping: dict, default=None) -> Column:
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    out = m[col(c).cast("string")]
    return out if default is None else F.coalesce(out, F.lit(default))


# SC-22 / SC-25 / SC-26 / SC-27 ---------------------------------------------
def to_explanation_json(arr) -> Column:
    return F.to_json(col(arr))


def from_explanation_json(text, schema: str = "array<struct<feature:string,shap_value:double,direction:string>>") -> Column:
    return F.from_json(col(text), schema)


def zip_series(*arrays) -> Column:
    return F.arrays_zip(*[col(a) for a in arrays])


# SC-26 / SC-27: responses built from small tables -------------------------------
def counts_as_map(counts, key: str, value: str):
    """One row: map of key -> value from a table of one row per group, keys ascending."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return counts.agg(F.map_from_entries(pairs).alias("counts"))


def records(df, cols: Sequence[str], out: str = "record") -> Column:
    """Each row as a JSON object of the given columns (NULLs kept)."""
    return F.to_json(F.struct(*[F.col(c) for c in cols]), {"ignoreNullFields": "false"}).alias(out)


def series_as_arrays(df, order: str, cols: Sequence[str]):
    """One row: every column of a small ordered table as an array in its order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *[F.col(c) for c in cols])))
    return df.agg(rows.alias("_r")).select(*[F.col(f"_r.{c}").alias(c) for c in cols])
