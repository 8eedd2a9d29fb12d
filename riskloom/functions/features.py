"""Feature derivation (SC-1, SC-2, SC-10, SC-24).

One function serves training and scoring, so the two can never drift: the
same ``FeatureSpec`` gives the same columns in the same order, derived in
double precision from the stored values and cast to float last.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import scalar as S
from riskloom.session import cut_lineage
from riskloom.spec import Derived, FeatureSpec


# SC-1 -----------------------------------------------------------------------
def vocabulary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value): the distinct non-null values, as a table."""
    pairs = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p"))
    return pairs.select("p.*").where(F.col("value").isNotNull()).distinct()


def learn_vocabulary(df: DataFrame, cols: Sequence[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null values per column, in one distributed pass.

    The values become column names of the result, so as many strings as the
    result has columns are on the driver.  For vocabularies that are too wide for
    columns, :func:`dictionary` and :func:`encode` keep them a table.
    """
    vocab: dict[str, list[str]] = {c: [] for c in cols}
    for r in vocabulary(df, cols).collect():
        vocab[r["column"]].append(r["value"])
    return {c: sorted(v) for c, v in vocab.items()}


def one_hot_sparse(df: DataFrame, cols: Sequence[str], row_id: str) -> DataFrame:
    """(row_id, column, value): the indicators that are 1, one row each, for
    vocabularies of any size; nothing is collected and no column is added."""
    pairs = df.select(row_id, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p"))
    return pairs.select(row_id, "p.*").where(F.col("value").isNotNull())


def dictionary(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(column, value, index): the vocabulary with the position that the value's column
    has in :func:`one_hot`, from 0, columns in the given order and values sorted.

    Positions are ranks by ranges of the sorted vocabulary, so a vocabulary of any size
    is neither collected nor sorted in one task.
    """
    from riskloom.operators.windows import global_rank
    place = F.create_map(*[x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i))])
    words = vocabulary(df, cols).withColumn("_c", place[F.col("column")])
    ranked = global_rank(words, [F.asc("_c"), F.asc("value")], "_rank")
    return ranked.select("column", "value", (F.col("_rank") - 1).alias("index"))


def encode(df: DataFrame, cols: Sequence[str], row_id: str, words: DataFrame) -> DataFrame:
    """(row_id, indices): per row the sorted positions of its values in ``words``, a
    :func:`dictionary`; an unseen or missing value has none.  ``row_id`` is unique.

    Only (row_id, column, value) moves.  The dictionary holds a value once, so a value
    of a third of all rows is split by adaptive execution as any skewed join.
    """
    hits = one_hot_sparse(df, cols, row_id).join(words, ["column", "value"]).select(F.col(row_id).alias("_r"), "index")
    lists = hits.groupBy("_r").agg(F.array_sort(F.collect_list("index")).alias("indices"))
    rows = df.select(row_id).join(lists, F.col(row_id) == F.col("_r"), "left")
    return rows.select(row_id, F.coalesce("indices", F.array().cast("array<int>")).alias("indices"))


def sparse_vectors(encoded: DataFrame, size: int, out: str = "features") -> DataFrame:
    """The positions as MLlib vectors of ``size`` components that are 1 there."""
    @F.udf(VectorUDT())
    def vector(at):
        return Vectors.sparse(size, at, [1.0] * len(at))

    return encoded.withColumn(out, vector("indices")).drop("indices")


def one_hot_columns(vocab: Mapping[str, Sequence[str]], dtype: str = "int") -> list[Column]:
    """SC-2: indicator per saved value, named col_value; unseen/NULL -> all zeros."""
    return [F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast(dtype).alias(f"{c}_{v}")
            for c, vals in vocab.items() for v in vals]


def one_hot(df: DataFrame, cols: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """SC-1: learn the vocabulary, then add one indicator column per value."""
    vocab = learn_vocabulary(df, cols)
    keep = list(df.columns) if keep is None else list(keep)
    return df.select(*keep, *one_hot_columns(vocab))


# SC-3/4/5 via the spec ---------------------------------------------------------
def derived_column(d: Derived, eps: float) -> Column:
    if d.kind == "ratio":
        return S.safe_ratio(d.a, d.b, eps)
    if d.kind == "diff":
        return S.difference(d.a, d.b)
    if d.kind == "product":
        return S.product(d.a, d.b)
    if d.kind == "sum":
        return S.total(d.a, d.b)
    if d.kind in ("gt", "lt"):
        return S.flag(d.a, d.kind, d.threshold).cast("double")
    raise ValueError(f"unknown derived kind {d.kind}")


# SC-10 ----------------------------------------------------------------------
def impute_median(df: DataFrame, cols: Sequence[str], medians: DataFrame | None = None) -> DataFrame:
    """Fill NULL/NaN with the column median.

    ``medians`` is a one-row table (AG-11 output).  Its single row is fetched
    once (bounded: one value per column, as MLlib's Imputer does) and applied
    as literals, so the main plan does not re-run the median job per column.
    """
    from riskloom.operators.aggregates import medians as _medians
    m = medians if medians is not None else _medians(df, cols)
    row = m.select(*[F.col(c).cast("double").alias(c) for c in cols]).first()
    cset = set(cols)
    out = []
    for c in df.columns:
        if c in cset and row[c] is not None:
            out.append(F.coalesce(S.missing_as_null(c), F.lit(float(row[c]))).alias(c))
        elif c in cset:
            out.append(S.missing_as_null(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# SC-24 ----------------------------------------------------------------------
def derive_features(df: DataFrame, spec: FeatureSpec, keep: Sequence[str] = (), impute: bool = False,
                    medians: DataFrame | None = None, dtype: str = "float",
                    absent_defaults: Mapping[str, float] | None = None) -> DataFrame:
    """Numeric pass-through, one-hot blocks, derived columns, in spec order.

    Derivation happens in double from the stored values; imputation (when on)
    runs after derivation, so a missing ratio gets the ratio's median; the
    cast to ``dtype`` is last.  ``absent_defaults`` supplies a literal for a
    column the input lacks (the serving path); without it an absent column is
    an error.
    """
    present = set(df.columns)
    base = df
    if absent_defaults:
        missing = {c: v for c, v in absent_defaults.items() if c not in present}
        if missing:
            base = base.withColumns({c: F.lit(float(v)) for c, v in missing.items()})
    numeric = [F.col(c).cast("double").alias(c) for c in spec.numeric]
    onehot = one_hot_columns(spec.categorical, dtype="double")
    derived = [derived_column(d, spec.eps).alias(d.name) for d in spec.derived]
    wide = base.select(*keep, *numeric, *onehot, *derived)
    names = spec.names
    if impute:
        # One-hot indicators and threshold flags are never NULL by
        # construction, so only pass-through and arithmetic columns can need
        # a median; skipping the rest gives the same table for less work.
        nullable = list(spec.numeric) + [d.name for d in spec.derived if d.kind not in ("gt", "lt")]
        # Written once: each pass of the medians would repeat what ``df`` is made of.
        wide = cut_lineage(wide) if medians is None else wide
        wide = impute_median(wide, nullable, medians)
    return wide.select(*keep, *[F.col(n).cast(dtype).alias(n) for n in names])
