"""Sorts, pages, top-k, samples and folds (SL-*).

Sorts always carry a unique tiebreak so results are deterministic; ``orderBy
+ limit`` becomes TakeOrderedAndProject (per-partition heaps, no full sort).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions import scalar as S

#: Slices of a stratum in exact folds; only the plan depends on it.
HASH_PARTS = 1024
#: Keys that one task or the driver holds while a deep page is looked for, and rows
#: before a page that are simply skipped.
SELECT_KEYS = 4096


def _order(c: Column, direction: str) -> Column:
    """Anything but 'asc' is descending; missing values last either way."""
    return F.asc_nulls_last(c) if direction == "asc" else F.desc_nulls_last(c)


def sort_by(df: DataFrame, col: str, direction: str = "desc", tiebreak: Sequence[str] = ()) -> DataFrame:
    """SL-1: sort by any column, NULL and NaN last, unique tiebreak ascending."""
    return df.orderBy(_order(S.order_key(df, col), direction), *[F.asc(c) for c in tiebreak])


def page(df: DataFrame, col: str, direction: str, tiebreak: Sequence[str], page_no: int = 1,
         size: int = 50) -> DataFrame:
    """SL-2: offset page (1-based page, 1 <= size <= 200).

    A page that starts beyond ``SELECT_KEYS`` rows is found by its first key
    (:func:`key_at`) and read from there, so that no task takes more than
    ``SELECT_KEYS`` keys or ``size`` rows, however deep the page."""
    if page_no < 1 or not (1 <= size <= 200):
        raise ValueError("page >= 1 and 1 <= size <= 200")
    offset = (page_no - 1) * size
    if offset <= SELECT_KEYS:
        return sort_by(df, col, direction, tiebreak).offset(offset).limit(size)
    order = _Order(df, col, direction, tiebreak)
    found = key_at(order, offset)
    if found is None:
        return df.limit(0)
    key, skip = found
    return order.sorted(df.where(~order.before(key))).offset(skip).limit(size)


class _Order:
    """The order of :func:`sort_by` over a frame's rows, and comparisons with a key
    (one value per order column)."""

    def __init__(self, df: DataFrame, col: str, direction: str, tiebreak: Sequence[str]):
        # (expression, ascending, missing values last)
        self.terms = [(S.order_key(df, col), direction == "asc", True), *[(F.col(c), True, False) for c in tiebreak]]
        self.keys = df.select(*[e.alias(f"k{i}") for i, (e, _, _) in enumerate(self.terms)])
        self.types = [f.dataType for f in self.keys.schema.fields]

    def _columns(self, exprs: Sequence[Column]) -> list[Column]:
        return [(F.asc_nulls_last(e) if last else F.asc_nulls_first(e)) if up else F.desc_nulls_last(e)
                for e, (_, up, last) in zip(exprs, self.terms)]

    def sorted(self, df: DataFrame) -> DataFrame:
        return df.orderBy(*self._columns([e for e, _, _ in self.terms]))

    def sorted_keys(self, keys: DataFrame) -> DataFrame:
        return keys.orderBy(*self._columns([F.col(c) for c in keys.columns]))

    def before(self, key: Sequence, of_keys: bool = False) -> Column:
        """Whether a row comes before the key; never null."""
        out = F.lit(False)
        for i, (e, up, last) in reversed(list(enumerate(self.terms))):
            e, v = F.col(f"k{i}") if of_keys else e, F.lit(key[i]).cast(self.types[i])
            if key[i] is None:
                less = e.isNotNull() if last else F.lit(False)
            else:
                less = F.coalesce(e < v if up else e > v, F.lit(not last))
            out = less | (e.eqNullSafe(v) & out)
        return out


def key_at(order: _Order, rank: int) -> tuple[tuple, int] | None:
    """The key of the row at 0-based ``rank`` and how many rows of equal key precede
    it (0 where the tiebreak is unique); None beyond the last row.

    Selection by sampling: two keys of a sample bracket the rank, one pass counts the
    rows below and inside, and the search goes on inside, where a sixteenth of the
    rows is left a round.  Up to ``SELECT_KEYS`` keys inside are the sample and hold
    the answer.  A bracket that missed is an exact statement as well: the search goes
    on at its other side.  The driver sees ``SELECT_KEYS`` keys a round.
    """
    keys, below, inside = order.keys, 0, order.keys.count()
    if rank >= inside:
        return None
    while True:
        names = keys.columns
        some = keys
        if inside > SELECT_KEYS:  # cut by hash first, so that a task keeps its share only
            share = 1.5 * SELECT_KEYS / inside
            some = keys.where(F.pmod(F.xxhash64(F.lit(inside), *names), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
            some = some.orderBy(F.xxhash64(F.lit(inside), *names)).limit(SELECT_KEYS)
        sample = [tuple(r) for r in order.sorted_keys(some).collect()]
        if inside <= SELECT_KEYS:
            at = rank - below
            return sample[at], at - sample.index(sample[at])
        if not sample:  # all rows share a few keys whose hashes were cut off
            sample = [tuple(keys.first())]
        at, slack = (rank - below) * len(sample) / inside, 2 * len(sample) ** 0.5 + 1
        low, high = sample[max(0, int(at - slack))], sample[min(len(sample) - 1, int(at + slack))]
        is_less, is_more = order.before(low, True), ~order.before(high, True) & ~_equal(high, order.types)
        less, more = (int(x or 0) for x in keys.agg(F.sum(is_less.cast("long")), F.sum(is_more.cast("long"))).first())
        if rank < below + less:
            keys, inside = keys.where(is_less), less
        elif rank >= below + inside - more:
            keys, below, inside = keys.where(is_more), below + inside - more, more
        else:
            keys, below, inside = keys.where(~is_less & ~is_more), below + less, inside - less - more
            if low == high:
                return low, rank - below


def _equal(key: Sequence, types: Sequence) -> Column:
    out = F.lit(True)
    for i, v in enumerate(key):
        out = out & F.col(f"k{i}").eqNullSafe(F.lit(v).cast(types[i]))
    return out


def page_info(df: DataFrame, page_no: int, size: int) -> DataFrame:
    """SL-3: total rows, page, size and page count ceil(total / size)."""
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(page_no).alias("page"), F.lit(size).alias("page_size"),
        F.ceil(F.col("total") / F.lit(size)).cast("long").alias("pages"))


def top_k(df: DataFrame, col: str, k: int, tiebreak: Sequence[str] = (), direction: str = "desc") -> DataFrame:
    """SL-4: first k rows in order."""
    return sort_by(df, col, direction, tiebreak).limit(k)


def keyset_page(df: DataFrame, col: str, row_id: str, size: int, after: tuple | None = None) -> DataFrame:
    """SL-7: next page after (score, id) in (score desc, id asc) order; rows with
    a missing score come last, by id, and follow ``after=(None, id)``.

    Deep pages cost the same as the first one: the seek predicate is pushed to
    the scan and only ``size`` rows per partition are kept.
    """
    score = S.order_key(df, col)
    out = df
    if after is not None:
        s, i = after
        if s is None or s != s:
            out = out.where(score.isNull() & (F.col(row_id) > F.lit(i)))
        else:
            out = out.where((score < F.lit(s)) | ((score == F.lit(s)) & (F.col(row_id) > F.lit(i))) | score.isNull())
    return out.orderBy(F.desc_nulls_last(score), F.asc(row_id)).limit(size)


def hash_key(seed: int | str, key: str) -> Column:
    """md5 of 'seed:key' as lowercase hex (same value in Spark and DuckDB)."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.col(key).cast("string")))


def sample_n(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """SL-5: n rows without replacement, reproducible for a seed (hash order)."""
    return df.orderBy(hash_key(seed, key), F.asc(key)).limit(n)


def kfold(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42, mode: str = "exact",
          out: str = "fold") -> DataFrame:
    """SL-6: stratified shuffled folds.

    exact: rank rows within each label by (md5 prefix, key), fold = rank mod k.
    Rows without a label are a stratum of their own.  Each stratum is cut into
    ``HASH_PARTS`` slices of the hash; rows are numbered in their slice and the
    slices' counts give the offsets, so the rows are shuffled once and no stratum
    is one task.  hash: fold = pmod(xxhash64(seed, key), k), a per-row function
    with no shuffle (stratified only in expectation).
    """
    if mode == "hash":
        return df.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(k)).cast("int"))
    h = F.conv(F.substring(hash_key(seed, key), 1, 13), 16, 10).cast("long")
    t = df.withColumn("_h", h).withColumn("_s", F.floor(F.col("_h") / F.lit(2**52 // HASH_PARTS)))
    t = t.withColumn("_l", F.when(F.col(label).isNull(), "0").otherwise(F.concat(F.lit("1"), F.col(label).cast("string"))))
    t = t.withColumn("_rn", F.row_number().over(Window.partitionBy("_l", "_s").orderBy("_h", key)))
    counts = t.groupBy("_l", "_s").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_l", "_s", (F.sum("_n").over(Window.partitionBy("_l").orderBy("_s")) - F.col("_n")).alias("_b"))
    rank = F.col("_b") + F.col("_rn") - F.lit(1)
    return t.join(before, ["_l", "_s"]).withColumn(out, (rank % F.lit(k)).cast("int")).select(*df.columns, out)
