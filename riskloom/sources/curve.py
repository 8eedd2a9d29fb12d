"""One file layout for several lookups (IO-10): a space-filling-curve order with
Parquet statistics for range and low-cardinality columns, and Bloom filters for keys.

Four sorted indexes cannot share one file order, but a curve can be near to all of
them: each curve column is cut into at most ``2**bits`` ranges of about equal rows, and
the ranges' numbers are interleaved bit by bit (Z-order).  Rows close on the curve are
close in every column, so that the minimum and maximum of a row group are narrow in each
and a scan skips groups by any of them.  A key with many values has narrow statistics in
no shared order; its row groups carry Bloom filters instead.

The cut points come from a bounded sample by hash; they shape the files, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that cut points are taken from.
SAMPLE_ROWS = 10_000


def cut_points(df: DataFrame, columns: Sequence[str], bits: int, limit: int = SAMPLE_ROWS) -> dict[str, list]:
    """Per column at most ``2**bits - 1`` rising values that part the rows evenly."""
    rows = df.select(*[F.col(c) for c in columns])
    h, n = F.xxhash64(*columns, F.monotonically_increasing_id()), df.count()
    share = min(1.0, 1.2 * limit / max(1, n))
    some = rows.where(F.pmod(h, F.lit(1 << 30)) <= int(share * (1 << 30))).limit(2 * limit).collect()
    out = {}
    for c in columns:
        values = sorted(r[c] for r in some if r[c] is not None and r[c] == r[c])
        distinct = sorted(set(values))
        if len(distinct) <= 1 << bits:  # every value a range of its own
            out[c] = distinct[1:]
        else:
            out[c] = sorted({values[len(values) * k >> bits] for k in range(1, 1 << bits)})
    return out


def range_number(df: DataFrame, column: str, cuts: list, bits: int) -> Column:
    """Which of the ranges between the cuts a value lies in, spread over ``2**bits``;
    missing values lie in the first.  One comparison per bit: a balanced CASE."""
    kind, value = df.schema[column].dataType, F.col(column)

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit((low << bits) // (len(cuts) + 1)).cast("long")
        mid = (low + high) // 2
        return F.when(value >= F.lit(cuts[mid]).cast(kind), search(mid + 1, high)).otherwise(search(low, mid))

    return F.when(value.isNull(), F.lit(0).cast("long")).otherwise(search(0, len(cuts)))


def with_position(df: DataFrame, columns: Sequence[str], bits: int = 6, out: str = "_z") -> DataFrame:
    """The rows with their place on the Z-order curve through ``columns``."""
    if not 1 <= bits * len(columns) <= 62:
        raise ValueError("at most 62 bits over all columns")
    cuts = cut_points(df, columns, bits)
    for i, c in enumerate(columns):
        df = df.withColumn(f"{out}{i}", range_number(df, c, cuts[c], bits))
    place = F.lit(0).cast("long")
    for i in range(len(columns)):
        for b in range(bits):
            bit = F.shiftright(F.col(f"{out}{i}"), b).bitwiseAND(F.lit(1).cast("long"))
            place = place.bitwiseOR(F.shiftleft(bit, b * len(columns) + i))
    return df.withColumn(out, place).drop(*[f"{out}{i}" for i in range(len(columns))])


def write_curve(df: DataFrame, path: str, curve: Sequence[str], keys: Sequence[str] = (), bits: int = 6,
                num_partitions: int | None = None, row_group_bytes: int = 16 << 20, key_values: int = 100_000) -> str:
    """Write Parquet in curve order, with Bloom filters of ``keys`` sized for
    ``key_values`` distinct values in a row group.  A cell of the curve that holds many
    rows is spread over several files by the keys' hash."""
    order = [F.col("_z"), F.xxhash64(*(keys or curve))]
    placed = with_position(df, curve, bits)
    ranged = placed.repartitionByRange(num_partitions, *order) if num_partitions else placed.repartitionByRange(*order)
    writer = ranged.sortWithinPartitions("_z").drop("_z").write.mode("overwrite").option("parquet.block.size", str(row_group_bytes))
    for k in keys:
        writer = (writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
                  .option(f"parquet.bloom.filter.expected.ndv#{k}", str(key_values)))
    writer.parquet(path)
    return path
