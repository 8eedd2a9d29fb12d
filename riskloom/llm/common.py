"""Helpers shared by the corpus operators: scratch tables, distributed running
positions, connected components.

Everything here is a DataFrame job.  Nothing is collected but single counts and
totals, and no helper gathers a whole group into one task.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from riskloom.session import scratch_path

#: Words are maximal runs without ASCII white space, in every operator.
WORD_CLASS = "[^\\x20\\x09-\\x0D]+"

#: Rows that one window partition should hold when a long group is split.
SPLIT_ROWS = 50_000
#: Least number of parts that a group is split into.
MIN_PARTS = 64


class Scratch:
    """Tables of one operator run below the shared checkpoint folder.

    ``cut`` writes a frame and reads it back: the lineage ends there and a lost
    executor costs only a re-read.  ``drop`` removes a table that no later step
    reads.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")

    def path(self, table: str) -> str:
        return f"{self.base}/{table}"

    def cut(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def keep_only(self, *tables: str) -> None:
        """Remove all tables but those that a lazily read result still needs."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        base = jvm.org.apache.hadoop.fs.Path(self.base)
        names = [f.getPath().getName() for f in base.getFileSystem(conf).listStatus(base)]
        self.drop(*[n for n in names if n not in tables])

    def drop(self, *tables: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            p = jvm.org.apache.hadoop.fs.Path(self.path(table))
            p.getFileSystem(conf).delete(p, True)


def numbered(docs: DataFrame, scratch: Scratch, **more: Column) -> DataFrame:
    """The documents, written once: ``_doc`` (all their columns, whatever the
    names), a generated number ``_m`` and further columns."""
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return scratch.cut(docs.select(doc.alias("_doc"), F.monotonically_increasing_id().alias("_m"),
                                   *[c.alias(k) for k, c in more.items()]), "numbered")


def as_text(name: str) -> Column:
    """A number as text, for the way through pandas: beside a null it would become a
    double there, and large ids would change."""
    return F.col(name).cast("long").cast("string").alias(name)


def spread(df: DataFrame) -> DataFrame:
    """The same rows, at most some ten thousand, over as many tasks as there are cores."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def group_key(c: str | Column) -> Column:
    """A never-null string key: '1' + value, or '0' for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string")))


def unit(h: Column) -> Column:
    """A signed 64-bit hash as a double in [0, 1), in the hash's order."""
    return F.least(h.cast("double") / F.lit(2.0**64) + F.lit(0.5), F.lit(1.0 - 2.0**-53))


def hash_sample(df: DataFrame, h: Column, limit: int, n_rows: int) -> DataFrame:
    """At most ``limit`` of ``n_rows`` rows, the first by a 64-bit hash.

    The hash's range is cut down first, so that a task keeps its share of the
    sample and not up to ``limit`` rows of its own."""
    if n_rows > limit:
        df = df.where(unit(h) < F.lit(min(1.0, (1.1 * limit + 200) / n_rows)))
    return df.withColumn("_order", h).orderBy("_order", *df.columns[:1]).limit(limit).drop("_order")


def parts_for(n_rows: int) -> int:
    """Into how many parts a group is split, from the size of the whole table."""
    return max(MIN_PARTS, -(-n_rows // SPLIT_ROWS))


def running(df: DataFrame, group: str | None, part: str, order: Sequence[str], value: str | None,
            rank: str, total: str) -> DataFrame:
    """Add ``rank``, the running total of ``value`` (1 for None) before each row
    in the order (part, *order) of its group, and ``total``, the group's sum.

    A group may hold a third of all rows: windows run within (group, part), and
    the parts' own totals, at most one row per part, give the offsets.  ``part``
    must rise with the order.
    """
    v = F.lit(1).cast("long") if value is None else F.col(value).cast("long")
    keys = [part] if group is None else [group, part]
    sums = df.groupBy(*keys).agg(F.sum(v).alias("_sum"))
    per = Window.partitionBy(*([group] if group else []))
    sums = (sums.withColumn("_off", F.sum("_sum").over(per.orderBy(part)) - F.col("_sum"))
            .withColumn(total, F.sum("_sum").over(per)).drop("_sum"))
    w = Window.partitionBy(*keys).orderBy(*order)
    inside = df.withColumn("_in", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)) - v)
    return (inside.join(sums, keys).withColumn(rank, F.col("_off") + F.col("_in")).drop("_off", "_in"))


def _local_forest(batches):
    """Star edges of the components within one partition's edges (two long
    columns); the partition's own nodes only."""
    import numpy as np
    import pandas as pd

    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    nodes = [x for x in parent if root(x) != x]
    yield pd.DataFrame({"a": np.array([parent[x] for x in nodes], dtype="int64"), "b": np.array(nodes, dtype="int64")})


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b long),
    for every node that has an edge.

    Each partition first replaces its edges by the star forest of what they
    connect.  Then rounds of hooking (a node's parent takes the smallest parent
    among the node's neighbours) and pointer jumping run as joins and minimum
    aggregations until no parent changes; each round is a written table.  A hub
    with a third of all edges is pre-aggregated by the minimum.
    """
    pairs = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b")
    forest = scratch.cut(pairs.mapInPandas(_local_forest, "a long, b long"), f"{tag}-forest")
    if forest.isEmpty():
        return forest.select(F.col("a").alias("node"), F.col("a").alias("component"))
    both = forest.union(forest.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = scratch.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("f")),
                         f"{tag}-0")
    k = 0
    while True:
        k += 1
        fu = labels.select(F.col("node").alias("a"), F.col("f").alias("fu"))
        fv = labels.select(F.col("node").alias("b"), F.col("f").alias("fv"))
        seen = forest.join(fu, "a").join(fv, "b").select("a", "b", "fu", "fv")
        low = F.least("fu", "fv")
        hook = (seen.select(F.explode(F.array(*[F.struct(F.col(c).alias("node"), low.alias("g"))
                                                for c in ("a", "b", "fu", "fv")])).alias("h"))
                .groupBy(F.col("h.node").alias("node")).agg(F.min("h.g").alias("g")))
        hooked = labels.join(hook, "node", "left").select("node", "f", F.least("f", F.coalesce("g", "f")).alias("h"))
        jump = hooked.select(F.col("node").alias("h"), F.col("h").alias("hh"))
        nxt = scratch.cut(hooked.join(jump, "h").select("node", F.col("hh").alias("f"),
                                                         (F.col("hh") != F.col("f")).alias("moved")), f"{tag}-{k}")
        moved = nxt.where("moved").limit(1).count()
        scratch.drop(f"{tag}-{k - 1}")
        labels = nxt.select("node", "f")
        if not moved:
            break
    scratch.drop(f"{tag}-forest")
    return labels.select("node", F.col("f").alias("component"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct_of(names: str) -> T.StructType:
    """Schema from its DDL text."""
    return T.StructType.fromDDL(names)
