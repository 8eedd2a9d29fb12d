"""Batch sources and sinks (IO-1 .. IO-7, IO-10)."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.session import scratch_path


# IO-1 -----------------------------------------------------------------------
def read_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Read a Parquet table; an explicit schema skips footer inference."""
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(path)


def fixture_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


# IO-10 ----------------------------------------------------------------------
def layout(df: DataFrame, partition_by: Sequence[str] = (), sort_by: Sequence[str] = (),
           num_partitions: int | None = None) -> DataFrame:
    """Arrange rows for the writer: range-partition on (partition cols, sort
    cols) and sort within partitions, so each file holds a narrow key range
    (tight Parquet min/max stats for row-group skipping) and each task writes
    to few directories."""
    keys = list(partition_by) + list(sort_by)
    if not keys:
        return df
    ranged = df.repartitionByRange(num_partitions, *keys) if num_partitions else df.repartitionByRange(*keys)
    return ranged.sortWithinPartitions(*keys)


# IO-2 -----------------------------------------------------------------------
def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                sort_by: Sequence[str] = (), num_partitions: int | None = None) -> str:
    """Write Parquet (no index column), optionally laid out by IO-10."""
    out = layout(df, partition_by, sort_by, num_partitions)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return path


# IO-3 -----------------------------------------------------------------------
#: The usual CSV dialect: a quote inside a field is doubled, line breaks and blank edges
#: belong to the field, an empty field is NULL and a quoted empty one is empty text.
_CSV = {"header": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Stands for a missing field while a line is parsed; no text of a file should be this.
_CSV_MISSING = "\x00"


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Files with a header, as spreadsheet tools and pandas read them."""
    df.write.mode(mode).options(**_CSV).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """Read such files.  Fields may hold line breaks, for which a file is one task;
    ``multi_line=False`` splits large files where no field does."""
    return (spark.read.schema(schema).options(**_CSV, multiLine=multi_line, nullValue=_CSV_MISSING, emptyValue="").csv(path))


# IO-4 -----------------------------------------------------------------------
def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def read_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_feature_list(spark: SparkSession, names: Sequence[str], path: str) -> str:
    """Persist the ordered feature list beside a model (one JSON line per name)."""
    rows = [(i, n) for i, n in enumerate(names)]
    spark.createDataFrame(rows, "position int, feature string").coalesce(1).write.mode("overwrite").json(path)
    return path


def read_feature_list(spark: SparkSession, path: str) -> list[str]:
    # Bounded: the feature list is the model's input width.
    rows = spark.read.schema("position int, feature string").json(path).orderBy("position").collect()
    return [r["feature"] for r in rows]


# IO-5 -----------------------------------------------------------------------
def predictions_frame(df: DataFrame, key: str, probs: Mapping[str, str], tier: str, explanation: str | None = None,
                      model_version: str = "v1.0", top: int = 10) -> DataFrame:
    """Rows of the declared predictions table: each model's probability and the
    blend (``probs``: table column -> column of ``df``), version default, JSON top-n
    explanation, predicted_at = now."""
    expl = (F.to_json(F.slice(F.col(explanation), 1, top)) if explanation else F.lit(None).cast("string"))
    return df.select(
        F.col(key).alias("patient_id"), *[F.col(c).alias(name) for name, c in probs.items()],
        F.col(tier).alias("risk_tier"), F.lit(model_version).alias("model_version"), expl.alias("shap_top10"),
        F.current_timestamp().alias("predicted_at"))


def predictions_sink(df: DataFrame, path: str, **kw) -> str:
    predictions_frame(df, **kw).write.mode("append").parquet(path)
    return path


def predictions_stream_sink(stream: DataFrame, path: str, checkpoint: str, **kw):
    """The same rows from a stream: each micro-batch overwrites its own
    ``batch_id`` partition, so a replayed batch adds nothing."""
    def write(batch: DataFrame, batch_id: int) -> None:
        predictions_frame(batch, **kw).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


# IO-6 -----------------------------------------------------------------------
RUN_METRICS_SCHEMA = "run_id string, kind string, key string, value string, ts timestamp"


def run_metrics_frame(spark: SparkSession, params: Mapping[str, object], metrics: Mapping[str, float],
                      run_id: str | None = None) -> DataFrame:
    run_id = run_id or uuid.uuid4().hex
    rows = [(run_id, "param", k, json.dumps(v) if not isinstance(v, str) else v) for k, v in params.items()]
    rows += [(run_id, "metric", k, repr(float(v))) for k, v in metrics.items()]
    return (spark.createDataFrame(rows, "run_id string, kind string, key string, value string")
            .withColumn("ts", F.current_timestamp()))


def run_metrics_sink(spark: SparkSession, params: Mapping[str, object], metrics: Mapping[str, float],
                     path: str, run_id: str | None = None) -> str:
    run_metrics_frame(spark, params, metrics, run_id).write.mode("append").parquet(path)
    return path


def roundtrip_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared scratch area for round-trip checks."""
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")
