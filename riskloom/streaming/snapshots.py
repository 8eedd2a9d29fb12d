"""Update logs with snapshots and a manifest (the sinks of ST-3 and ST-4).

An update-mode query emits the new row of every key that changed.  Kept as a folder per
batch, such a log grows with the number of batches and a reader lists them all.  Here a
manifest per batch names what makes up the table: one snapshot and the batches since.
After ``every`` batches they are merged into the next snapshot, and what no kept manifest
names is removed.

A manifest counts from its ``_SUCCESS`` file on, which the write adds last, so a reader
sees the state before a batch or after it.  Those of the last two batches are kept: a
batch that is replayed starts from the one before it and writes the same again, and a
reader that began before the switch still finds its files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import drop_scratch
from riskloom.streaming.monitor import folder_versions

#: Batches that a manifest names beside its snapshot at most.
EVERY = 16
_STAMP = "_batch"


def _names(spark: SparkSession, path: str, version: int) -> list[str]:
    """What a manifest names, oldest first; at most a snapshot and ``every`` batches."""
    rows = spark.read.schema("place int, name string").json(f"{path}/manifest/v={version}").collect()
    return [r["name"] for r in sorted(rows, key=lambda r: r["place"])]


def _read(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*[f"{path}/{n}" for n in names])


def _newest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key's last batch; the row of a missing key is kept too."""
    row = F.struct(*[F.col(c) for c in log.columns if c not in keys])
    return log.groupBy(*keys).agg(F.max_by(row, _STAMP).alias("_r")).select(*keys, "_r.*")


def write_batch(batch: DataFrame, batch_id: int, path: str, keys: list[str], every: int = EVERY) -> None:
    """Add a batch of changed rows, at most one a key, to the table at ``path``."""
    spark = batch.sparkSession
    older = [v for v in folder_versions(spark, f"{path}/manifest") if v < batch_id]
    before = _names(spark, path, older[-1]) if older else []
    batch.withColumn(_STAMP, F.lit(batch_id)).write.mode("overwrite").parquet(f"{path}/batches/v={batch_id}")
    now = [*before, f"batches/v={batch_id}"]
    if len(now) > every:
        _newest(_read(spark, path, now), keys).write.mode("overwrite").parquet(f"{path}/snapshots/v={batch_id}")
        now = [f"snapshots/v={batch_id}"]
    (spark.createDataFrame(list(enumerate(now)), "place int, name string").coalesce(1)
     .write.mode("overwrite").json(f"{path}/manifest/v={batch_id}"))
    for v in older[:-1]:
        drop_scratch(spark, f"{path}/manifest/v={v}")
    named = {*before, *now}
    for kind in ("batches", "snapshots"):
        for v in folder_versions(spark, f"{path}/{kind}"):
            if f"{kind}/v={v}" not in named and v <= batch_id:
                drop_scratch(spark, f"{path}/{kind}/v={v}")


def snapshot_sink(stream: DataFrame, path: str, checkpoint: str, keys: list[str], every: int = EVERY, available_now: bool = True):
    """Run an update-mode stream into the table at ``path``."""
    w = (stream.writeStream.foreachBatch(lambda batch, i: write_batch(batch, i, path, keys, every))
         .option("checkpointLocation", checkpoint).outputMode("update"))
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 second")).start()


def read_snapshot(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The newest row per key, from the folders that the last complete manifest names."""
    versions = folder_versions(spark, f"{path}/manifest")
    if not versions:
        raise ValueError(f"no batch has been written to {path}")
    return _newest(_read(spark, path, _names(spark, path, versions[-1])), keys).drop(_STAMP)
