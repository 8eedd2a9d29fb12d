"""Session construction and lineage checkpoints.

On a cluster the session comes from the launcher and already names a shared
``spark.checkpoint.dir``; we only read it.  Local runs and tests get a scratch
directory because nothing else sets one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "riskloom", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    UTC session time zone keeps timestamp_ntz <-> timestamp casts stable, and AQE
    re-plans joins and coalesces shuffle partitions at runtime.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _LOCAL_DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the checkpoint directory, configuring a scratch one only if unset.

    The cluster's shared folder (``spark.checkpoint.dir``) always wins.  Only a
    session whose executors run in this process (a local master) may fall back to
    a machine-local temp folder; on a cluster each executor would write to its
    own disk, so a missing setting is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not configured:
        configured = tempfile.mkdtemp(prefix="riskloom-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        atexit.register(shutil.rmtree, configured, ignore_errors=True)
    sc.setCheckpointDir(configured)
    return configured


_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Materialise ``df`` as a Parquet table in the shared checkpoint folder
    and return a DataFrame that reads it back.

    The lineage is cut (readers do not recompute the input) and the table
    survives executor loss, unlike a local checkpoint.  A written table is
    used instead of ``Dataset.checkpoint()`` because the latter computes the
    plan twice (one job to count, one to write the RDD) and stores rows in
    serialized-object form rather than columnar.  The shuffle files of the plan are
    dropped when it is written: nothing reads them again, and they would stay until
    the driver's garbage is collected.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"lineage-{uuid.uuid4().hex}")
    was = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_DROP_SHUFFLES, was)
    return spark.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint directory for intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no later step reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of a frame's bytes; no job is run for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


#: Rows in a task of a fit or an explanation: what a task keeps and reads is
#: bounded by it, however large the table is.
TASK_ROWS = 500_000


def task_parts(df: DataFrame, most: int = TASK_ROWS) -> int:
    """How many partitions hold at most ``most`` rows each, one per core at least.

    The rows are counted: ``df`` should read a written table.  Bytes on disk say
    little here, as compressed features are many times larger in memory.
    """
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // most))


def spread_rows(df: DataFrame, most: int = TASK_ROWS) -> DataFrame:
    """Equal partitions of at most ``most`` rows, for fits and explanations."""
    return df.repartition(task_parts(df, most))


def fits_at_once(df: DataFrame, most: int) -> int:
    """How many models are fitted at a time on the rows of a written table: up to
    ``most`` while a partition per core is enough, else one, since a fit keeps its
    rows on the executors and keeps all cores busy."""
    return most if task_parts(df) <= df.sparkSession.sparkContext.defaultParallelism else 1


def spread_small(df: DataFrame) -> DataFrame:
    """At least one partition per core for CPU-heavy steps.  Only an input of less
    than a scan split's bytes per core is dealt anew; a large one keeps the
    partitions its size gave it."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return df.repartition(cores) if input_bytes(df) < cores * split else df
