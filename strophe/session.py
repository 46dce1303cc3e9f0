"""Session helpers. Nothing here is needed when a cluster already supplies a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = "*", app: str = "strophe", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster use the session you are given."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def is_local(master: str) -> bool:
    """One JVM that is driver and executor at once."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint folder.

    Only a local session may do without: it gets a temporary one. Elsewhere a missing folder is an error,
    as every executor would write to its own disk.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not is_local(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        current = spark.sparkContext.getCheckpointDir()
    return current


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """``df`` as a table in the shared folder: for results of a bounded size that a plan uses many times.

    Computed once, and lost executors don't matter.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed(df: DataFrame, *cols: str) -> DataFrame:
    """Hash-partition by key for heavy row work that follows a grouping on the same key.

    The grouping reuses this partitioning (no further shuffle). The explicit count keeps
    adaptive execution from merging partitions that are small in bytes but costly to compute.
    """
    return df.repartition(shuffle_width(df.sparkSession), *cols)
