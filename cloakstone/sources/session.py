"""Session settings the operators count on, and the shared folder for materialised steps."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

# Adaptive execution sizes shuffle partitions, splits skewed join partitions and picks
# broadcast joins from measured sizes; the byte cap keeps Arrow batches of long texts small.
# The method limit is HotSpot's own: a larger generated method is never compiled, so
# Spark had better not fuse wide expressions into one.  Stream state lives on disk.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


def tune(spark: SparkSession) -> SparkSession:
    """Give a session made elsewhere the settings it did not choose itself."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark


def local_session(cpus: str = "*", partitions: int = 8, app: str = "cloakstone") -> SparkSession:
    """A session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: the cluster's ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests, bench) gets a temporary one; a cluster
    session must name one, because no machine's own disk is seen by the others.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="cloakstone-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def keep(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.

    The files go when the session ends; a lost executor costs no recomputation.  Columns in
    ``folders`` become folders of the table, so that a filter on them reads no other rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*folders).parquet(path) if folders else df.write.parquet(path)
    at_folder(spark, path, lambda files, target: files.deleteOnExit(target))
    kept = spark.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(kept: DataFrame) -> None:
    """Delete a kept table that no later plan reads."""
    at_folder(kept.sparkSession, kept._kept_at, lambda files, target: files.delete(target, True))


def at_folder(spark: SparkSession, path: str, do: Callable) -> None:
    """Call ``do`` with the Hadoop file system of a path and the path."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    do(target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target)
