"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime settings the operators rely on. AQE re-plans joins by measured size and splits skewed join
# partitions.
RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a running session and make the package known to its workers."""
    for key, value in RUNTIME_CONF.items():
        spark.conf.set(key, value)
    _ship(spark.sparkContext)
    return spark


def _ship(context) -> None:
    """Send the package to the Python workers, once per application."""
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    base = os.path.join(tempfile.mkdtemp(prefix="prefspark-"), "prefspark")
    context.addPyFile(shutil.make_archive(base, "zip", root, "prefspark"))
    _shipped.add(context.applicationId)


_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="prefspark-"))
    return context.getCheckpointDir()


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of a location."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; a missing one is no error."""
    system, target = file_system(spark, path)
    system.delete(target, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in this application's part of the shared folder."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/prefspark/{app}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Parquet rather than an RDD checkpoint: later passes prune columns, and a lost executor re-reads
    files instead of re-running the lineage.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
