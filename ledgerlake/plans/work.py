"""The folder that all executors share, and tables written there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local folder on a local master (tests), and an error on a cluster, whose executors would not share it."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if app not in _FALLBACK:
        _FALLBACK[app] = tempfile.mkdtemp(prefix="ledgerlake-")
    return _FALLBACK[app]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_root(spark)}/ledgerlake-{uuid.uuid4().hex}/{name}"
    parent = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rpartition("/")[0])
    fs = parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(parent)
    fs.deleteOnExit(parent)
    return path


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
