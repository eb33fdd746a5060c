"""Tables written to the folder that the cluster shares, and how rows are dealt to tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir); removed when the session ends.

    Where the setting is empty, as in tests on one machine, a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.gettempdir() + "/kinmark-shared"
    path = f"{base.rstrip('/')}/kinmark-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def remove_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """df written as Parquet to shared storage and read again: its lineage ends there, and lost executors don't matter."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def n_partitions(df: DataFrame) -> int:
    """Partitions for a shuffle of whole rows: the session's setting, which is sized with the input."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def size_in_bytes(df: DataFrame) -> int:
    """The optimizer's estimate; of a scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, unit: int = 16 << 20) -> DataFrame:
    """df dealt over all cores, if its scan is so small that a few row groups may hold all of it; larger scans stay as they are.

    For work that takes far more time a row than moving the row does.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size_in_bytes(df) < unit * cores else df
