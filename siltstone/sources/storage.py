"""The shared folder, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset and the session runs on one
    machine, a fresh local folder that is then set. On a cluster it has to be set."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not (sc.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(base)
    return base


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    where, fs = _hadoop(spark, path)
    fs.deleteOnExit(where)
    return path


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _hadoop(spark, path)
    return fs.exists(where)


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back, which cuts its
    lineage and computes it once."""
    path = fresh_path(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores: a small file is
    read by one task, and what follows would be, too. A scan of many partitions is
    left alone, so a large table is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
