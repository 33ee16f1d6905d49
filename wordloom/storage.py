"""Intermediate tables that several parts of a plan read, in the folder that driver and executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.lru_cache(maxsize=1)
def _one_machine_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="wordloom-")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or else the warehouse, if one was named (its default is a folder of the driver's machine); only
    where all of Spark is one process, as in tests, a temporary folder in their place."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.split("[")[0] == "local":
        found = _one_machine_dir(spark.sparkContext.applicationId)
    if not found and spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
        found = spark.conf.get("spark.sql.warehouse.dir")
    if not found:
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


#: What stored tables are called.
MARK = "wordloom-table-"


def stored(df: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """df, computed once: written, read back, and removed with the driver's process or, before that, by ``discard``.
    by: a column of few values, each of which gets a folder that a reader can leave out."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{MARK}{label}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)
    writer = df.write if by is None else df.write.partitionBy(by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove stored tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f[: f.index("/", f.index(MARK))] for f in df.inputFiles() if MARK in f}:
            at = spark._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
