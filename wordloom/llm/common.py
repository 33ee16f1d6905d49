"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.storage import shared_dir

#: ASCII letters only: the contracts lower-case A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What written tables are called.
MARK = "wordloom-table-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate value once, whatever use does with it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python a few megabytes at a time: a batch is copied on both sides, for every task.  These two
    settings of the session are lowered, never raised, and stay so, since plans read them when they run."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, read in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000, int), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20, size)):
        now = spark.conf.get(key, None)
        if now is None or not 0 < read(now) <= most:
            spark.conf.set(key, str(most))


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def few_files(df: DataFrame, rows: int, each: int = 10_000) -> DataFrame:
    """Partitions of about ``each`` rows instead of one for each shuffle partition, where that is fewer: a
    result of few rows is a few files.  Never fewer than the cores at hand; the rows are the same."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


#: Rows of a result of a few numbers, for few_files.
NARROW = 40_000


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def written(df: DataFrame, label: str, regroup: bool = True) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, so that a lost executor costs a
    reread and not a recomputation, and a later action does not repeat the work.  The table goes with the driver's
    process, or before that with ``discard``.

    regroup: df is narrow beside its input; its rows are first dealt out to a quarter as many files as the input
    has (or as there are cores), so that the tasks that read texts can be many and the files few."""
    spark = df.sparkSession
    if regroup:
        df = df.repartition(max(spark.sparkContext.defaultParallelism, len(df.inputFiles()) // 4))
    path = f"{shared_dir(spark)}/{MARK}{label}-{uuid.uuid4().hex}"
    fs, p = _files(spark, path)
    fs.deleteOnExit(p)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove written tables that nothing will read again."""
    for df in tables:
        for folder in {f[: f.index("/", f.index(MARK))] for f in df.inputFiles() if MARK in f}:
            fs, p = _files(df.sparkSession, folder)
            fs.delete(p, True)


def join_hot(rows: DataFrame, side: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows joined with side (one row a key) on key, where a few keys may have a third of all rows.

    weight: a column of side, the key's rows.  Keys with over a thousandth of total are at most a thousand, so
    their part of side is broadcast; the rest meets by a shuffle in which no key is large."""
    hot = F.col(weight) * 1000 > total
    heavy = F.broadcast(side.where(hot))
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(side.where(hot).select(key)), key, "left_anti").join(side.where(~hot), key))


def each_of(df: DataFrame, first: str, n: str, name: str, by: list[str], block: int = 10_000) -> DataFrame:
    """A row of df for each number from first to first + n - 1, as column name.

    One row may stand for a third of all: numbers are made in blocks, which are dealt out by a hash before each
    becomes rows, so no task makes more than its blocks and no array is longer than one."""
    step = F.lit(block)
    blocks = df.withColumn("__from", F.explode(F.sequence(F.col(first), F.col(first) + F.col(n) - 1, step)))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = blocks.withColumn("__upto", F.least(F.col("__from") + step, F.col(first) + F.col(n)) - 1).repartition(parts, "__from", *by)
    return dealt.withColumn(name, F.explode(F.sequence("__from", "__upto"))).drop("__from", "__upto")


def if_small(side: DataFrame, rows: int = 200_000) -> DataFrame:
    """A written table of a few numbers a row, to be broadcast if it has at most so many rows (some megabytes)."""
    return F.broadcast(side) if side.count() <= rows else side
