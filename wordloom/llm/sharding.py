"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard bids for a record with ``-weight / ln(u)``, u being a hash of the record's key and the shard's
name in (0, 1); the highest bid wins.  A bid depends on nothing but that key, that name and that weight, so
a further shard can only take records for itself, as many as its share of the weights, and a removed one
only gives up its own.  Assignment is a projection; there is no shuffle before the slots.

Slots number a shard's records from 0 without gaps.  A shard holds an unbounded number of rows, so it is
never sorted in one task: rows fall into ``buckets`` by a hash of all that tells them apart, repeated rows are counted
instead of kept (a key that a third of the rows share is one row here), each bucket's start is the running
sum over the bucket counts, and only a bucket is numbered at a time.

Defined results: a null text has size 1 and checksum 0; a null key is a key like any other; repeated rows
get slots of their own; an empty table gives no rows; other columns are ignored.  Records with one text but different keys are placed independently: the key decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, ShortType

from .common import NARROW, each_of, few_files, table, written


def winner(key: Column, weights: dict[int, float]) -> Column:
    if not weights or min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    shards = F.array(*(F.struct(F.lit(s).alias("s"), F.lit(float(w)).alias("w")) for s, w in sorted(weights.items())))

    def bid(x: Column) -> Column:
        # 52 bits of the hash, as a number between 0 and 1
        u = (F.shiftrightunsigned(F.xxhash64(key, x["s"]), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
        return F.struct((-x["w"] / F.log(u)).alias("bid"), (-x["s"]).alias("s"))

    return (-F.array_max(F.transform(shards, bid))["s"]).cast("int")


def stable(docs: DataFrame, key: str) -> Column:
    """Whole numbers of any size are one kind of key: equal ids go to equal shards whatever their column's type."""
    return F.col(key).cast("long") if isinstance(docs.schema[key].dataType, ByteType | ShortType | IntegerType) else F.col(key)


def shard(docs: DataFrame, weights: dict[int, float], grown: dict[int, float] | None = None, key: str = "doc_id", text: str = "text", buckets: int = 4096) -> DataFrame:
    """key, size (UTF-8 bytes and one separator), text_crc32, shard, slot, grown_shard (under the weights
    ``grown``, else null)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(stable(docs, key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("key", "size", "text_crc32"), F.lit(buckets)).cast("int"))
    counted = rows.groupBy("bucket", "key", "size", "text_crc32").agg(F.count("*").alias("n"))
    placed = counted.withColumn("shard", winner(F.col("key"), weights)).withColumn("grown_shard", winner(F.col("key"), grown) if grown else F.lit(None).cast("int"))
    placed = written(placed, "shard")
    # at most buckets x shards rows, whatever the input
    starts = placed.groupBy("shard", "bucket").agg(F.sum("n").alias("n")).withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy("shard", "bucket").orderBy("key", "size", "text_crc32")
    slots = placed.join(starts, ["shard", "bucket"]).withColumn("first", F.col("start") + F.sum("n").over(within) - F.col("n"))
    out = each_of(slots, "first", "n", "slot", ["key", "size", "text_crc32"]).select(F.col("key").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
    return few_files(out, placed.count(), NARROW)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = {s: 1.0 for s in range(9)}
    out = shard(table(spark, sf_dir, "documents"), {s: w for s, w in even.items() if s < 8}, even)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
