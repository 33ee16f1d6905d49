"""Word counts kept up to date over a stream of documents.  Annotation is a projection, so it runs on streams as
it is; a batch's counts are summed on the executors and added to a table of partial counts, which is summed on
reading.  A batch that is repeated after a failure overwrites its own file and counts once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wordloom.operators.annotate import Annotator


def count_stream(docs: DataFrame, by: Annotator, store: str, checkpoint: str, unit: str = "lemma") -> StreamingQuery:
    """docs: a streaming DataFrame with doc_id, text."""

    def add(batch: DataFrame, number: int) -> None:
        by.annotate(batch).groupBy(F.col(unit).alias("word"), "is_function").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{store}/batch={number}")

    return docs.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(add).start()


def current(spark: SparkSession, store: str) -> DataFrame:
    return spark.read.schema("word string, is_function boolean, n bigint").parquet(f"{store}/*").groupBy("word", "is_function").agg(F.sum("n").alias("freq"))
