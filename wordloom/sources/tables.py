"""Tables as documents, and guesses at their columns' roles: one aggregation each, over all columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_lengths(table: DataFrame) -> DataFrame:
    """column, mean_chars."""
    one = table.agg(*(F.avg(F.length(F.col(f"`{c}`").cast("string"))).alias(str(i)) for i, c in enumerate(table.columns)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(i).alias("place"), F.lit(c).alias("column"), F.col(str(i)).alias("mean_chars")) for i, c in enumerate(table.columns)))).alias("x")).select("x.*")


def guess_text_column(table: DataFrame) -> DataFrame:
    """One row: the column of the longest values, the first of equals; none if all are null."""
    return text_lengths(table).where("mean_chars IS NOT NULL").orderBy(F.desc("mean_chars"), "place").limit(1).select("column")


def guess_group_columns(table: DataFrame, text_column: str | None, most: int = 50) -> DataFrame:
    """column, n_unique of those with more than one value, at most ``most``, and fewer than rows.  Counts are exact."""
    columns = [c for c in table.columns if c != text_column]
    one = table.agg(F.count("*").alias("rows"), *(F.count_distinct(F.col(f"`{c}`")).alias(str(i)) for i, c in enumerate(columns)))
    each = one.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(str(i)).alias("n_unique")) for i, c in enumerate(columns)))).alias("x"))
    return each.where((F.col("x.n_unique") > 1) & (F.col("x.n_unique") <= most) & (F.col("x.n_unique") < F.col("rows"))).select("x.*")


def to_documents(table: DataFrame, text: str, groups: list[str], name: str | None = None, key: str | None = None, drop_empty: bool = True) -> DataFrame:
    """doc_id, name, text and groups as strings ("" for null).  Without a key, ids follow the table's order of rows."""
    if key is None:
        from .files import numbered

        table = numbered(table.withColumn("__row", F.monotonically_increasing_id()), "__row").drop("__row")
        key = "doc_id"
    label = F.coalesce(F.col(name).cast("string"), F.concat(F.lit("row "), F.col(key).cast("long") + 1)) if name else F.concat(F.lit("row "), F.col(key).cast("long") + 1)
    docs = table.select(F.col(key).cast("long").alias("doc_id"), label.alias("name"), F.coalesce(F.col(text), F.lit("")).alias("text"), *(F.coalesce(F.col(g).cast("string"), F.lit("")).alias(g) for g in groups))
    return docs.where(F.rlike("text", F.lit(r"(?U)\S"))) if drop_empty else docs
