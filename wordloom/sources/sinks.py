"""Results as CSV for spreadsheets, and export projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def export(table: DataFrame, headings: dict[str, str]) -> DataFrame:
    """The named columns under their headings: all rows of the view, not a page of it.  Arrays become text."""
    kinds = dict(table.dtypes)
    return table.select(*((F.array_join(c, " ") if kinds[c].startswith("array") else F.col(c)).alias(h) for c, h in headings.items()))


def write_csv(table: DataFrame, path: str) -> None:
    """A folder of CSV parts whose first heading carries the byte-order mark that spreadsheets look for."""
    first = table.columns[0]
    table.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").csv(path, header=True, escape='"')


def csv_bytes(table: DataFrame, most: int = 1_000_000) -> bytes:
    """A small result in one piece, for a download.  More rows than ``most`` are refused: ``write_csv`` takes any number."""
    found = table.limit(most + 1).toPandas()
    if len(found) > most:
        raise ValueError(f"over {most:,} rows; use write_csv")
    return found.to_csv(index=False).encode("utf-8-sig")


def write_tokens(tokens: DataFrame, table: str, buckets: int = 64) -> None:
    """A token table bucketed and sorted by document, so that windows and joins by document need no shuffle."""
    tokens.write.mode("overwrite").bucketBy(buckets, "doc_id").sortBy("doc_id", "position").format("parquet").saveAsTable(table)
