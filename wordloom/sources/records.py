"""Quoted delimited files as records, read in parallel whatever their size and encoding.

A line end inside quotation marks ends no record, and whether a place is inside depends on all marks before it.  So the
marks of each byte range (split) are counted first; sums of those counts say for each range whether it begins inside.  Then
every task cuts its ranges into records and parses them.  Only what crosses an edge, two pieces a range at most, meets
by a shuffle.  Lines are cut and marks counted on octets: in UTF-8, Latin, Shift-JIS and EUC no octet of a longer character is
a line end or a quotation mark (not so in UTF-16).

Defined results: empty fields are null; empty lines between records are none; a record may have fewer or more fields than the
header; marks that never close make one record of the rest of the file; an octet that the encoding lacks becomes U+FFFD.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_BOM = b"\xef\xbb\xbf"
#: A piece of a record that begins in a range and goes on behind it; one that fills a range; one that ends in it.
OPEN, MIDDLE, CLOSE = 0, 1, 2


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, block (where its range begins), value: lines without their ends, in order within a range."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def begins_inside(lines: DataFrame) -> dict[tuple[str, int], bool]:
    """Of each range (a row each) whether it begins inside quotation marks."""
    marks = F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))
    ranges = lines.groupBy("file", "block").agg((F.sum(marks) % 2).alias("odd"))
    before = F.sum("odd").over(Window.partitionBy("file").orderBy("block")) - F.col("odd")
    return {(r["file"], r["block"]): bool(r["inside"]) for r in ranges.select("file", "block", (before % 2).alias("inside")).collect()}


def parse(record: bytes, encoding: str, separator: str) -> list[str | None]:
    text = record.removeprefix(_BOM).decode(encoding, "replace")
    row = next(csv.reader(io.StringIO(text.removesuffix("\r"), newline=""), delimiter=separator), [])
    return [x or None for x in row]


_COLUMNS = {"file": pa.string(), "block": pa.int64(), "nth": pa.int64(), "kind": pa.int32(), "fields": pa.list_(pa.string()), "piece": pa.binary()}


def _cut(batches: Iterator[pa.RecordBatch], inside: dict[tuple[str, int], bool], encoding: str, separator: str) -> Iterator[pa.RecordBatch]:
    """(file, block, value) to records (kind null) and pieces of records."""
    csv.field_size_limit(1 << 30)
    out: list[tuple] = []
    at: tuple[str, int] | None = None
    held: list[bytes] = []
    within = begun = False
    nth = 0

    def done() -> None:
        """A range is over: what is held goes on in the next one."""
        if held:
            out.append((*at, nth, OPEN if begun else MIDDLE, None, b"\n".join(held) + b"\n"))

    for b in batches:
        for file, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if at != (file, block):
                if at is not None:
                    done()
                at, held, nth = (file, block), [], 0
                within = inside.get(at, False)
                begun = not within
            held.append(value)
            within ^= value.count(b'"') % 2 == 1
            if not within:
                record = b"\n".join(held)
                if not begun:
                    out.append((*at, nth, CLOSE, None, record))
                elif record.strip():
                    out.append((*at, nth, None, parse(record, encoding, separator), None))
                held, begun, nth = [], True, nth + 1
        if len(out) > 1000:
            yield _batch(out)
            out.clear()
    if at is not None:
        done()
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_COLUMNS)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _COLUMNS.values(), strict=True)], names=list(_COLUMNS))


def _parsed(batches: Iterator[pa.RecordBatch], encoding: str, separator: str) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 30)
    for b in batches:
        fields = [parse(b"".join(pieces), encoding, separator) for pieces in b.column(3).to_pylist()]
        yield pa.record_batch([*b.columns[:3], pa.array(fields, pa.list_(pa.string()))], names=["file", "block", "nth", "fields"])


def read_records(spark: SparkSession, path: str | list[str], encoding: str = "utf-8", separator: str = ",") -> DataFrame:
    """file, block, nth, fields: a row a record; (block, nth) is its order in the file."""
    lines = _lines(spark, path)
    inside = spark.sparkContext.broadcast(begins_inside(lines))
    raw = lines.select("file", "block", F.col("value").cast("binary").alias("value"))
    cut = raw.mapInArrow(lambda it: _cut(it, inside.value, encoding, separator), "file string, block bigint, nth bigint, kind int, fields array<string>, piece binary")
    whole = cut.where("kind IS NULL").select("file", "block", "nth", "fields")
    # pieces of one record follow each other: the record is known by how many began before
    order = Window.partitionBy("file").orderBy("block", "nth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = cut.where("kind IS NOT NULL").withColumn("record", F.count_if(F.col("kind") == OPEN).over(order))
    joined = pieces.groupBy("file", "record").agg(F.min(F.struct("block", "nth")).alias("first"), F.sort_array(F.collect_list(F.struct("block", "nth", "piece"))).alias("p"))
    ready = joined.select("file", "first.block", "first.nth", F.transform("p", lambda x: x["piece"]).alias("pieces"))
    return whole.unionByName(ready.mapInArrow(lambda it: _parsed(it, encoding, separator), "file string, block bigint, nth bigint, fields array<string>"))


def read_delimited(spark: SparkSession, path: str, columns: list[str], encoding: str = "utf-8", separator: str = ",") -> DataFrame:
    """columns as strings; the first record of each file is its header."""
    records = read_records(spark, path, encoding, separator)
    first = records.groupBy("file").agg(F.min(F.struct("block", "nth")).alias("first"))
    body = records.join(F.broadcast(first), "file").where(F.struct("block", "nth") > F.col("first"))
    return body.select(*(F.get("fields", F.lit(i)).alias(c) for i, c in enumerate(columns)))
