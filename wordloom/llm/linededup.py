"""Line dedup: range-partitioned line hashes, streamed in order, answered by keep bitmaps.

1. Every line with a key (blank ends stripped, A-Z lower-cased, empty keys left out) becomes a narrow row: a
   128-bit hash of the key, the document and the line's position.  Text stays behind.
2. The rows are range-partitioned and sorted by (hash, document, position).  The document is part of the
   partitioning key, so a line that a third of all documents share spreads over many partitions, and a
   document's occurrences of a line stay together.
3. A stream over each partition closes one run of equal hashes after the other.  A run inside a partition
   is decided on the spot; at most ``min_docs`` documents' rows wait for the decision.  The first and the
   last run may go on next door: their rows leave undecided, together with their document count.
4. Those counts (two a partition at most) are summed and joined back.
5. Dropped positions are grouped by document into a bitmap of the lines to keep, compressed with zlib.

Modes: ``"all"`` drops every line whose key is in at least ``min_docs`` documents; ``"later"`` drops all
but the first occurrence (in order of document and position) of such a line.

Defined results: a null or empty text is one empty line; documents are told apart by id and text: rows
with the same id count as one document, and equal rows get equal bitmaps; null ids are one id, others are whole numbers
(text that is none is an error); an empty table gives no rows; other columns are ignored or, in ``drop_lines``, kept.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import ascii_lower, few_files, map_arrow, small_batches, table, written

BLANK = "\t\n\x0b\x0c\r "


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def line_hashes(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """a, b (the hash's halves), doc, body (a hash of the text, for ids that repeat), pos."""
    lines = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("pos", "line"))
    k = lines.withColumn("k", line_key(F.col("line"))).where(F.length("k") >= min_chars)
    return k.select(F.xxhash64("k").alias("a"), F.xxhash64(F.lit("second half"), "k").alias("b"), "doc", "body", "pos")


_OUT = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("doc", pa.int64()), ("body", pa.int64()), ("pos", pa.int32()), ("docs", pa.int64()), ("state", pa.int8())])
#: state: a line to drop; a row whose run may go on in another partition; a run's document count.
DROP, OPEN, COUNT = 0, 1, 2


def _first_of(*cols: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(cols[0]), dtype=bool)
    if len(new) > 1:
        new[1:] = False
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
    return new


def stream_runs(batches: Iterator[pa.RecordBatch], min_docs: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, rows of _OUT out.  Between batches only the last run's count and, while it is below
    min_docs, its rows are held: rows of fewer than min_docs documents."""
    held: list[np.ndarray] | None = None  # rows of the run that is open at the end of the last batch
    run: tuple[int, int] | None = None  # its hash
    docs, last_doc, sent, first_run = 0, None, 0, True

    def out(rows: list[np.ndarray], n: object, state: int) -> pa.RecordBatch:
        size = len(rows[0])
        doc = pa.array(rows[2], mask=rows[5]) if size else pa.array([], pa.int64())
        return pa.record_batch([pa.array(rows[0]), pa.array(rows[1]), doc, pa.array(rows[3]), pa.array(rows[4].astype(np.int32)), pa.array(np.broadcast_to(np.asarray(n, dtype=np.int64), (size,))), pa.array(np.full(size, state, dtype=np.int8))], schema=_OUT)

    def cut(rows: list[np.ndarray], where: object) -> list[np.ndarray]:
        return [r[where] for r in rows]

    def count_row(h: tuple[int, int], n: int) -> pa.RecordBatch:
        return pa.record_batch([[h[0]], [h[1]], pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([None], pa.int32()), [n], pa.array([COUNT], pa.int8())], schema=_OUT)

    for batch in batches:
        if not batch.num_rows:
            continue
        gone = np.asarray(batch.column(2).is_null())
        rows = [np.asarray(batch.column(i).fill_null(0)) for i in range(5)] + [gone]
        begins = np.flatnonzero(_first_of(rows[0], rows[1]))
        if run == (int(rows[0][0]), int(rows[1][0])):
            head = begins[1] if len(begins) > 1 else len(rows[0])
        else:
            head = 0
        if head:  # the open run goes on
            part = cut(rows, slice(0, head))
            new = _first_of(part[2], part[5])
            new[0] = (int(part[2][0]), bool(part[5][0])) != last_doc
            docs += int(new.sum())
            last_doc = (int(part[2][-1]), bool(part[5][-1]))
            held = part if held is None else [np.concatenate(x) for x in zip(held, part, strict=True)]
            if first_run or docs >= min_docs:
                if len(held[0]):
                    yield out(cut(held, slice(int(keep_first and not sent and not first_run), None)), docs, OPEN if first_run else DROP) if not first_run else out(held, docs, OPEN)
                    sent += len(held[0])
                held = None
            if len(begins) == 1:
                continue
            begins = begins[1:]
        if run is not None:  # the open run is over
            if first_run:
                yield count_row(run, docs)
            first_run = False
        # runs that begin in this batch; the last of them stays open
        ends = np.append(begins[1:], len(rows[0]))
        new = np.cumsum(_first_of(rows[0], rows[1], rows[2], rows[5]))
        per = new[ends - 1] - np.where(begins > 0, new[begins - 1], 0)
        inner = np.arange(len(begins)) < len(begins) - 1
        if run is None and inner[0]:  # the partition's first run
            first = cut(rows, slice(begins[0], ends[0]))
            yield out(first, per[0], OPEN)
            yield count_row((int(first[0][0]), int(first[1][0])), int(per[0]))
            inner[0] = False
            first_run = False
        drop = np.repeat(inner & (per >= min_docs), ends - begins)
        if keep_first:
            drop[begins - begins[0]] = False
        if drop.any():
            yield out(cut(rows, slice(begins[0], None)), 0, DROP).filter(pa.array(drop))
        tail = cut(rows, slice(begins[-1], None))
        run, docs, last_doc, sent = (int(tail[0][0]), int(tail[1][0])), int(per[-1]), (int(tail[2][-1]), bool(tail[5][-1])), 0
        held = tail
        if first_run:
            yield out(held, docs, OPEN)
            held = None
        elif docs >= min_docs:
            yield out(cut(held, slice(int(keep_first), None)), docs, DROP)
            sent, held = len(held[0]), None
    if run is not None:
        # The last run: what is held is undecided; what was dropped already stays dropped.
        if held is not None and len(held[0]):
            yield out(held, docs, OPEN)
        yield count_row(run, docs)


def dropped_lines(docs: DataFrame, min_docs: int = 10, mode: str = "all", text: str = "text", key: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """doc, body, pos of every line to drop."""
    if mode not in ("all", "later"):
        raise ValueError(mode)
    spark, later = docs.sparkSession, mode == "later"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Range partitioning reads its input twice (once to find the ranges): narrow rows, not texts.
    rows = written(line_hashes(docs, text, key, min_chars).select("a", "b", F.col("doc").cast("long").alias("doc"), "body", "pos"), "hashes")
    ranged = rows.repartitionByRange(parts, "a", "b", "doc").sortWithinPartitions("a", "b", "doc", "body", "pos")
    schema = "a bigint, b bigint, doc bigint, body bigint, pos int, docs bigint, state tinyint"
    seen = written(map_arrow(ranged, lambda it: stream_runs(it, min_docs, later), schema), "lines")
    # Two rows a partition at most: the hashes whose runs touch an edge.
    edges = seen.where(F.col("state") == COUNT).groupBy("a", "b").agg(F.sum("docs").alias("total")).where(F.col("total") >= min_docs)
    loose = seen.where(F.col("state") == OPEN).join(F.broadcast(edges), ["a", "b"])
    if later:
        # A run that lies across an edge keeps the first of its rows; one that was dropped from within a partition began there.
        best = loose.groupBy("a", "b").agg(F.min(F.struct(F.col("doc").isNotNull().alias("k"), "doc", "body", "pos")).alias("best"))
        begun = seen.where(F.col("state") == DROP).join(F.broadcast(edges), ["a", "b"]).select("a", "b").distinct().withColumn("begun", F.lit(True))
        loose = loose.join(F.broadcast(best.join(begun, ["a", "b"], "left")), ["a", "b"])
        loose = loose.where(F.col("begun").isNotNull() | ~F.struct(F.col("doc").isNotNull().alias("k"), "doc", "body", "pos").eqNullSafe(F.col("best")))
    return seen.where(F.col("state") == DROP).select("doc", "body", "pos").unionByName(loose.select("doc", "body", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [zlib.compress((~np.packbits(np.bincount(np.asarray(p.values), minlength=1) > 0)).tobytes(), 1) for p in b.column(2)]
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["doc", "body", "bitmap"])


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, mode: str = "all", text: str = "text", key: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """doc, body (a hash of the text), bitmap: zlib over one bit a line up to the last dropped one, most
    significant bit first, 1 = keep; lines after it and documents without a row keep everything."""
    gone = dropped_lines(docs, min_docs, mode, text, key, min_chars).groupBy("doc", "body").agg(F.collect_set("pos").alias("pos"))
    return map_arrow(gone, _bitmaps, "doc bigint, body bigint, bitmap binary")


def _kept(text: bytes | None, bitmap: bytes | None) -> tuple[int, int, bytes]:
    """Lines before, lines dropped, text after."""
    lines = (text or b"").split(b"\n")
    if bitmap is None:
        return len(lines), 0, text or b""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), dtype=np.uint8))[: len(lines)]
    keep = np.ones(len(lines), dtype=bool)
    keep[: len(bits)] = bits.astype(bool)
    return len(lines), int(len(lines) - keep.sum()), b"\n".join([x for x, k in zip(lines, keep.tolist(), strict=True) if k])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs + __bitmap (null: keep all lines)."""
    b = bitmaps.select(F.col("doc").alias("__doc"), F.col("body").alias("__body"), F.col("bitmap").alias("__bitmap"))
    return docs.join(b, docs[key].cast("long").eqNullSafe(F.col("__doc")) & (F.xxhash64(docs[text]) == F.col("__body")), "left").drop("__doc", "__body")


@F.pandas_udf(StringType())
def _apply(texts: pd.Series, bitmaps: pd.Series) -> pd.Series:
    return pd.Series([t if t is None or b is None else _kept(t.encode(), b)[2].decode() for t, b in zip(texts, bitmaps, strict=True)], dtype=object)


def drop_lines(docs: DataFrame, min_docs: int = 10, mode: str = "all", text: str = "text", key: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """docs with the text that is left, all other columns as they were (n_chars, if there, follows)."""
    small_batches(docs.sparkSession)
    joined = with_bitmaps(docs, keep_bitmaps(docs, min_docs, mode, text, key, min_chars), text, key)
    left = F.when(F.col("__bitmap").isNull(), F.col(text)).otherwise(_apply(F.col(text), F.col("__bitmap")))
    joined = few_files(joined, docs.count())
    cols = [F.length("__left").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("__left").alias(c) if c == text else F.col(c) for c in docs.columns]
    return joined.withColumn("__left", left).select(*cols)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [_kept(t.as_py(), m.as_py()) for t, m in zip(b.column(1), b.column(2), strict=True)]
        yield pa.record_batch([b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[2]).hexdigest() for r in rows], pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = few_files(with_bitmaps(docs, keep_bitmaps(docs, min_docs=10, mode="all")), docs.count())
    return map_arrow(joined.select("doc_id", F.col("text").cast("binary"), "__bitmap"), _digests, "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string")


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, pos - 1 AS pos, line, translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
g AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, g.k IS NOT NULL AS gone FROM l LEFT JOIN g ON l.k = g.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
