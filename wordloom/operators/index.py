"""A stored positional index, for concordances that read only what they show.

Two tables lie in the folder that driver and executors share, both written without a shuffle.  Documents stay as texts, in
folders by block (the task that wrote them).  Postings are in folders by a hash of the word: a row has the words of a bucket
in one segment of a block (an Arrow batch of documents), and for each of them its places in the segment's running text, as
gaps.  A search reads the folder of its word's bucket (an expression those of all buckets, but no text), finds rows and places,
and reads and cuts the documents of blocks that have hits: all other folders are pruned from the scan.

Defined results: as ``kwic.kwic_in_rows`` on the same documents, whose ids may be null or repeat; a word that occurs nowhere gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import discard, stored

from . import kwic
from .annotate import NativeAnnotator

BUCKETS = 16
#: Places that are sent to the executors whole.
MOST_SENT = 500_000
_POSTINGS = {"bucket": "int", "block": "int", "segment": "bigint", "words": "array<string>", "counts": "array<int>", "n_docs": "array<int>", "gaps": "array<int>", "rows": "array<bigint>", "starts": "array<int>"}


def _segments(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(block, row, words) to rows of _POSTINGS."""
    for no, whole in enumerate(batches):
        segment = (TaskContext.get().partitionId() << 24) + no
        blocks = np.asarray(whole.column(0))
        for block in np.unique(blocks).tolist():
            b = whole if (blocks == block).all() else whole.filter(pa.array(blocks == block))
            words = b.column(2).flatten().dictionary_encode()
            code, n = np.asarray(words.indices), len(words.dictionary)
            if not n:
                continue
            lengths = np.asarray(b.column(2).value_lengths())
            starts = np.cumsum(lengths, dtype=np.int32) - lengths
            # the words of a bucket one after the other, and each word's places in order
            bucket = np.array([zlib.crc32(w.encode()) % buckets for w in words.dictionary.to_pylist()], dtype=np.int32)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.arange(n)
            place = np.argsort(rank[code], kind="stable").astype(np.int32)
            counts = np.bincount(rank[code], minlength=n).astype(np.int32)
            first = np.zeros(len(place), dtype=bool)
            first[np.cumsum(counts) - counts] = True
            doc = np.searchsorted(starts, place, side="right")
            new = first.copy()
            new[1:] |= doc[1:] != doc[:-1]
            n_docs = np.add.reduceat(new, np.cumsum(counts) - counts, dtype=np.int32)
            gaps = np.where(first, place, np.diff(place, prepend=np.int32(0))).astype(np.int32)
            found, size = np.unique(bucket, return_counts=True)
            k = len(found)
            cut = np.concatenate(([0], np.cumsum(size)))  # words by bucket
            edges = np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))[cut]  # places by bucket

            def lists(values: pa.Array, at: np.ndarray) -> pa.ListArray:
                return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

            every = np.arange(k + 1) * b.num_rows
            rows = lists(pa.array(np.tile(np.asarray(b.column(1)), k)), every)
            columns = [pa.array(found), pa.array(np.full(k, block, dtype=np.int32)), pa.array(np.full(k, segment)), lists(words.dictionary.take(pa.array(order)), cut), lists(pa.array(counts), cut), lists(pa.array(n_docs), cut), lists(pa.array(gaps), edges), rows, lists(pa.array(np.tile(starts, k)), every)]
            yield pa.record_batch(columns, names=list(_POSTINGS))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, words, meant, counts, gaps, rows, starts) to (block, row, place, key) of the words that are meant."""
    for b in batches:
        for block, words, meant, counts, gaps, rows, starts in zip(*(b.column(i) for i in range(7)), strict=True):
            meant, counts, gaps, rows, starts = (x.values.to_numpy(zero_copy_only=False) for x in (meant, counts, gaps, rows, starts))
            end = np.cumsum(counts)
            places, keys = [], []
            for i in np.flatnonzero(meant).tolist():
                places.append(np.cumsum(gaps[end[i] - counts[i] : end[i]]))
                keys += [words[i].as_py()] * int(counts[i])
            place = np.concatenate(places)
            doc = np.searchsorted(starts, place, side="right") - 1
            # documents without tokens begin where the next one does
            yield pa.record_batch([pa.array(np.full(len(place), block.as_py(), dtype=np.int32)), pa.array(rows[doc]), pa.array((place - starts[doc]).astype(np.int32)), pa.array(keys, pa.string())], names=["block", "row", "place", "key"])


@dataclass(frozen=True)
class Index:
    documents: DataFrame
    postings: DataFrame
    by: NativeAnnotator
    unit: str
    buckets: int
    keep: tuple[str, ...]

    def vocabulary(self) -> DataFrame:
        """word, n, n_docs."""
        words = self.postings.select(F.explode(F.arrays_zip("words", "counts", "n_docs")).alias("x"))
        return words.groupBy(F.col("x.words").alias("word")).agg(F.sum("x.counts").alias("n"), F.sum("x.n_docs").alias("n_docs"))

    def hits(self, query: str, regex: bool = False, case_sensitive: bool = True) -> DataFrame:
        """block, row, place (of the token in its document, from 0), key."""
        read = self.postings
        if not regex and case_sensitive:
            read = read.where(F.col("bucket") == zlib.crc32(query.encode()) % self.buckets)
        meant = F.transform("words", lambda w: F.coalesce(kwic.matches(w, query, regex, case_sensitive), F.lit(False)))
        rows = read.withColumn("meant", meant).where(F.exists("meant", lambda x: x)).select("block", "words", "meant", "counts", "gaps", "rows", "starts")
        return rows.mapInArrow(_found, "block int, row bigint, place int, key string")

    def kwic(self, query: str, window: int = 5, regex: bool = False, case_sensitive: bool = True, display: str = "surface") -> DataFrame:
        """As ``kwic.kwic_in_rows``, from the documents that have hits."""
        asked = stored(self.hits(query, regex, case_sensitive).groupBy("block", "row").agg(F.sort_array(F.collect_list("place")).alias("places")), "hits")  # no more than a document has tokens
        blocks = [r["block"] for r in asked.select("block").distinct().collect()]  # at most as many as tasks wrote documents
        # few places go to the texts; many would be too large to send, and meet them by a shuffle
        few = (asked.agg(F.sum(F.size("places"))).first()[0] or 0) <= MOST_SENT
        docs = self.documents.where(F.col("block").isin(blocks)).join(F.broadcast(asked) if few else asked, ["block", "row"])
        return kwic.lines_at(self.by.in_rows(docs, carry=(*self.keep, "places")), "places", self.unit, window, display, self.keep)

    def discard(self) -> None:
        discard(self.documents, self.postings)


def build(docs: DataFrame, by: NativeAnnotator, unit: str = "lemma", keep: tuple[str, ...] = (), buckets: int = BUCKETS) -> Index:
    """docs: doc_id, text, the annotator's language column and keep, columns that concordances show."""
    named = dict.fromkeys(("doc_id", *([by.language_col] if by.language_col else []), *keep))
    own = docs.select(*named, "text", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("block"))
    documents = stored(own, "documents", by="block")
    tokens = by.in_rows(documents, carry=("block", "row"), function_words=False)
    words = tokens.select("block", "row", F.transform("t", lambda x: x[unit]).alias("words"))
    postings = stored(words.mapInArrow(lambda it: _segments(it, buckets), ", ".join(f"{c} {k}" for c, k in _POSTINGS.items())), "postings", by="bucket")
    return Index(documents, postings, by, unit, buckets, keep)
