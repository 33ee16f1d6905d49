"""Packing by shortest-pack-first over the length histogram.

1. Texts become token ids (a closing id after each) and are cut into pieces of at most ``size`` ids; a piece
   is a few numbers and a checksum.
2. The histogram of piece lengths has at most ``size`` rows, whatever the input.  On it alone the plan is
   made: lengths are placed longest first, each into the packs that are the shortest so far (most room),
   updating the counts of packing patterns; where nothing has room, new packs open, holding as many pieces
   of that length as fit.
3. A pattern that occurs c times takes c pieces of each of its lengths: an interval of ranks among the pieces of a length.
   Pieces are ranked within their length and look their interval up, which gives sequence and offset.

Ranks: a length may hold a third of all pieces, so a length with many is split by a hash into groups of
about ``rank_group`` pieces, each starting at the running sum of the groups before it; repeated rows are
counted, not kept.  The plan has at most two patterns for each length and under 100 lengths in a pattern
(distinct lengths that sum to ``size``), so what is sent to the executors is bounded by ``size``.

Defined results: a null or empty text is one piece of the closing id; repeated rows are packed once each;
an empty table gives no rows; ids are whole numbers or null (text that is none is an error); other columns are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NARROW, each_of, few_files, map_arrow, table, written
from .wordhash import Batch, Table

SIZE, END_ID = 4096, 2


def _normal(word: str) -> str:
    """As the tokenizer sees it: some letters become a letter and a mark when lower-cased, and marks join marks."""
    return word if word.isascii() else unicodedata.normalize("NFC", word).lower()


class Encoder:
    """Ids of texts, in numpy arrays.  The tokenizer's own splitting never joins across white space, nor letters
    with marks: a text is a list of blank-free chunks, a chunk a word and the marks after it.  Chunks are
    told apart by 64-bit hashes; each has a number, and its ids a place in one array.  Only new words are
    encoded.  When ``most`` chunks are known the memory starts anew."""

    MARKS = b".,;:!?"

    def __init__(self, path: str, end_id: int = END_ID, most: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end, self.most = Tokenizer.from_file(path), end_id, most
        self.encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.marks: dict[bytes, bytes] = {b"": b""}
        self._forget()

    def _forget(self) -> None:
        # number 0 is the end of a text
        self.table, self.flat, self.lengths, self.starts = Table(), np.array([self.end], dtype="<u4"), np.array([1]), np.array([0])

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.encode(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> dict[str, bytes]:
        """Words of letters alone are one unit for the tokenizer, whose last id says so: they go in one string."""
        ids = np.frombuffer(self._ids([" ".join(words)])[0], dtype="<u4") if words else np.empty(0, dtype="<u4")
        ends = 4 * (np.flatnonzero(self.last[ids]) + 1)
        if len(ends) != len(words):  # a tokenizer without word ends
            return dict(zip(words, self._ids(words), strict=True))
        raw, begins = ids.tobytes(), [0, *ends.tolist()]
        return {w: raw[i:j] for w, i, j in zip(words, begins, begins[1:], strict=False)}

    def _learn(self, chunks: list[bytes]) -> None:
        bare = [c.rstrip(self.MARKS) for c in chunks]
        text = b"\n".join(bare).decode().split("\n")
        plain = [w.isalpha() and _normal(w).isalpha() for w in text]
        known = self._words(list(dict.fromkeys(w for w, ok in zip(text, plain, strict=True) if ok)))
        ends = [c[len(w) :] for c, w in zip(chunks, bare, strict=True)]
        if len(self.marks) > 10_000:
            self.marks = {b"": b""}
        marks = self.marks
        for m in {e for e, ok in zip(ends, plain, strict=True) if ok and e not in marks}:
            marks[m] = self._ids([m.decode()])[0]
        # All else is encoded whole: a mark before it can belong to what follows, as in "'s".
        whole = iter(self._ids([c.decode() for c, ok in zip(chunks, plain, strict=True) if not ok]))
        ids = [known[w] + marks[e] if ok else next(whole) for w, e, ok in zip(text, ends, plain, strict=True)]
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(ids), dtype="<u4")))
        self.lengths = np.concatenate((self.lengths, np.array([len(x) // 4 for x in ids], dtype=np.int64)))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian ids of each text, the end's last."""
        if self.table.size > self.most:
            self._forget()
        # Strings of special tokens are matched before letters are lower-cased, so such texts go as they are.
        special = {i: self._ids([t.decode()])[0] + self.flat[:1].tobytes() for i, t in enumerate(texts) if t is not None and b"<|" in t}
        batch = Batch([None if i in special else t for i, t in enumerate(texts)])
        number = self.table.get(batch.hash)
        missing = np.flatnonzero(number < 0)
        if len(missing):
            new, first, back = np.unique(batch.hash[missing], return_index=True, return_inverse=True)
            numbers = len(self.lengths) + np.arange(len(new))
            self._learn(batch.words(missing[first]))
            self.table.put(new, numbers)
            number[missing] = numbers[back]
        chunk = np.zeros(len(number) + len(texts), dtype=np.int64)
        chunk[np.arange(len(number)) + np.repeat(np.arange(len(texts)), batch.count)] = number
        n = self.lengths[chunk]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(self.starts[chunk] - (upto - n), n) + np.arange(int(n.sum()))].tobytes()
        ends = (4 * upto[np.cumsum(batch.count + 1) - 1]).tolist()
        return [special.get(i, ids[a:z]) for i, (a, z) in enumerate(zip([0, *ends], ends, strict=False))]


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    """One for all tasks that a Python worker runs."""
    return Encoder(path, end_id)


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, size: int, end_id: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    encode = _encoder(path, end_id)
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            b = whole.slice(at, 256)
            texts = b.column(1).to_pylist()
            rows: list[tuple] = []
            for i, ids in enumerate(encode(texts)):
                n = len(ids) // 4
                for s in range(0, n, size):
                    piece = ids[4 * s : 4 * (s + size)]
                    rows.append((i, s, len(piece) // 4, zlib.crc32(piece), n, piece))
            i, s, length, crc, n, pieces = zip(*rows, strict=True)
            cols = [b.column(0).take(pa.array(i)), *(pa.array(x, pa.int64()) for x in (s, length, crc, n))]
            if with_ids:
                cols.append(pa.array([np.frombuffer(p, dtype="<u4").astype(np.int32) for p in pieces], pa.list_(pa.int32())))
            yield pa.record_batch(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: len(cols)])


def pieces_of(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, end_id: int = END_ID, text: str = "text", key: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens and, on demand, the ids."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids
    return map_arrow(docs.select(F.col(key).cast("long"), F.col(text).cast("binary")), lambda it: _cut(it, tokenizer_path, size, end_id, with_ids), schema)


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """[(count, ((length, copies), ...)), ...] for a histogram {length: pieces}."""
    open_packs: dict[int, list[tuple[int, tuple]]] = defaultdict(list)  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        added: list[tuple[int, int, tuple]] = []
        for room in sorted((r for r in open_packs if r >= length), reverse=True):
            packs, fits = open_packs[room], room // length
            while left and packs:
                count, pattern = packs.pop()
                # as many copies as fit, over as many packs as the pieces last for
                copies = fits if left >= count * fits else max(1, left // count)
                used = min(count, left // copies)
                if used < count:
                    packs.append((count - used, pattern))
                left -= used * copies
                added.append((room - copies * length, used, (*pattern, (length, copies))))
            if not packs:
                del open_packs[room]
            if not left:
                break
        for copies in (size // length, left % (size // length)):
            if left and copies and (used := left // copies):
                left -= used * copies
                added.append((size - copies * length, used, ((length, copies),)))
        for room, used, pattern in added:
            open_packs[room].append((used, pattern))
    return [x for room in sorted(open_packs) for x in open_packs[room]]


def plan_intervals(patterns: list[tuple[int, tuple[tuple[int, int], ...]]]) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, first offset), in order."""
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            rows.append((length, taken[length], copies, sequence, offset))
            taken[length] += count * copies
            offset += length * copies
        sequence += count
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _place(batches: Iterator[pa.RecordBatch], plan: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = (plan[:, 0] << 48) + plan[:, 1]
    for b in batches:
        length, rank = np.asarray(b.column(2)), np.asarray(b.column(5))
        row = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
        nth, copies = rank - row[:, 1], row[:, 2]
        yield pa.record_batch([*b.columns[:5], pa.array(row[:, 3] + nth // copies), pa.array(row[:, 4] + nth % copies * length)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])


def pack_pieces(pieces: DataFrame, size: int = SIZE, rank_group: int = 256) -> DataFrame:
    """pieces (as pieces_of makes them, without ids) + sequence_id, offset."""
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = written(pieces.select(*cols), "pieces")
    lengths = pieces.groupBy("length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in lengths.collect()}  # at most size rows
    plan = plan_intervals(shortest_pack_first(histogram, size))
    # Groups of about rank_group pieces of a length; a repeated row is one row with a count.
    groups = lengths.select("length", F.greatest(F.lit(1), F.ceil(F.col("n") / rank_group)).cast("long").alias("groups"))
    own = pieces.join(F.broadcast(groups), "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.col("groups")))
    own = own.groupBy("length", "part", "doc_id", "start", "ids_crc32", "doc_tokens").agg(F.count("*").alias("n"))
    sums = own.groupBy("length", "part").agg(F.sum("n").alias("m"))
    starts = sums.select("length", "part", (F.sum("m").over(Window.partitionBy("length").orderBy("part")) - F.col("m")).alias("before"))
    within = Window.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    ranked = own.join(starts, ["length", "part"]).withColumn("first", F.col("before") + F.sum("n").over(within) - F.col("n"))
    ranked = each_of(ranked, "first", "n", "rank", ["length", "part", *cols[:2]]).select(*cols, "rank")
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    return few_files(map_arrow(ranked, lambda it: _place(it, plan), schema), sum(histogram.values()), NARROW)


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    return pack_pieces(pieces_of(docs, tokenizer_path, size, end_id, text, key), size)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
