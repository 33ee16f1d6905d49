"""Benchmark decontamination with an FM-index per training shard.

A task gathers documents into shards.  A word that no benchmark item has can stand in no match, and neither
can a stretch of benchmark words that is shorter than the shortest window; what is left of a shard is a
string collection over benchmark words, each stretch closed by a separator.  Of it an FM-index is built:
suffix array by prefix doubling, Burrows-Wheeler transform in a wavelet matrix, suffix positions sampled at
every 16th place and at each stretch's begin.  All windows of all items are searched backwards at once (two ranks
a word), their occurrences located by walking to the nearest sample, and the covered words of a
document merged into removal spans.  Documents never leave their task: there is no shuffle.

The benchmark goes to the tasks in blocks of at most ``block_words`` words, each searched in one pass over
the documents that carries the spans along: a benchmark of any size is searched, the driver holds one block at a
time, and what is broadcast is bounded and given back after its pass.

Defined results: null texts have no words; an item without words has no window; items with one id count
once; null item ids are the id "null"; an empty table or benchmark gives no hits; repeated rows give
repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written

#: Letters stay (A-Z lower-cased), digits and bytes from 0x80 on too; all else parts words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WINDOW, SAMPLE, BLOCK_WORDS = 10, 16, 2_000_000
SHARD_SYMBOLS, SHARD_WORDS, HASH_BUCKETS = 1_000_000, 4_000_000, 4096


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(WORD_BYTES).split()


class WaveletMatrix:
    """Ranks of symbols in an int array, for arrays of questions at once."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = max(1, int(top).bit_length())
        for shift in range(self.bits - 1, -1, -1):
            bit = (symbols >> shift) & 1 == 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, dtype=bool)
            padded[: len(bit)] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64)))[:-1].astype(np.int32)
            self.levels.append((words, before, int(len(bit) - bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))
        every = np.arange(int(top) + 1)
        self.base = self._down(every, np.zeros(len(every), dtype=np.int64))

    @staticmethod
    def _ones(level: tuple, i: np.ndarray) -> np.ndarray:
        words, before, _ = level
        w = i >> 6
        return before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)

    def _down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k, level in enumerate(self.levels):
            ones = self._ones(level, i)
            i = np.where((symbol >> (self.bits - 1 - k)) & 1 == 1, level[2] + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before place i."""
        return self._down(symbol, i) - self.base[symbol]

    def at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i, and how often it stands before."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for level in self.levels:
            ones = self._ones(level, i)
            bit = (level[0][i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1
            symbol = symbol << 1 | bit
            i = np.where(bit, level[2] + ones, i - ones)
        return symbol, i - self.base[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Of a collection: 0 is a separator (the last symbol is one), and separators differ by their place."""
    stops = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(stops) - 1
    rank[stops] = np.arange(len(stops))
    n, span = len(text), 1
    order = np.argsort(rank, kind="stable")
    key = rank[order]
    todo = np.arange(n)  # places of the order whose suffixes are not told apart yet
    while True:
        new = np.ones(len(key), dtype=bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, todo, 0))
        rank[order[todo]] = first
        alone = new & np.append(new[1:], True)
        todo = todo[~alone]
        if not len(todo):
            return order
        places = order[todo]
        key = (rank[places] << 32) | rank[places + span]
        by = np.argsort(key, kind="stable")
        order[todo], key = places[by], key[by]
        span *= 2


class FMIndex:
    def __init__(self, text: np.ndarray, top: int):
        """text: symbols 1 to top, 0 after each stretch."""
        order = suffix_array(text)
        before = text[order - 1]  # before the first place stands the last separator
        self.wavelet = WaveletMatrix(before.astype(np.int64), top)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled, self.nth, self.samples = sampled, np.cumsum(sampled) - 1, order[sampled]
        self.n = len(text)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: a row each.  The interval of suffixes that begin with it."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        live = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, j]
            low[live] = self.first[c] + self.wavelet.rank(c, low[live])
            high[live] = self.first[c] + self.wavelet.rank(c, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        rows = rows.copy()
        steps, live = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows))
        while len(live := live[~self.sampled[rows[live]]]):
            symbol, n = self.wavelet.at(rows[live])
            rows[live] = self.first[symbol] + n
            steps[live] += 1
        return self.samples[self.nth[rows]] + steps


class Benchmark:
    """Windows of some items, by length, with the items that have each of them."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in items for w in ws}))}
        self.names = sorted({name for name, _ in items})
        at = {name: i for i, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, ws in items:
            ids = [self.vocabulary[w] for w in ws]
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[k : k + window]), set()).add(at[name])
        self.groups: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for length in sorted({len(w) for w in found}):
            own = sorted(w for w in found if len(w) == length)
            self.groups[length] = np.array(own, dtype=np.int64), [np.array(sorted(found[w])) for w in own]
        self.shortest = min(self.groups, default=0)


class Shard:
    def __init__(self, bench: Benchmark):
        self.bench, self.docs, self.n_words, self.stretches, self.size, self.words = bench, [], [], [], 0, 0

    def add(self, texts: list[bytes | None], docs: list) -> None:
        every: list[bytes] = []
        begins = []
        for t in texts:
            ws = words_of(t)
            begins.append(len(every))
            self.n_words.append(len(ws))
            every += ws
            every.append(b"")
        base = len(self.docs)
        self.docs += docs
        self.words += len(every)
        if not self.bench.shortest:
            return
        ids = np.fromiter(map(self.bench.vocabulary.get, every, repeat(0)), dtype=np.int32, count=len(every))
        edge = np.diff(np.concatenate(([0], (ids > 0).astype(np.int8), [0])))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = z - a >= self.bench.shortest
        a, z = a[long], z[long]
        doc = np.searchsorted(begins, a, side="right") - 1
        # all stretches, each with the separator after it (a word of value 0, or the end of the text)
        lengths = z - a + 1
        offset = np.cumsum(lengths) - lengths
        symbols = ids[np.repeat(a - offset, lengths) + np.arange(lengths.sum())] if len(a) else ids[:0]
        if len(a):
            symbols[offset + lengths - 1] = 0
        self.stretches.append((symbols, lengths, doc + base, a - np.asarray(begins)[doc] if len(a) else a))
        self.size += len(symbols)

    def hits(self) -> tuple[list[list[tuple[int, int]]], list[list[str]]]:
        spans: list[list[tuple[int, int]]] = [[] for _ in self.docs]
        items: list[list[str]] = [[] for _ in self.docs]
        if not self.size:
            return spans, items
        text, lengths, doc, local = (np.concatenate(x) for x in zip(*self.stretches, strict=True))
        begin = np.cumsum(lengths) - lengths
        index = FMIndex(text, len(self.bench.vocabulary))
        step = np.zeros(len(text) + 1, dtype=np.int64)
        seen: list[np.ndarray] = []
        for length, (windows, owners) in self.bench.groups.items():
            low, high = index.search(windows)
            hit = np.flatnonzero(low < high)
            counts = (high - low)[hit]
            done = 0
            while done < len(hit):  # blocks of about a million occurrences
                upto = max(done + 1, int(np.searchsorted(np.cumsum(counts[done:]), 1_000_000, side="right")) + done)
                w, c = hit[done:upto], counts[done:upto]
                rows = np.repeat(low[w] - (np.cumsum(c) - c), c) + np.arange(c.sum())
                places = index.locate(rows)
                step += np.bincount(places, minlength=len(step)) - np.bincount(places + length, minlength=len(step))
                pairs = np.unique(doc[np.searchsorted(begin, places, side="right") - 1] * len(windows) + np.repeat(w, c))
                which = [owners[k] for k in (pairs % len(windows)).tolist()]
                seen.append(np.unique(np.repeat(pairs // len(windows), [len(x) for x in which]) * len(self.bench.names) + np.concatenate(which)))
                done = upto
        if not seen:
            return spans, items
        edge = np.diff(np.concatenate(([0], (np.cumsum(step)[:-1] > 0).astype(np.int8), [0])))
        a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        of = np.searchsorted(begin, a, side="right") - 1
        for d, s, e in zip(doc[of].tolist(), (local[of] + a - begin[of]).tolist(), (local[of] + z - begin[of]).tolist(), strict=True):
            spans[d].append((s, e))
        for k in np.unique(np.concatenate(seen)).tolist():
            items[k // len(self.bench.names)].append(self.bench.names[k % len(self.bench.names)])
        return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(batches: Iterator[pa.RecordBatch], bench: Benchmark, last: bool) -> Iterator[pa.RecordBatch]:
    shard, kept = Shard(bench), []

    def flush() -> Iterator[pa.RecordBatch]:
        spans, items = shard.hits()
        at = 0
        for b in kept:
            n = b.num_rows
            # spans of blocks before this one are in the batch
            old_spans, old_items = b.column(3).to_pylist(), b.column(4).to_pylist()
            s = [x if not o else merged([(y["start"], y["end"]) for y in o] + x) for o, x in zip(old_spans, spans[at : at + n], strict=True)]
            i = [sorted({*o, *x}) for o, x in zip(old_items, items[at : at + n], strict=True)]
            cols = [b.column(0), b.column(1), pa.array(shard.n_words[at : at + n], pa.int64()), pa.array([[{"start": p, "end": q} for p, q in x] for x in s], _SPANS), pa.array(i, pa.list_(pa.string()))]
            names = ["doc_id", "text", "n_words", "spans", "items"]
            if b.num_columns > 5:
                cols, names = [*cols, b.column(5)], [*names, "row"]
            yield pa.record_batch([c for c, k in zip(cols, names, strict=True) if k != "text" or not last], names=[k for k in names if k != "text" or not last])
            at += n

    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            b = whole.slice(at, 500)
            shard.add(b.column(1).to_pylist(), [None] * b.num_rows)
            kept.append(b.set_column(1, "text", pa.nulls(b.num_rows, pa.binary())) if last else b)
            if shard.size >= SHARD_SYMBOLS or shard.words >= SHARD_WORDS:
                yield from flush()
                shard, kept = Shard(bench), []
    yield from flush()


def blocks_of(benchmark: DataFrame, window: int, block_words: int, item: str, text: str) -> Iterator[tuple[Benchmark, bool]]:
    """One block at least, each of at most block_words words (or the items of one hash bucket), and whether it is
    the last.  Items are dealt into buckets by a hash, and neighbouring buckets make a block: the driver has the
    buckets' sizes (``HASH_BUCKETS`` rows at most) and one block at a time."""
    own = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("item"), F.col(text).cast("binary").alias("text"))
    own = own.withColumn("b", F.pmod(F.xxhash64("item", "text"), F.lit(HASH_BUCKETS)).cast("int"))
    most = F.ceil((F.coalesce(F.octet_length("text"), F.lit(0)) + 1) / 2)  # words part at a byte at least
    sizes = sorted((r["b"], r["n"]) for r in own.groupBy("b").agg(F.sum(most).alias("n")).collect())
    cuts: list[list[int]] = []
    size = 0
    for b, n in sizes:
        if not cuts or size + n > block_words:
            cuts.append([b, b])
            size = 0
        cuts[-1][1] = b
        size += n
    for k, (a, z) in enumerate(cuts or [[0, 0]]):
        rows = own.where(F.col("b").between(a, z)).select("item", "text").collect()
        yield Benchmark([(r[0], words_of(bytes(r[1]) if r[1] is not None else None)) for r in rows], window), k >= len(cuts) - 1


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", carry: bool = False) -> DataFrame:
    """doc_id, n_words, spans (word positions to remove, ends excluded, merged), items (ids, sorted) and, if
    carry, row (a struct of docs' columns)."""
    df = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("binary").alias("text"), F.lit(0).cast("long").alias("n_words"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.array().cast("array<string>").alias("items"), *[F.struct(*docs.columns).alias("row")] * carry)
    row = f", row {df.schema['row'].dataType.simpleString()}" if carry else ""
    kind = df.schema["doc_id"].dataType.simpleString()
    for bench, last in blocks_of(benchmark, window, block_words, item, item_text):
        shared = df.sparkSession.sparkContext.broadcast(bench)
        df = map_arrow(df, lambda it, shared=shared, last=last: _scan(it, shared.value, last), f"doc_id {kind}, " + "text binary, " * (not last) + "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>" + row)
        if not last:
            df = written(df, "spans", regroup=False)
            shared.destroy()
    return df


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs without those in which a window of an item occurs."""
    found = find_overlaps(docs, benchmark, window, text=text, key=key, carry=True)
    return found.where(F.size("spans") == 0).select("row.*")


def cut_spans(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """The text without the words of the spans and what stands between them."""
    if text is None or not spans:
        return text
    raw = text.encode()
    flat = np.frombuffer(raw.translate(WORD_BYTES), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate(([0], flat.astype(np.int8), [0])))
    a, z = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : a[s]])
        at = z[e - 1]
    return b"".join([*out, raw[at:]]).decode()


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, len(s) AS k, array_to_string(s, ' ') AS s
  FROM (SELECT item_id, unnest([w[i:least(i + 9, len(w))] FOR i IN range(1, greatest(len(w) - 8, 2))]) AS s FROM iw WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM dw, ks WHERE len(w) >= k),
occ AS (SELECT pos.doc_id, pos.i, pos.k, win.item_id FROM (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM pos) pos JOIN win ON win.k = pos.k AND win.s = pos.s),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
