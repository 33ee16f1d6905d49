"""SimHash near-dedup at a Jaccard similarity: wide fingerprints, BK-trees of shards, and an exact check.

1. A text is the set of its shingles' 64-bit hashes.  Texts with equal sets are one node from here on.
2. A node's fingerprint has ``WIDTH`` bits (SimHash of the set: four independent 64-bit mixes of each hash).  Two sets of similarity s
   differ in a share acos(2s / (1 + s)) / pi of them, so ``settings`` derives from the similarity a radius that only one pair in a hundred
   at exactly that similarity exceeds; closer pairs are missed far more rarely.
3. Shards.  A node is filed under several keys, each of some of the fingerprint's bits: as many bits as leave about
   ``CELL`` unrelated nodes in a shard, and as many keys as let only one pair in a hundred at exactly the similarity share none.
4. Roots.  Every node first asks the first ``ROOTS`` nodes of its shards and is checked against the ``NEAREST`` of all those; a
   large group of copies grows together here at a few checks a node.  Components by contraction.
5. Trees.  The nodes of a shard that are outside its largest component form BK-trees (``simhash.BKForest``: children keyed by
   integer Hamming distance to the parent), and all nodes of the shard follow the edges within the radius.  A shard
   of more than ``SHARD`` nodes has its trees sent to each of the tasks among which its nodes are dealt, in parts of that size:
   no task holds more than two parts.  Pairs of one component are left out, others appear under their first common key.
6. Every candidate pair is checked exactly, and the components are made final.

Defined results: null and empty texts have the empty set and are copies of each other only; a text of fewer words
than a shingle is one shingle; words are compared with ASCII letters lower-cased; equal rows count as copies; null ids are kept
like others; which row of a group stays follows ``simhash.keep_one``, whose ties the text's hash decides; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import NARROW, discard, few_files, if_small, join_hot, map_arrow, written
from .graph import components
from .wordhash import Batch

SHINGLE, SIMILARITY, WIDTH, CELL, SHARD, ROOTS, NEAREST = 5, 0.8, 256, 64, 2048, 16, 4
_WORDS = WIDTH // 64
#: A cell is the number of a key above its bits, of which there are fewer.
KEY_SHIFT = 48
_ADD = [np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)) for i in range(_WORDS + 1)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, sorted within each, and how many each text has."""
    b = Batch(texts)
    words, begin = b.hash.view(np.uint64), np.cumsum(b.count) - b.count
    size = np.where(b.count >= shingle, b.count - shingle + 1, np.minimum(b.count, 1))
    text = np.repeat(np.arange(len(texts)), size)
    at = begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    length = np.minimum(b.count, shingle)[text]
    found = np.zeros(len(text), dtype=np.uint64)
    for j in range(shingle):
        more = length > j
        next_word = words[np.where(more, at + j, 0)] if len(words) else found
        found = np.where(more, _mix(found * np.uint64(31) + next_word), found)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], np.bincount(text[new], minlength=len(texts))


def fingerprints_of(found: np.ndarray, size: np.ndarray, part: int = 20_000) -> np.ndarray:
    """(texts, WIDTH / 8) octets: a bit is 1 if over half of the text's hashes have it."""
    text = np.repeat(np.arange(len(size)), size)
    sums = np.zeros((len(size), WIDTH), dtype=np.int64)
    for s in range(0, len(found), part):
        h, t = found[s : s + part], text[s : s + part]
        mixed = np.stack([_mix(h + add) for add in _ADD[:_WORDS]], axis=1)
        bits = np.unpackbits(mixed.view(np.uint8).reshape(len(h), -1), axis=1, bitorder="little")
        first = np.flatnonzero(np.append(True, t[1:] != t[:-1]))
        sums[t[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > size[:, None], axis=1, bitorder="little")


def node_of(found: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One number for each set."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(_mix(found + _ADD[-1]), dtype=np.uint64)))
    end = np.cumsum(size)
    return _mix((total[end] - total[end - size]) ^ size.astype(np.uint64)).view(np.int64)


@dataclass(frozen=True)
class Settings:
    radius: int
    keys: np.ndarray  # (keys, bits): places in a fingerprint


def settings(nodes: int, similarity: float = SIMILARITY, missed: float = 0.01) -> Settings:
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    z = 2.33  # one in a hundred of a normal distribution lies beyond
    radius = math.ceil(WIDTH * apart + z * math.sqrt(WIDTH * apart * (1 - apart)))
    bits = max(8, (nodes // CELL).bit_length())
    n = max(1, math.ceil(math.log(missed) / math.log1p(-((1 - apart) ** bits))))
    rng = np.random.default_rng(52)
    return Settings(radius, np.stack([rng.choice(WIDTH, bits, replace=False) for _ in range(n)]))


def key_bits(octets: np.ndarray, places: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))


def _octets(c: pa.Array) -> np.ndarray:
    raw = b"".join(c.to_pylist())
    return np.frombuffer(raw, dtype=np.uint8).reshape(-1, WIDTH // 8)


def _numbers(c: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.asarray(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)


def _sketched(docs: DataFrame, shingle: int, text: str, key: str) -> DataFrame:
    """key, body (a hash of the text), node (of its set), n (the set's size), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                found, size = shingle_sets(b.column(2).to_pylist(), shingle)
                fp = [x.tobytes() for x in fingerprints_of(found, size)]
                yield pa.record_batch([b.column(0), b.column(1), pa.array(node_of(found, size)), pa.array(size.astype(np.int64)), pa.array(fp, pa.binary())], names=["key", "body", "node", "n", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.col(text).cast("binary")), run, f"key {kind}, body bigint, node bigint, n bigint, fp binary")


def _filed(nodes: DataFrame, chosen: Settings) -> DataFrame:
    """nodes (node, n, label, fp) once for each key: cell (the key's number and its bits) and those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                octets = _octets(b.column(3))
                for k, places in enumerate(chosen.keys):
                    yield pa.record_batch([pa.array(key_bits(octets, places) | np.int64(k << KEY_SHIFT)), *b.columns], names=["cell", "node", "n", "label", "fp"])

    return map_arrow(nodes.select("node", "n", "label", "fp"), run, "cell bigint, node bigint, n int, label bigint, fp binary")


class Cells:
    """Rows (cell, part, side, node, n, label, fp) sorted by their first two columns, some whole cells at a time."""

    def __init__(self, t: pa.Table):
        cols = [_numbers(t.column(i)) for i in range(6)]
        new = np.ones(t.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols[:2]])
        self.cell, self.start = np.cumsum(new) - 1, np.flatnonzero(new)
        self.k, self.side, self.node, self.n, self.label = cols[0] >> KEY_SHIFT, *cols[2:]
        self.octets = _octets(t.column(6).combine_chunks())
        self.words = np.ascontiguousarray(self.octets).view("<u8").reshape(-1, _WORDS)

    def distance(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.words[a] ^ self.words[b]).sum(1, dtype=np.int64)


def _whole_cells(batches: Iterator[pa.RecordBatch], most: int = 60_000) -> Iterator[Cells]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= most:  # all cells but the last, which may go on
            t = pa.Table.from_batches(held)
            same = np.logical_and.reduce([(c := _numbers(t.column(i))) == c[-1] for i in range(2)])
            if not same.all():
                cut = int(np.flatnonzero(~same)[-1]) + 1
                yield Cells(t.slice(0, cut))
                held = t.slice(cut).combine_chunks().to_batches()
                rows -= cut
    if held:
        yield Cells(pa.Table.from_batches(held))


def _pairs(a: np.ndarray, b: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(d)], names=["a", "b", "d"])


def _ask_roots(batches: Iterator[pa.RecordBatch], radius: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b, d): of each node of a cell, the nearest of its first few nodes, if that is within the radius."""
    for c in _whole_cells(batches):
        ends = np.append(c.start[1:], len(c.cell))
        best, which = np.full(len(c.cell), WIDTH + 1), np.zeros(len(c.cell), dtype=np.int64)
        every = np.arange(len(c.cell))
        for j in range(ROOTS):
            root = np.minimum(c.start + j, ends - 1)[c.cell]
            d = c.distance(every, root)
            d[(root == every) | (np.minimum(c.n, c.n[root]) < similarity * np.maximum(c.n, c.n[root]) - 1e-9)] = WIDTH + 1
            which = np.where(d < best, root, which)
            best = np.minimum(best, d)
        near = np.flatnonzero(best <= radius)
        yield _pairs(c.node[near], c.node[which[near]], best[near])


def _search_trees(batches: Iterator[pa.RecordBatch], chosen: Settings, similarity: float) -> Iterator[pa.RecordBatch]:
    """(a, b, d): pairs of different labels within the radius, under the first key that both have in common."""
    for c in _whole_cells(batches):
        # a cell's largest component asks and is not asked: it needs no tree
        order = np.lexsort((c.label, c.cell))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (c.label[order][1:] != c.label[order][:-1]) | (c.cell[order][1:] != c.cell[order][:-1])
        first = np.flatnonzero(new)
        run, of = np.diff(np.append(first, len(order))), c.cell[order][first]
        by = np.lexsort((run, of))
        last = by[np.flatnonzero(np.append(of[by][1:] != of[by][:-1], True))]
        top = c.label[order][first][last]  # by cell
        tree = np.flatnonzero((c.side != 1) & (c.label != top[c.cell])) if len(c.cell) else np.empty(0, dtype=np.int64)
        if not len(tree):
            continue
        asks = np.flatnonzero(c.side != 0)
        asks = asks[np.isin(c.cell[asks], c.cell[tree])]
        forest = simhash.BKForest(c.words[tree], c.cell[tree], int(c.cell.max()) + 1, WIDTH)
        for q, item in forest.search(c.words[asks], c.cell[asks], chosen.radius):
            a, b = asks[q], tree[item]
            # two that have trees find each other twice
            twice = (c.side[a] == 2) & (c.label[a] != top[c.cell[a]]) & (c.node[a] > c.node[b])
            ok = (c.label[a] != c.label[b]) & ~twice & (np.minimum(c.n[a], c.n[b]) >= similarity * np.maximum(c.n[a], c.n[b]) - 1e-9)
            a, b = a[ok], b[ok]
            if not len(a):
                continue
            differ = np.unpackbits(c.octets[a] ^ c.octets[b], axis=1, bitorder="little")
            k = c.k[a]
            before = np.zeros(len(a), dtype=bool)
            for j, places in enumerate(chosen.keys):
                before |= (k > j) & ~differ[:, places].any(axis=1)
            a, b = a[~before], b[~before]
            yield _pairs(np.minimum(c.node[a], c.node[b]), np.maximum(c.node[a], c.node[b]), c.distance(a, b))


_ROW = ["cell", "part", "side", "node", "n", "label", "fp"]


def _laid(rows: DataFrame) -> DataFrame:
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select(*_ROW).repartition(n, "cell", "part").sortWithinPartitions("cell", "part", F.xxhash64("node", "cell"))


def _part(n: Column, salt: str) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(salt)), n).cast("int")


def _large(filed: DataFrame, shard: int) -> DataFrame:
    """cell, qp (parts of the nodes) of shards with more than shard nodes."""
    return filed.groupBy("cell").agg(F.count("*").alias("m")).where(F.col("m") > shard).select("cell", F.ceil(F.col("m") / shard).cast("int").alias("qp"))


def _root_pairs(filed: DataFrame, large: DataFrame, chosen: Settings, similarity: float) -> DataFrame:
    rows = filed.join(if_small(large), "cell", "left").withColumn("part", F.when(F.col("qp").isNull(), 0).otherwise(_part(F.col("qp"), "q")).cast("long")).withColumn("side", F.lit(2).cast("byte"))
    asked = map_arrow(_laid(rows), lambda it: _ask_roots(it, chosen.radius, similarity), "a bigint, b bigint, d bigint")
    # a node has a row for each of its keys at most
    nearest = asked.groupBy("a").agg(F.collect_set(F.struct("d", "b")).alias("m")).select("a", F.explode(F.slice(F.sort_array("m"), 1, NEAREST)["b"]).alias("b"))
    return nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _tree_pairs(filed: DataFrame, large: DataFrame, chosen: Settings, similarity: float, shard: int) -> DataFrame:
    inside = filed.join(if_small(large), "cell").groupBy("cell", "label", "qp").agg(F.count("*").alias("m"))
    top = inside.groupBy("cell", "qp").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("m"))
    split = written(top.select("cell", "qp", F.col("top.label").alias("top"), F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("top.m")) / shard)).cast("int").alias("tp")), "split")
    small = filed.join(if_small(split.select("cell")), "cell", "left_anti").withColumn("part", F.lit(0).cast("long")).withColumn("side", F.lit(2).cast("byte"))
    big = filed.join(if_small(split), "cell")
    part = (F.shiftleft(F.col("q").cast("long"), 32) + F.col("t")).alias("part")
    # of a large shard: each node asks every part of the trees, and each part of the trees goes to every part of the nodes
    asks = big.withColumn("q", _part(F.col("qp"), "q")).withColumn("t", F.explode(F.sequence(F.lit(0), F.col("tp") - 1))).withColumn("side", F.lit(1).cast("byte"))
    trees = big.where("label <> top").withColumn("t", _part(F.col("tp"), "t")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qp") - 1))).withColumn("side", F.lit(0).cast("byte"))
    laid = _laid(small.select(*_ROW).unionByName(asks.withColumn("part", part).select(*_ROW)).unionByName(trees.withColumn("part", part).select(*_ROW)))
    return map_arrow(laid, lambda it: _search_trees(it, chosen, similarity), "a bigint, b bigint, d bigint").select("a", "b").distinct()


def _checked(pairs: DataFrame, docs: DataFrame, bodies: DataFrame, similarity: float, shingle: int, text: str, key: str) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough.  Sets are made of the texts that occur in a pair, each taken from one
    of its documents: copies, which may be a third of all rows, share a text but not a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 200):
                b = whole.slice(at, 200)
                found, size = shingle_sets(b.column(1).to_pylist(), shingle)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))), pa.int32()), pa.array(found.view(np.int64)))
                yield pa.record_batch([b.column(0), lists], names=["node", "items"])

    needed = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    wanted = written(bodies.join(needed, "node", "left_semi"), "wanted")
    own = docs.select(F.xxhash64(text).alias("__body"), F.col(key).alias("__key"), F.col(text).cast("binary").alias("text"))
    texts = own.join(if_small(wanted), (F.col("__body") == F.col("body")) & F.col("__key").eqNullSafe(F.col("key"))).groupBy("node").agg(F.first("text").alias("text"))
    sets = written(map_arrow(texts.select("node", "text"), run, "node bigint, items array<bigint>"), "sets", regroup=False)
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b")
    common = both.select("a", "b", (F.size("x") + F.size("y")).alias("sizes"), F.size(F.array_intersect("x", "y")).alias("common"))
    out = written(common.where(F.col("common") >= F.lit(similarity) * (F.col("sizes") - F.col("common")) - F.lit(1e-9)).select("a", "b"), "confirmed")
    discard(sets, wanted)
    return out


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id", shard: int = SHARD) -> DataFrame:
    """key, body, label (the same for all rows that links of at least this similarity connect)."""
    rows = written(_sketched(docs, shingle, text, key), "sketched")
    nodes = written(rows.where("n > 0").groupBy("node").agg(F.first("n").cast("int").alias("n"), F.first("fp").alias("fp"), F.min(F.struct("body", "key")).alias("one"), F.count("*").alias("copies")), "nodes")
    chosen = settings(nodes.count(), similarity)
    bodies = nodes.select("node", "one.body", "one.key")
    filed = written(_filed(nodes.withColumn("label", F.col("node")), chosen), "filed", regroup=False)
    large = written(_large(filed, shard), "large")
    pairs = written(_root_pairs(filed, large, chosen, similarity), "pairs")
    links = _checked(pairs, docs, bodies, similarity, shingle, text, key)
    discard(filed, pairs)
    found = components(links)
    labelled = nodes.join(found.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    filed = written(_filed(labelled, chosen), "filed", regroup=False)
    pairs = written(_tree_pairs(filed, large, chosen, similarity, shard), "pairs")
    links = links.unionByName(_checked(pairs, docs, bodies, similarity, shingle, text, key))
    discard(filed, pairs, large, found)
    found = components(links)
    # copies share a node: what many rows have is broadcast, not met by a shuffle
    labels = written(nodes.select("node", "copies").join(found.withColumnRenamed("v", "node"), "node", "left").select("node", "copies", F.coalesce("label", "node").alias("label")), "named")
    total = rows.count()
    named = join_hot(rows.where("n > 0").select("key", "body", "node"), labels, "node", "copies", total).select("key", "body", "label")
    empty = rows.where("n = 0").select("key", "body", F.col("node").alias("label"))
    return few_files(named.unionByName(empty).select(F.col("key").alias(key), "body", "label"), total, NARROW)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near copies, chosen as in ``simhash.keep_one``."""
    return simhash.first_of(docs, near_copies(docs, shingle, similarity, text, key), text, key)
