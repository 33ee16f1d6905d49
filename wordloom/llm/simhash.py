"""SimHash near-dedup: fingerprints linked by radius searches in BK-trees.

1. A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it.
2. Equal fingerprints become one node first: copies, however many, are one row from here on.
3. Shards.  Two fingerprints that differ in at most ``radius`` bits agree in at least ``blocks - radius`` of
   ``blocks`` bit blocks, so each fingerprint is filed under every choice of that many blocks (with 5 and 3: ten
   keys of about 25 bits), and all links are found within shards.  A shard of more than ``shard_size``
   fingerprints is split into parts of about that size, and every part is searched by the fingerprints of every other: exact, and
   no task holds more than two parts.
4. Within a shard a BK-tree is built (a child is keyed by its integer Hamming distance to its parent), and
   each fingerprint follows only edges within ``radius`` of its own distance.  All trees of a task are built
   and searched together, level by level, on arrays.  What leaves a task is a spanning forest of its links.
5. Components of the links by contraction (``graph.components``).

Defined results: null and empty texts have fingerprint 0, which links like any other; a text of fewer words
than a shingle is one shingle; repeated rows stay; a null id is never a component's name unless all its ids
are null; an empty table gives no rows; other columns are ignored or, in ``keep_one``, kept.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW, few_files, join_hot, map_arrow, table, written
from .graph import components

SHINGLE, RADIUS, BLOCKS, SHARD_SIZE = 3, 3, 5, 4096


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    words = (text or b"").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    h = np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], dtype="<u8")
    octets, n = h.view(np.uint8).reshape(-1, 8), len(h)
    # bits are counted by octet value: eight small histograms instead of 64 numbers a shingle
    counts = np.stack([np.bincount(octets[:, i], minlength=256) for i in range(8)]) @ _BITS_OF if n > 64 else np.unpackbits(octets, axis=1, bitorder="little").sum(0, dtype=np.int64).reshape(8, 8)
    return int(np.packbits(counts.ravel() * 2 > n, bitorder="little").view("<u8")[0])


_BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, body (a hash of the text), fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(2)], dtype=np.uint64).astype(np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp)], names=["key", "body", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("body"), F.col(text).cast("binary")), run, f"key {kind}, body bigint, fp bigint")


def hex_of(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """One key for each choice of blocks - radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]

    def mask(chosen: tuple[int, ...]) -> int:
        m = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        return m - (1 << 64) if m >> 63 else m

    choices = list(itertools.combinations(range(blocks), blocks - radius))
    return F.array(*(F.struct(F.lit(i).cast("short").alias("choice"), fp.bitwiseAND(F.lit(mask(c)).cast("long")).alias("bits")) for i, c in enumerate(choices)))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = np.bitwise_count(a ^ b)
    return d.astype(np.int64) if d.ndim == 1 else d.sum(1, dtype=np.int64)


class BKForest:
    """A BK-tree for each shard: ``fp`` by item (one 64-bit number, or a row of them), ``shard`` numbers from 0,
    equal fingerprints of a shard apart."""

    def __init__(self, fp: np.ndarray, shard: np.ndarray, n_shards: int, width: int = 64):
        self.fp, self.root, self.width = fp, np.full(n_shards, -1, dtype=np.int64), width
        item, group = np.arange(len(fp)), shard.astype(np.int64)  # a group waits at one place of a tree
        keys, children = [], []
        level, span = 0, width + 1
        while len(item):
            order = np.argsort(group, kind="stable")
            item, group = item[order], group[order]
            new = np.append(True, group[1:] != group[:-1])
            node = item[new][np.cumsum(new) - 1]  # the first of a group becomes the node there
            if level == 0:
                self.root[group[new]] = item[new]
            else:
                keys.append(group[new])
                children.append(item[new])
            item, node = item[~new], node[~new]
            group = node * span + _distance(fp[item], fp[node])
            level += 1
        key = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        order = np.argsort(key)
        self.edges, self.children = key[order], (np.concatenate(children) if children else key)[order]

    def search(self, fp: np.ndarray, shard: np.ndarray, radius: int, block: int = 1_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (question, item) within the radius."""
        node, span = self.root[shard], self.width + 1
        stack = [(np.flatnonzero(node >= 0), node[node >= 0])]
        while stack:
            q, node = stack.pop()
            if len(q) > block:
                stack += [(q[i : i + block], node[i : i + block]) for i in range(0, len(q), block)]
                continue
            d = _distance(fp[q], self.fp[node])
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            low = np.searchsorted(self.edges, node * span + np.maximum(d - radius, 0))
            n = np.searchsorted(self.edges, node * span + np.minimum(d + radius, self.width), side="right") - low
            if total := int(n.sum()):
                at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(total)
                stack.append((np.repeat(q, n), self.children[at]))


class Union:
    """Labels of items under links that come in blocks."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[a], label[b]
            apart = a != b
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            low, high = np.minimum(a, b), np.maximum(a, b)
            np.minimum.at(label, high, low)
            while True:
                to = label[label]
                if (to == label).all():
                    break
                label[:] = to


def _link(batches: Iterator[pa.RecordBatch], radius: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (choice, bits, part_a, part_b, side, fp), those of a cell together: links (a, b)."""

    def solve(t: pa.Table) -> pa.RecordBatch | None:
        cols = [np.asarray(t.column(i).combine_chunks()) for i in range(6)]
        fp = cols[5].view(np.uint64)
        new = np.zeros(len(fp), dtype=bool)
        new[0] = True
        for c in cols[:4]:
            new[1:] |= c[1:] != c[:-1]
        cell = np.cumsum(new) - 1
        more = np.bincount(cell)[cell] > 1
        if not more.any():
            return None
        cell, side, fp = np.unique(cell[more], return_inverse=True)[1], cols[4][more], fp[more]
        tree, asks = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # 2: both
        forest, union = BKForest(fp[tree], cell[tree], int(cell.max()) + 1), Union(len(fp))
        for q, item in forest.search(fp[asks], cell[asks], radius):
            union.add(asks[q], tree[item])
        other = np.flatnonzero(union.label != np.arange(len(fp)))
        pairs = np.unique(np.stack((fp[union.label[other]], fp[other])), axis=1)
        return pa.record_batch([pa.array(pairs[0].view(np.int64)), pa.array(pairs[1].view(np.int64))], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows >= most:
            # all cells but the last, which may go on
            t = pa.Table.from_batches(held).combine_chunks()
            keys = [np.asarray(t.column(i).combine_chunks()) for i in range(4)]
            same = np.logical_and.reduce([k == k[-1] for k in keys])
            cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
            if cut:
                if (out := solve(t.slice(0, cut))) is not None:
                    yield out
                held = t.slice(cut).to_batches()
                rows -= cut
    if held and (out := solve(pa.Table.from_batches(held))) is not None:
        yield out


def link(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Links (a, b) that span what the distinct fingerprints ``fp`` within the radius connect."""
    if not 0 <= radius < blocks:
        raise ValueError("radius must be below blocks")
    filed = nodes.select("fp", F.explode(shard_keys(F.col("fp"), radius, blocks)).alias("k")).select("fp", "k.choice", "k.bits")
    sizes = filed.groupBy("choice", "bits").agg(F.count("*").alias("n")).where("n > 1").withColumn("parts", F.ceil(F.col("n") / shard_size).cast("int")).drop("n")
    own = filed.join(sizes, ["choice", "bits"]).withColumn("part", F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int"))
    # A part is a tree for itself and those after it, and asks those before it.
    cells = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda i: F.struct(
            F.least(i, F.col("part")).alias("a"),
            F.greatest(i, F.col("part")).alias("b"),
            F.when(i == F.col("part"), 2).when(i < F.col("part"), 1).otherwise(0).cast("byte").alias("side"),
        ),
    )
    rows = own.select("choice", "bits", "fp", F.explode(cells).alias("c")).select("choice", "bits", "c.a", "c.b", "c.side", "fp")
    # split shards lie on their own choice and bits: what a task sorts is many cells, of which each is small
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartition(n, "choice", "bits", "a", "b").sortWithinPartitions("choice", "bits", "a", "b", "fp")
    return map_arrow(laid, lambda it: _link(it, radius, 100_000), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, body, fp, component_id (the smallest key that links lead to), label (one fingerprint of the group, its
    name where keys fail), copies (rows with this fingerprint)."""
    fps = written(fingerprints(docs, shingle, text, key), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("key").alias("id"), F.count("*").alias("copies")), "nodes")
    found = components(link(nodes.select("fp"), radius, blocks))
    labelled = nodes.join(found.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    names = labelled.groupBy("label").agg(F.min("id").alias("component_id"), F.count("*").alias("nodes"))
    groups = written(join_hot(labelled, names, "label", "nodes", nodes.count()).select("fp", "component_id", "label", "copies"), "groups")
    n = fps.count()
    return few_files(join_hot(fps, groups, "fp", "copies", n).select(F.col("key").alias(key), "body", "fp", "component_id", "label", "copies"), n, NARROW)


def keep_one(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, blocks: int = BLOCKS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each group of near duplicates: that of the smallest key (rows that share it: of the
    smallest hash of their texts; equal rows: any; rows without key come last)."""
    return first_of(docs, near_duplicates(docs, shingle, radius, blocks, text, key), text, key)


def first_of(docs: DataFrame, groups: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with one row of each label of groups (key, body, label), as in ``keep_one``.

    A label may have a third of all rows: its first row is found by partial minima, and docs are then joined by
    the rows that stay, one a label, so no join is by label."""
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("body").alias("body"))
    best = groups.groupBy("label").agg(F.min(rank).alias("best"))
    stay = written(best.select(F.col("best.key").alias("__key"), F.col("best.body").alias("__body")), "stay")
    left = docs.join(stay, docs[key].eqNullSafe(stay["__key"]) & (F.xxhash64(docs[text]) == stay["__body"]), "left_semi")
    # Rows that repeat id and text are of one group: one of each stays, by partial firsts.
    again = groups.groupBy(F.col(key).alias("__key"), F.col("body").alias("__body")).agg(F.count("*").alias("m")).where("m > 1")
    if again.isEmpty():
        return few_files(left, stay.count())
    first = left.groupBy(F.col(key).alias("__key"), F.xxhash64(text).alias("__body")).agg(F.first(F.struct(*docs.columns)).alias("row"))
    return first.select("row.*")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
