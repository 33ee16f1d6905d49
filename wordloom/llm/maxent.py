"""LM scoring with a hashed maximum-entropy model.

P(word | history) = P(class | history) * P(leaf | class, history) * P(word | leaf).  The class softmax has a weight for each
class and hashed feature of the history: the word before, the two before, the one before the last (a skip), the last
three words' classes, and two classes that skip one.  A class is a binary tree of ``LEVELS`` levels by its words' hashes:
at each node a softmax of two, with hashed weights for the three word features, takes the smoothed counts of both sides for a start
and learns from there.  Within a leaf, words go by their smoothed counts, with one place kept for a word
never seen; all of it sums to one.

1. Counts.  A pass over the training rows counts words (64-bit hashes) and which word endings stand next to
   each other.  Endings fall into ``BUCKETS`` buckets, and buckets with like neighbours become one of ``CLASSES`` classes
   (the end of text is a class of its own).
2. Weights.  In every round each task starts from the current weights, makes AdaGrad updates over its share of the
   training tokens (every position of every text is a target in one of the rounds), and sends what became of the rows
   it touched; the mean over tasks that touched a row is its new weight.  Sums are made in two steps, blocks
   of rows at a time: weights are ``ROWS`` x ``CLASSES`` and ``NODES`` numbers whatever the input.
3. Scores.  A pass over all documents sums, in batches of numpy arrays, both softmaxes and the logarithms
   of frequent words' counts.  A word is frequent if it makes up 1/FREQUENT of all tokens, so at most
   FREQUENT words are broadcast; the rest leave the task as (document, word, times) and meet their counts in a join.

Defined results: null and empty texts are one token, the end; null ids are learned from (no remainder is 0);
without training rows N and V are 0 and all words unknown; repeated rows count and are scored each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wordhash
from .common import NARROW, few_files, map_arrow, table, written

BUCKETS, CLASSES, ROWS, FREQUENT, ALPHA = 1024, 24, 1 << 15, 1_000_000, 0.1
LEVELS, NODES = 5, 1 << 18
#: Updates of nodes: the step, and what stands for earlier gradients at first; a node's start is the counts, so it moves slowly.
NODE_STEP, NODE_POWER, NODE_BATCH = 0.1, 50.0, 8192
ROUNDS, STEP, BATCH, BLOCK = 2, 0.3, 4096, 64
END_CLASS = CLASSES - 1
#: Node weights are sent in blocks of so many, numbered from NODE_BLOCK on.
NODE_BLOCK, NODE_SIZE = 1 << 20, 4096
#: The end of a text is no word: its own hash and, for want of an ending, bucket.
END_HASH, END_BUCKET = -1, BUCKETS
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Rows that a counting task holds before it sends them on.
MOST_HELD = 1_500_000


def read(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and ending buckets of all texts, each text closed by its end, and where each begins."""
    b = wordhash.Batch(texts)
    n = len(b.hash) + len(texts)
    at = np.arange(len(b.hash)) + np.repeat(np.arange(len(texts)), b.count)
    hashes, buckets = np.full(n, END_HASH), np.full(n, END_BUCKET)
    hashes[at] = b.hash
    buckets[at] = (b.last(3).view(np.uint64) * _MIX >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    sizes = b.count + 1
    return hashes, buckets, np.cumsum(sizes) - sizes


def _texts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


# --- counts -----------------------------------------------------------------------------------------------


def _merged(h: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    first = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[first], bucket[order][first], np.add.reduceat(n[order], first)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (kind, k, bucket, n): 0 for a word, 1 for two adjacent buckets (k = first * BUCKETS + second)."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pairs = np.zeros(BUCKETS * BUCKETS, dtype=np.int64)

    def rows(kind: int, k: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pa.array(np.full(len(k), kind, dtype=np.int8)), pa.array(k), pa.array(bucket.astype(np.int32)), pa.array(n)], names=["kind", "k", "bucket", "n"])

    for b in _texts(batches):
        hashes, bucket, _ = read(b.column(0).to_pylist())
        held.append(_merged(hashes, bucket, np.ones(len(hashes), dtype=np.int64)))
        if sum(len(x[0]) for x in held) > MOST_HELD:
            held = [_merged(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if len(held[0][0]) > MOST_HELD // 2:
                yield rows(0, *held.pop())
        inside = (bucket[1:] < BUCKETS) & (bucket[:-1] < BUCKETS)
        pairs += np.bincount(bucket[:-1][inside] * BUCKETS + bucket[1:][inside], minlength=len(pairs))
    if held:
        yield rows(0, *_merged(*(np.concatenate(x) for x in zip(*held, strict=True))))
    k = np.flatnonzero(pairs)
    yield rows(1, k, k // BUCKETS, pairs[k])


def classes_of(pairs: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A class for each bucket: k-means over the leading directions of who stands next to whom."""
    both = (pairs + pairs.T).astype(float)
    total = both.sum(1)
    scaled = both / np.sqrt(np.outer(total + 1, total + 1))
    u, s, _ = np.linalg.svd(scaled, hermitian=True)
    dims = u[:, 1:17] * s[1:17]
    points = dims / (np.linalg.norm(dims, axis=1, keepdims=True) + 1e-9)
    k = CLASSES - 1
    # centers start at heavy buckets far from those before them
    centers = [int(np.argmax(weight))]
    near = np.full(len(points), np.inf)
    for _ in range(k - 1):
        near = np.minimum(near, ((points - points[centers[-1]]) ** 2).sum(1))
        centers.append(int(np.argmax(near * np.sqrt(weight + 1e-9))))
    c = points[centers]
    own = np.zeros(len(points), dtype=np.int64)
    for _ in range(30):
        own = np.argmin(((points[:, None] - c[None]) ** 2).sum(2), axis=1)
        for j in range(k):
            if (w := weight * (own == j)).sum() > 0:
                c[j] = (points * w[:, None]).sum(0) / w.sum()
    return own


# --- weights ----------------------------------------------------------------------------------------------


def _back(x: np.ndarray, begin: np.ndarray, place: np.ndarray, by: int, none: int) -> np.ndarray:
    """x, by places earlier in the same text; none before its first."""
    out = np.full(len(x), none, dtype=x.dtype)
    if by < len(x):
        out[by:] = x[:-by]
    out[place < by] = none
    return out


def places(begins: np.ndarray, n: int) -> np.ndarray:
    """Of each of n tokens: how many come before it in its text."""
    return np.arange(n) - np.repeat(begins, np.diff(np.append(begins, n)))


def features(word: np.ndarray, classes: np.ndarray, begins: np.ndarray, picked: slice | np.ndarray = slice(None)) -> np.ndarray:
    """(tokens, 5): the weight rows of the histories of the picked tokens."""
    place = places(begins, len(word))
    word, cls = word.view(np.uint64), classes.astype(np.uint64)
    w1, w2 = (_back(word, begins, place, k, 7)[picked] for k in (1, 2))
    c1, c2, c3, c4 = (_back(cls, begins, place, k, CLASSES)[picked] for k in (1, 2, 3, 4))
    keys = [w1 * np.uint64(3), w2 * np.uint64(5) + np.uint64(1), (w1 * np.uint64(31)) ^ (w2 * np.uint64(17)), (c1 * np.uint64(64) + c2) * np.uint64(64) + c3 + np.uint64(1 << 40), (c2 * np.uint64(64) + c4) + np.uint64(1 << 41)]
    shift = np.uint64(64 - ROWS.bit_length() + 1)
    return np.stack([((k ^ (k >> np.uint64(29))) * _MIX >> shift).astype(np.int32) for k in keys], axis=1)


def softmax(weights: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row: the classes' sums of weights, their exponentials, and the sum of those."""
    z = weights[f[:, 0]]
    for j in range(1, f.shape[1]):
        z += weights[f[:, j]]
    z += weights[-1]  # the classes' own
    np.clip(z, -40, 40, out=z)
    e = np.exp(z)
    return z, e, e @ np.ones(e.shape[1], dtype=e.dtype)


def leaves_of(word: np.ndarray) -> np.ndarray:
    """Of each word the leaf of its class: the last bits of its hash."""
    return word & ((1 << LEVELS) - 1)


_LEAF, _DEPTH = np.arange(1 << LEVELS)[:, None], np.arange(LEVELS)
#: By leaf and level: the node above (numbered from the root's 0), and the side that leads to the leaf.
_NODE, _SIDE = (1 << _DEPTH) - 1 + (_LEAF >> (LEVELS - _DEPTH)), (_LEAF >> (LEVELS - 1 - _DEPTH)) & 1
#: By class and leaf, in one row: what tells a class's nodes from all others.
_OWN = ((np.arange(CLASSES)[:, None, None] * 64 + _NODE + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).reshape(-1, LEVELS)


class Nodes:
    """The trees of the classes: ``base`` (class and leaf, level) from counts, and hashed weights."""

    def __init__(self, mass: np.ndarray):
        """mass: (classes, leaves)."""
        self.weights = np.zeros(NODES, dtype=np.float32)
        sides = [mass.reshape(len(mass), 1 << d, 2, -1).sum(3) for d in range(LEVELS)]
        nodes = np.concatenate([np.log(s[:, :, 1] / s[:, :, 0]) for s in sides], axis=1).astype(np.float32)
        self.base = nodes[:, _NODE].reshape(-1, LEVELS)

    @staticmethod
    def keys(word: np.ndarray, begins: np.ndarray, picked: slice | np.ndarray = slice(None)) -> np.ndarray:
        """(3, tokens): the word before, the one before that, and both."""
        place = places(begins, len(word))
        word = word.view(np.uint64)
        w1, w2 = (_back(word, begins, place, k, 7)[picked] for k in (1, 2))
        keys = np.stack((w1 * np.uint64(3), w2 * np.uint64(5) + np.uint64(1), (w1 * np.uint64(31)) ^ (w2 * np.uint64(17))))
        return (keys ^ (keys >> np.uint64(29))) * _MIX

    def read(self, keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, tokens, levels): where the weights stand; (tokens, levels): the side taken, and the sums of weights."""
        w = self.weights if weights is None else weights
        own = cls * (1 << LEVELS) + leaf
        at = (((keys[:, :, None] ^ _OWN[own]) * _MIX) >> np.uint64(64 - NODES.bit_length() + 1)).view(np.int64)
        return at, _SIDE[leaf], self.base[own] + w[at[0]] + w[at[1]] + w[at[2]]

    def logs(self, keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Of each token the logarithm of its leaf's probability; the end of a text has its class to itself."""
        _, side, z = self.read(keys, cls, leaf)
        away = np.where(side == 1, -z, z)
        # log(1 + e^x), without overflow
        return np.where(cls == END_CLASS, 0.0, -(np.maximum(away, 0) + np.log1p(np.exp(-np.abs(away)))) @ np.ones(LEVELS))


def _train(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bucket_class: np.ndarray, turn: int, rounds: int = ROUNDS, nodes: Nodes | None = None) -> Iterator[pa.RecordBatch]:
    """One task's updates: (block of weight rows, the sums of touched rows, how many tasks touched them); so for nodes."""
    own = None if nodes is None else nodes.weights.copy()
    own_power, own_touched = (None, None) if nodes is None else (np.full(NODES, NODE_POWER, dtype=np.float32), np.zeros(NODES, dtype=np.float32))

    def learn_nodes(keys: np.ndarray, cls: np.ndarray, leaf: np.ndarray) -> None:
        at, side, z = nodes.read(keys, cls, leaf, own)
        grad = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - side
        sums = np.bincount(at.ravel(), np.tile(grad.ravel(), len(at)), NODES).astype(np.float32)
        hit = np.flatnonzero(sums)
        own_power[hit] += sums[hit] ** 2
        own[hit] -= NODE_STEP * sums[hit] / np.sqrt(own_power[hit])
        own_touched[hit] = 1

    w = weights.copy()
    power = np.full(len(w), 1e-2, dtype=np.float32)  # AdaGrad's, one for a row
    touched = np.zeros(len(w), dtype=np.float32)

    def update(rows: np.ndarray, grad: np.ndarray) -> None:
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # by radix: 0 to ROWS fit 16 bits
        r = rows[order]
        first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
        step(r[first], np.add.reduceat(grad[order], first, axis=0))

    def step(r: np.ndarray, g: np.ndarray) -> None:
        power[r] += (g * g).mean(1)
        w[r] -= STEP / np.sqrt(power[r])[:, None] * g / np.sqrt(CLASSES)
        touched[r] = 1

    for b in _texts(batches):
        hashes, buckets, begins = read(b.column(0).to_pylist())
        classes = bucket_class[buckets]
        # by the place in the text, not in the batch: whatever the batches, all rounds together take each position once
        picked = np.flatnonzero(places(begins, len(hashes)) % rounds == turn)
        f, y = features(hashes, classes, begins, picked), classes[picked]
        for at in range(0, len(y), BATCH):
            fb, yb = f[at : at + BATCH], y[at : at + BATCH]
            _, e, total = softmax(w, fb)
            grad = e / total[:, None]
            grad[np.arange(len(yb)), yb] -= 1
            for j in range(fb.shape[1]):
                update(fb[:, j], grad)
            step(np.array([len(w) - 1]), grad.sum(0, keepdims=True))
        if nodes is not None:
            words = picked[y != END_CLASS]
            keys, leaf, cls = Nodes.keys(hashes, begins, words), leaves_of(hashes[words]), classes[words]
            for at in range(0, len(words), NODE_BATCH):
                part = slice(at, at + NODE_BATCH)
                learn_nodes(keys[:, part], cls[part], leaf[part])
    sums = w * touched[:, None]
    n = -(-len(w) // BLOCK)
    starts = [i * BLOCK for i in range(n) if touched[i * BLOCK : (i + 1) * BLOCK].any()]
    rows = [(s // BLOCK, sums[s : s + BLOCK], touched[s : s + BLOCK]) for s in starts]
    if nodes is not None:
        parts = [(NODE_BLOCK + i, slice(i * NODE_SIZE, (i + 1) * NODE_SIZE)) for i in range(NODES // NODE_SIZE)]
        rows += [(k, own[part] * own_touched[part], own_touched[part]) for k, part in parts if own_touched[part].any()]
    yield pa.record_batch([pa.array([k for k, _, _ in rows], pa.int32()), pa.array([x.tobytes() for _, x, _ in rows], pa.binary()), pa.array([x.tobytes() for _, _, x in rows], pa.binary())], names=["block", "sums", "tasks"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by (block, part), which a task gets whole; a block's running sum is all it holds."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for block, sums, tasks in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            new = [np.frombuffer(sums, dtype=np.float32), np.frombuffer(tasks, dtype=np.float32)]
            held[block] = [x + y for x, y in zip(held[block], new, strict=True)] if block in held else new
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x, _ in held.values()], pa.binary()), pa.array([y.tobytes() for _, y in held.values()], pa.binary())], names=["block", "sums", "tasks"])


def _round(rows: DataFrame, weights: np.ndarray, bucket_class: np.ndarray, nodes: Nodes, turn: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """New weights of classes and of nodes."""
    shape = "block int, sums binary, tasks binary"
    shared = rows.sparkSession.sparkContext.broadcast((weights, bucket_class, nodes))
    sent = map_arrow(rows, lambda it: _train(it, *shared.value[:2], turn, rounds, shared.value[2]), shape)
    # first among neighbouring tasks, then for each block
    some = map_arrow(sent.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64))).repartition("part", F.pmod("block", F.lit(8))).select("block", "sums", "tasks"), _add_up, shape)
    whole = map_arrow(some.repartition("block"), _add_up, shape)
    new, new_nodes = weights.copy(), nodes.weights.copy()
    for r in whole.toLocalIterator():  # ROWS / BLOCK + 1 rows, and NODES / NODE_SIZE
        if r["block"] >= NODE_BLOCK:
            at = slice((r["block"] - NODE_BLOCK) * NODE_SIZE, (r["block"] - NODE_BLOCK + 1) * NODE_SIZE)
            sums, tasks = (np.frombuffer(r[c], dtype=np.float32) for c in ("sums", "tasks"))
            new_nodes[at] = np.where(tasks > 0, sums / np.maximum(tasks, 1), new_nodes[at])
            continue
        at = r["block"] * BLOCK
        sums, tasks = np.frombuffer(r["sums"], dtype=np.float32).reshape(-1, CLASSES), np.frombuffer(r["tasks"], dtype=np.float32)
        new[at : at + len(sums)] = np.where(tasks[:, None] > 0, sums / np.maximum(tasks, 1)[:, None], new[at : at + len(sums)])
    shared.unpersist()
    return new, new_nodes


# --- scores -----------------------------------------------------------------------------------------------


class Model:
    """mass: (classes, leaves), the smoothed count of all words of a leaf and of one never seen."""

    def __init__(self, counts: DataFrame, n: int, v: int, bucket_class: np.ndarray, mass: np.ndarray, weights: np.ndarray, nodes: Nodes):
        self.counts, self.n, self.v, self.bucket_class, self.mass, self.weights, self.nodes = counts, n, v, bucket_class, mass, weights, nodes


def train(docs: DataFrame, text: str = "text", rounds: int = ROUNDS) -> Model:
    """docs: the training rows."""
    rows = docs.select(F.col(text).cast("binary"))
    seen = written(map_arrow(rows, _count, "kind tinyint, k bigint, bucket int, n bigint").groupBy("kind", "k", "bucket").agg(F.sum("n").alias("n")), "counts", regroup=False)
    counts = seen.where("kind = 0").select("k", "bucket", "n")
    by = counts.groupBy("bucket", F.col("k").bitwiseAND((1 << LEVELS) - 1).alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()  # a row a bucket and leaf
    leaf_n, leaf_v = np.zeros((BUCKETS + 1, 1 << LEVELS), dtype=np.int64), np.zeros((BUCKETS + 1, 1 << LEVELS), dtype=np.int64)
    for r in by:
        leaf_n[r["bucket"], r["leaf"]], leaf_v[r["bucket"], r["leaf"]] = r["n"], r["v"]
    bucket_n = leaf_n.sum(1)
    pairs = np.zeros(BUCKETS * BUCKETS)
    adjacent = seen.where("kind = 1").select("k", "n").toArrow()  # BUCKETS squared rows at most
    pairs[np.asarray(adjacent["k"])] = np.asarray(adjacent["n"])
    bucket_class = np.append(classes_of(pairs.reshape(BUCKETS, BUCKETS), bucket_n[:BUCKETS].astype(float)), END_CLASS)
    class_n = np.bincount(bucket_class, bucket_n, CLASSES)
    mass = np.full((CLASSES, 1 << LEVELS), ALPHA)
    np.add.at(mass, bucket_class, leaf_n + ALPHA * leaf_v)
    weights = np.zeros((ROWS + 1, CLASSES), dtype=np.float32)
    weights[-1] = np.log((class_n + 1) / (class_n.sum() + CLASSES))
    nodes = Nodes(mass)
    for turn in range(rounds):
        weights, nodes.weights = _round(rows, weights, bucket_class, nodes, turn, rounds)
    return Model(counts, int(bucket_n.sum()), int(leaf_v.sum()), bucket_class, mass, weights, nodes)


def _score(batches: Iterator[pa.RecordBatch], weights: np.ndarray, bucket_class: np.ndarray, frequent: tuple[np.ndarray, np.ndarray], log_n: float, log_mass: np.ndarray, nodes: Nodes) -> Iterator[pa.RecordBatch]:
    """A row for each document (sums without its rarer words) and one for each rarer word of it."""
    counts = wordhash.Table(len(frequent[0]) + 1)
    counts.put(*frequent)
    names = ["row", "doc_id", "n_tokens", "n_known", "base", "score", "k", "times"]

    def class_logs(f: np.ndarray, y: np.ndarray) -> np.ndarray:
        z, _, total = softmax(weights, f)
        return z[np.arange(len(y)), y].astype(float) - np.log(total)

    for b in _texts(batches):
        hashes, buckets, begins = read(b.column(2).to_pylist())
        classes = bucket_class[buckets]
        f = features(hashes, classes, begins)
        leaf, keys = leaves_of(hashes), Nodes.keys(hashes, begins)
        parts = [slice(i, i + 8192) for i in range(0, len(f), 8192)]
        logs = np.concatenate([class_logs(f[p], classes[p]) + nodes.logs(keys[:, p], classes[p], leaf[p]) for p in parts]) / np.log(10)
        c = counts.get(hashes)
        common = c >= 0
        word = np.where(common, np.log10(np.maximum(c, 0) + ALPHA), 0.0)
        n = np.diff(np.append(begins, len(hashes)))
        base = np.add.reduceat(word, begins) - n * log_n
        score = np.add.reduceat(word + logs - log_mass[classes, leaf], begins)
        row = b.column(0)
        size = b.num_rows
        none = pa.nulls(size, pa.int64())
        yield pa.record_batch([row, b.column(1), pa.array(n), pa.array(np.add.reduceat((common & (c > 0)).astype(np.int64), begins)), pa.array(base), pa.array(score), none, none], names=names)
        rare = np.flatnonzero(~common)
        if len(rare):
            doc = np.searchsorted(begins, rare, side="right") - 1
            order = np.lexsort((hashes[rare], doc))
            doc, k = doc[order], hashes[rare][order]
            key = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (k[1:] != k[:-1])))
            times = np.diff(np.append(key, len(k)))
            size = len(key)
            none, zero = pa.nulls(size, pa.int64()), pa.nulls(size, pa.float64())
            yield pa.record_batch([row.take(pa.array(doc[key])), pa.nulls(size, b.column(1).type), none, none, zero, zero, pa.array(k[key]), pa.array(times)], names=names)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, n_known, base_score, score (log10)."""
    least = max(1, -(-model.n // FREQUENT))
    often = model.counts.where(F.col("n") >= least).select("k", "n").toArrow()  # FREQUENT rows at most: each has 1/FREQUENT of the tokens
    k, n = np.asarray(often["k"].combine_chunks()), np.asarray(often["n"].combine_chunks())
    order = np.argsort(k)
    log_n = float(np.log10(model.n + ALPHA * (model.v + 1)))
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bucket_class, (k[order], n[order]), log_n, np.log10(model.mass), model.nodes))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("doc_id"), F.col(text).cast("binary"))
    made = written(map_arrow(rows, lambda it: _score(it, *shared.value), f"row bigint, doc_id {kind}, n_tokens bigint, n_known bigint, base double, score double, k bigint, times bigint"), "scores", regroup=False)
    # a rarer word's count is below least and its rows are spread over documents: no key is hot
    rare = made.where(F.col("k").isNotNull()).select("row", "k", "times").join(model.counts.where(F.col("n") < least).select("k", "n"), "k", "left")
    c = F.coalesce("n", F.lit(0))
    rest = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(c + F.lit(ALPHA))).alias("more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("known"))
    done = few_files(made.where(F.col("k").isNull()).drop("k", "times").join(rest, "row", "left"), made.where(F.col("k").isNull()).count(), NARROW)
    more, known = F.coalesce("more", F.lit(0.0)), F.coalesce("known", F.lit(0))
    return done.select(F.col("doc_id").alias(key), "n_tokens", (F.col("n_known") + known).alias("n_known"), (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"))


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
