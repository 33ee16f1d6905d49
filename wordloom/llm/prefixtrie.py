"""The prefix trie of conversations, as succinct level-order tries.

A node is a distinct sequence of first turns; a conversation is a member of the nodes along its turns.

1. Turns become narrow rows at once: hashes of role and text, and the text's length.  A stream over a conversation's
   rows in order gives each turn its depth and the hash (128 bits) of all turns up to it; no conversation is held.
2. Rows are counted by that hash: the nodes, with their members.
3. Nodes with very many members are the upper levels.  What hangs below them falls into subtries, which are dealt to
   shards by the hash of their top node: a first turn that a third of all conversations share has its subtries all over.
4. For each shard, numpy puts its nodes into level order and builds the LOUDS bit vector (for each node a one
   for each child, then a zero), with arrays of labels and counts beside it.  Parents are read off the bits; sums over
   subtries are made level by level from the deepest, with ``np.add.at``.
5. What the subtries' tops sum up to goes to their upper nodes, which make one small trie of their own.

Upper nodes have over a 100,000th of all conversations as members (and over ``heavy`` of them), so there are at most 100,000 times
as many as a conversation has turns on average, however many conversations there are.  A node's closing members are hashed
as a stream of their numbers, in order, put together from pieces of text that tasks make side by side.

Defined results: turns of a conversation that are equal in number come in the order of role, then of the text's hash, a null
number first; null roles and texts are empty; rows without a conversation's id have no part; repeated rows are turns
like others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, table, written

#: Octets of a piece of text that goes into a hash.
PIECE = 1 << 16


def turns(conversations: DataFrame, key: str = "conv_id") -> DataFrame:
    """conv_id, i (from 0), label, other (two hashes of role and text), chars."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    narrow = conversations.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), "turn", role.alias("role"), F.xxhash64(role, text).alias("label"), F.xxhash64(F.lit("other"), role, text).alias("other"), F.length(text).cast("long").alias("chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "label", "other")
    return narrow.withColumn("i", (F.row_number().over(order) - 1).cast("long")).select("conv_id", "i", "label", "other", "chars")


def rebuilt(own: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """conv_id, part, i, label, other, chars: a conversation's rows in the order of (part, i).  Part -1 is one row
    without a turn; part 0 the first h turns of the conversation its group begins with, part 1 its own after the first h."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    first = F.col("conv_id") - F.col("conv_id") % group
    every = own.select("conv_id").distinct().select("conv_id", h.alias("h"), first.alias("first"))
    heads = own.where((F.col("conv_id") == first) & (F.col("i") < most - 1)).groupBy(F.col("conv_id").alias("first")).agg(F.sort_array(F.collect_list(F.struct("i", "label", "other", "chars"))).alias("t"))  # at most most - 1 turns
    none = F.lit(0).cast("long")
    marks = every.select("conv_id", F.lit(-1).alias("part"), none.alias("i"), none.alias("label"), none.alias("other"), none.alias("chars"))
    lent = every.join(heads, "first").select("conv_id", F.explode(F.slice("t", F.lit(1), F.col("h").cast("int"))).alias("x")).select("conv_id", F.lit(0).alias("part"), "x.*")
    kept = own.where(F.col("i") >= h).select("conv_id", F.lit(1).alias("part"), "i", "label", "other", "chars")
    return marks.unionByName(lent).unionByName(kept)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_PREFIX = ["conv_id", "depth", "a", "b", "pa", "pb", "label", "chars", "last"]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows in, _PREFIX out.  A prefix's hash is the sum of hashes of its turns, each made with its depth; between
    batches the open conversation's depth and sums are held, and its last row, of which one does not know if more follow."""
    held: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, part, label, other, chars = (np.asarray(batch.column(c)) for c in ("conv_id", "part", "label", "other", "chars"))
        n = len(conv)
        new = np.ones(n, dtype=bool)
        new[1:] = conv[1:] != conv[:-1]
        goes_on = held is not None and conv[0] == held["conv_id"][0]
        begin = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        depth = np.arange(n) - begin
        open_rows = (begin == 0) & goes_on
        if goes_on:
            depth[open_rows] += held["depth"][0] + 1
        out = {"conv_id": conv, "depth": depth, "label": label, "chars": chars}
        turn = part >= 0
        for lane, values, name, above in ((1, label, "a", "pa"), (2, other, "b", "pb")):
            step = _mix(_mix(values.astype(np.int64).view(np.uint64)) + _mix(depth.astype(np.uint64) * np.uint64(2) + np.uint64(lane)))
            step[~turn] = 0
            sums = np.cumsum(step, dtype=np.uint64)
            sums -= (sums - step)[begin]
            if goes_on:
                sums[open_rows] += held[name].view(np.uint64)[0]
            out[name], out[above] = sums.view(np.int64), (sums - step).view(np.int64)
        if held is not None:
            out = {k: np.concatenate((held[k], v)) for k, v in out.items()}
        last = np.zeros(len(out["conv_id"]), dtype=bool)
        last[:-1] = out["conv_id"][1:] != out["conv_id"][:-1]
        held = {k: v[-1:].copy() for k, v in out.items()}
        yield pa.record_batch([pa.array(out[k][:-1]) for k in _PREFIX[:-1]] + [pa.array(last[:-1])], names=_PREFIX)
    if held is not None:
        yield pa.record_batch([pa.array(held[k]) for k in _PREFIX[:-1]] + [pa.array([True])], names=_PREFIX)


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, (a, b) the prefix, (pa, pb) the one before it, label and chars of its last turn, last (the whole conversation)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "i")
    schema = "conv_id bigint, depth bigint, a bigint, b bigint, pa bigint, pb bigint, label bigint, chars bigint, last boolean"
    return map_arrow(ordered, _prefixes, schema)


class Louds:
    """A trie (or several side by side) in level order.  Node 0 stands above the tops; ``bits`` has a one for each child
    of each node and a zero after them; arrays have an entry a node, from node 1 on."""

    def __init__(self, level: np.ndarray, own: np.ndarray, above: np.ndarray):
        """level: distance from the top; own, above: (n, 2) hashes of nodes and of their parents."""
        n = len(level)
        pair = np.dtype([("a", np.int64), ("b", np.int64)])
        own, above = (np.ascontiguousarray(x).view(pair).reshape(-1) for x in (own, above))
        self.order = np.empty(n, dtype=np.int64)  # input rows in level order
        self.first = np.searchsorted(np.sort(level), np.arange(int(level.max(initial=-1)) + 2))  # where levels begin
        parent = np.zeros(n, dtype=np.int64)
        for d, (x, y) in enumerate(zip(self.first, self.first[1:], strict=False)):
            rows = np.flatnonzero(level == d)
            at = np.zeros(len(rows), dtype=np.int64)
            if d:
                before = self.order[self.first[d - 1] : x]
                by = np.argsort(own[before])
                at = by[np.searchsorted(own[before][by], above[rows])] + self.first[d - 1] + 1
            by = np.lexsort((own[rows]["b"], own[rows]["a"], at))
            self.order[x:y], parent[x:y] = rows[by], at[by]
        children = np.bincount(parent, minlength=n + 1)
        self.bits = np.ones(2 * n + 1, dtype=bool)
        self.bits[np.cumsum(children + 1) - 1] = False

    @staticmethod
    def parents(bits: np.ndarray) -> np.ndarray:
        """Of nodes 1 to n: the zeros before a node's one."""
        return np.cumsum(~bits)[bits]

    @staticmethod
    def children(bits: np.ndarray) -> np.ndarray:
        """Of nodes 0 to n, how many: the ones before a node's zero, since the last one."""
        return np.diff(np.flatnonzero(~bits), prepend=-1) - 1

    def sums(self, values: np.ndarray) -> np.ndarray:
        """values (nodes 1 to n, in level order) summed over subtries, from the deepest level up."""
        out = values.copy()
        parent = self.parents(self.bits)
        for x, y in reversed(list(zip(self.first[1:], self.first[2:], strict=False))):
            np.add.at(out, parent[x:y] - 1, out[x:y])
        return out


_NODE = ["conv_id", "depth", "a", "b", "pa", "pb", "label", "chars", "n_convs"]
_LIGHT = [*_NODE, "level", "shard"]
_SUMS = ["n_children", "n_leaves", "saved_tokens", "parent_conv_id"]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """A shard's rows at a time, from batches that are sorted by shard."""
    held: list[dict[str, np.ndarray]] = []
    for b in batches:
        cols = {c: np.asarray(b.column(c)) for c in b.schema.names}
        ends = [*(np.flatnonzero(np.diff(cols["shard"])) + 1).tolist(), b.num_rows]
        begin = 0
        for end in ends:
            if begin == end:
                continue
            if held and held[0]["shard"][0] != cols["shard"][begin]:
                yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}
                held = []
            held.append({c: v[begin:end] for c, v in cols.items()})
            begin = end
    if held:
        yield {c: np.concatenate([h[c] for h in held]) for c in held[0]}


def _trie(cols: dict[str, np.ndarray]) -> Louds:
    return Louds(cols["level"], np.column_stack((cols["a"], cols["b"])), np.column_stack((cols["pa"], cols["pb"])))


def _rolled_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with sums over their subtries.  Columns more_* (of upper nodes) are what subtries in shards add."""
    for cols in _shards(batches):
        trie = _trie(cols)
        cols = {c: v[trie.order] for c, v in cols.items()}
        more = {c: cols.get(f"more_{c}", np.zeros(len(trie.order), dtype=np.int64)) for c in _SUMS[:3]}
        children = trie.children(trie.bits)[1:] + more["n_children"]
        leaves = trie.sums((children == 0).astype(np.int64) + more["n_leaves"])
        saved = trie.sums((cols["n_convs"] - 1) * cols["chars"] + more["saved_tokens"])
        parent = trie.parents(trie.bits) - 1
        top = parent < 0
        above = pa.array(np.where(top, 0, cols["conv_id"][np.maximum(parent, 0)]), mask=top)
        yield pa.record_batch([pa.array(cols[c]) for c in [*_NODE, "level"]] + [pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(saved), above], names=[*_NODE, "level", *_SUMS])


def _stored_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for cols in _shards(batches):
        trie = _trie(cols)
        row = [[int(cols["shard"][0])], [len(trie.order)], [np.packbits(trie.bits).tobytes()], *([cols[c][trie.order].tolist()] for c in ("label", "a", "b", "n_convs", "conv_id"))]
        yield pa.record_batch([pa.array(row[0], pa.int64()), pa.array(row[1], pa.int64()), pa.array(row[2], pa.binary()), *(pa.array(x, pa.list_(pa.int64())) for x in row[3:])], names=["shard", "n_nodes", "louds", "label", "a", "b", "n_convs", "conv_id"])


def child(bits: np.ndarray, labels: np.ndarray, node: int, label: int) -> int | None:
    """The node below ``node`` whose last turn has this label, in a stored trie."""
    zeros = np.flatnonzero(~bits)
    begin, end = (int(zeros[node - 1]) + 1 if node else 0), int(zeros[node])
    first = begin - node + 1  # ones before, and one more
    hit = np.flatnonzero(labels[first - 1 : first - 1 + end - begin] == label)
    return first + int(hit[0]) if len(hit) else None


class Trie:
    """The tables of a trie: ``members`` (a row for each conversation and turn), ``upper`` nodes, and all others with their shard and level."""

    def __init__(self, rows: DataFrame, heavy: int = 256, shard_nodes: int = 20_000):
        spark = rows.sparkSession
        self.members = written(rows, "prefixes", regroup=False)
        total = self.members.where("depth = 0").count()
        many = max(heavy, total // 100_000)
        node = [F.min(c).alias(c) for c in ("conv_id", "depth", "pa", "pb", "label", "chars")]
        upper = self.members.groupBy("a", "b").agg(F.count("*").alias("n_convs"), *node).where((F.col("n_convs") > many) | (F.col("depth") == 0))
        self.upper = written(upper.select(*_NODE), "upper")
        known = F.broadcast(self.upper.select("a", "b", F.lit(True).alias("is_upper")))
        at = F.when(F.col("is_upper").isNull(), F.struct("depth", "a", "b"))
        path = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        below = self.members.join(known, ["a", "b"], "left").withColumn("top", F.first(at, ignorenulls=True).over(path)).where("is_upper IS NULL")
        light = below.groupBy("a", "b").agg(F.count("*").alias("n_convs"), *node, F.min("top").alias("top"))
        counted = self.members.agg(F.count("*")).first()[0]
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-counted // shard_nodes))
        shard = F.pmod(F.xxhash64("top.a", "top.b"), F.lit(shards))
        self.light = light.select(*_NODE, (F.col("depth") - F.col("top.depth")).alias("level"), shard.alias("shard"))

    def _by_shard(self, run: Callable, schema: str) -> DataFrame:
        parts = int(self.light.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return map_arrow(self.light.repartition(parts, "shard").sortWithinPartitions("shard").select(*_LIGHT), run, schema)

    def tries(self) -> DataFrame:
        """shard, n_nodes, louds (bits, most significant first), and by node in level order label, a, b, n_convs, conv_id."""
        return self._by_shard(_stored_tries, "shard bigint, n_nodes bigint, louds binary, " + ", ".join(f"{c} array<bigint>" for c in ("label", "a", "b", "n_convs", "conv_id")))

    def nodes(self) -> DataFrame:
        """A row a node: _NODE, its level in its trie and _SUMS."""
        schema = ", ".join(f"{c} bigint" for c in [*_NODE, "level", *_SUMS])
        below = written(self._by_shard(_rolled_up, schema), "subtries", regroup=False)
        tops = below.where("level = 0").groupBy("pa", "pb").agg(F.count("*").alias("more_n_children"), F.sum("n_leaves").alias("more_n_leaves"), F.sum("saved_tokens").alias("more_saved_tokens"))
        more = [F.coalesce(c, F.lit(0)).alias(c) for c in tops.columns[2:]]
        u = self.upper.join(tops.withColumnsRenamed({"pa": "a", "pb": "b"}), ["a", "b"], "left").select(*_NODE, F.col("depth").alias("level"), F.lit(0).cast("long").alias("shard"), *more)
        above = map_arrow(u.coalesce(1), _rolled_up, schema)
        parents = F.broadcast(self.upper.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("__above")))
        # only a subtrie's top has its parent among the upper nodes
        linked = below.join(parents, ["pa", "pb"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "__above"))
        return linked.select(*below.columns).unionByName(above)

    def ends(self) -> DataFrame:
        """a, b, ends_sha256: the conversations that end in a node, as numbers in order with commas between."""
        parts = int(self.members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        last = self.members.where("last").select("a", "b", "conv_id")
        ordered = last.repartitionByRange(parts, "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
        pieces = map_arrow(ordered, _id_pieces, "a bigint, b bigint, first bigint, ids string")
        met = pieces.repartition(parts, "a", "b").sortWithinPartitions("a", "b", "first")
        return map_arrow(met, _hash_pieces, "a bigint, b bigint, ends_sha256 string")


def _id_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node's numbers as text, no longer than PIECE (but for a number more), in order."""
    out: list[tuple] = []
    node: tuple | None = None
    ids: list[str] = []
    size = 0
    for batch in batches:
        for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if node is None or node[:2] != (a, b) or size > PIECE:
                if node is not None:
                    out.append((*node, ",".join(ids)))
                node, ids, size = (a, b, c), [], 0
            ids.append(str(c))
            size += len(ids[-1]) + 1
        if len(out) > 1000:
            yield _rows(out, "first", "ids")
            out = []
    if node is not None:
        out.append((*node, ",".join(ids)))
    yield _rows(out, "first", "ids")


def _hash_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, h, out = None, hashlib.sha256(), []
    for batch in batches:
        for a, b, _, ids in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            if node == (a, b):
                h.update(b",")
            else:
                if node is not None:
                    out.append((*node, h.hexdigest()))
                node, h = (a, b), hashlib.sha256()
            h.update(ids.encode())
        if len(out) > 1000:
            yield _rows(out, "ends_sha256")
            out = []
    if node is not None:
        out.append((*node, h.hexdigest()))
    yield _rows(out, "ends_sha256")


def _rows(rows: list[tuple], *names: str) -> pa.RecordBatch:
    own = ["a", "b", *names]
    cols = list(zip(*rows, strict=True)) or [()] * len(own)
    return pa.record_batch([pa.array(c, pa.string() if n in ("ids", "ends_sha256") else pa.int64()) for n, c in zip(own, cols, strict=True)], names=own)


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = written(turns(table(spark, sf_dir, "conversations")), "turns", regroup=False)
    trie = Trie(prefixes(rebuilt(own)))
    nodes = trie.nodes().join(trie.ends(), ["a", "b"], "left")
    none = hashlib.sha256().hexdigest()
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


_CRC_DIGITS = """xor(4294967295, list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(conv_id::VARCHAR, '')],
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""

OP13_SQL = f"""
WITH t AS MATERIALIZED (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS first, {_CRC_DIGITS} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, t.i, role, text FROM c JOIN t ON t.conv_id = c.first AND t.i < c.h
      UNION ALL SELECT c.conv_id, 1, t.i, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i >= c.h),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS depth FROM r),
p AS (SELECT x.conv_id, x.depth, any_value(x.text) AS text, sha256(string_agg(length(y.role) || ':' || y.role || length(y.text) || ':' || y.text, '' ORDER BY y.depth)) AS prefix
      FROM s x JOIN s y ON y.conv_id = x.conv_id AND y.depth <= x.depth GROUP BY 1, 2 UNION ALL SELECT conv_id, 0, '', '' FROM c),
l AS (SELECT c.conv_id, coalesce(max(depth), 0) AS len FROM c LEFT JOIN s USING (conv_id) GROUP BY 1),
m AS MATERIALIZED (SELECT conv_id AS member, depth, min(conv_id) OVER (PARTITION BY depth, prefix) AS conv_id, text FROM p),
n AS MATERIALIZED (SELECT m.conv_id, m.depth, count(*) AS n_convs, any_value(length(text)) AS chars, string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (l.len = m.depth) AS ends FROM m JOIN l ON l.conv_id = m.member GROUP BY m.conv_id, m.depth),
u AS MATERIALIZED (SELECT n.*, m.conv_id AS parent FROM n LEFT JOIN m ON m.member = n.conv_id AND m.depth = n.depth - 1),
k AS MATERIALIZED (SELECT u.conv_id, u.depth, count(v.conv_id) AS n_children FROM u LEFT JOIN u v ON v.parent = u.conv_id AND v.depth = u.depth + 1 GROUP BY 1, 2),
z AS (SELECT m.conv_id, m.depth, count(*) FILTER (k.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.chars)::BIGINT AS saved_tokens
      FROM u JOIN k ON k.conv_id = u.conv_id AND k.depth = u.depth JOIN m ON m.member = u.conv_id AND m.depth <= u.depth GROUP BY 1, 2)
SELECT u.conv_id, u.depth, u.parent AS parent_conv_id, u.n_convs, k.n_children, z.n_leaves, z.saved_tokens, sha256(coalesce(u.ends, '')) AS ends_sha256
FROM u JOIN k ON k.conv_id = u.conv_id AND k.depth = u.depth JOIN z ON z.conv_id = u.conv_id AND z.depth = u.depth
"""
