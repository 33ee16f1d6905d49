"""Spelling variants: words that differ by one inserted, deleted or replaced character, and the form each goes back to.

One edit leaves one half of a word as it was.  So a sorted dictionary holds two words of one edit side by side in
a block that shares a beginning, or the dictionary of reversed words in a block that shares an end.

A block is (m, lo, hi): words of m and of m + 1 characters that are the same before place lo and, in the shorter,
from place hi on; it answers for edits at the places lo to hi - 1.  Its halves [lo, mid) and [mid, hi) are blocks of
longer shared ends and beginnings.  A word begins in four blocks: as the shorter and as the longer, in each half.

1. Blocks of more than ``block`` words are subdivided, on the executors, until none is left or only one place is
   open (where a block is as long as the alphabet allows).
2. The dictionaries are range-partitioned and sorted, so a block's words come one after the other.
3. A scan goes on subdividing a block in memory, down to one place, and verifies what is left there.  An insertion
   in a run of equal characters counts at the run's last place, so each pair is found once.  No pairs leave
   the scan: a word's near words are counted, and the best of them kept.

Every word of a pair is in the pair's block, so nothing is missed; ``block`` bounds a task's memory, not the result.

Defined results: null texts and words have no part; equal words are one; words of any length are taken whole (work is a
length times its logarithm); of equally frequent near words the first in code-point order counts; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, discard, if_small, map_arrow, table, written

RUN = "[A-Za-zÀ-ÿ]+"
_PLACE = ["m", "lo", "hi"]


def runs(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = 1) -> DataFrame:
    """doc_id, run: every maximal run of letters, A-Z lower-cased, of so many characters."""
    found = docs.select(F.col(key).alias("doc_id"), F.explode(F.regexp_extract_all(F.col(text), F.lit(RUN), F.lit(0))).alias("run"))
    return found.where(F.length("run") >= min_chars).select("doc_id", ascii_lower(F.col("run")).alias("run"))


def word_counts(words: DataFrame, min_chars: int = 7, min_count: int = 2) -> DataFrame:
    """word, n."""
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def _halves(rows: DataFrame) -> DataFrame:
    """Each row in the two halves of its block."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct("lo", mid.alias("hi")), F.struct(mid.alias("lo"), "hi"))).alias("h")
    return rows.select("word", "n", "m", half).select("word", "n", "m", F.col("h.lo").alias("lo"), F.col("h.hi").alias("hi"))


def _shared() -> list:
    """What a block's words share: its places, beginning and reversed end."""
    tail = F.greatest(F.col("m") - F.col("hi"), F.lit(0))
    return [*map(F.col, _PLACE), F.expr("substr(word, 1, lo)").alias("head"), F.reverse(F.when(tail > 0, F.expr("right(word, greatest(m - hi, 0))")).otherwise("")).alias("back")]


def blocks(words: DataFrame, block: int = 10_000, least: int = 1) -> list[DataFrame]:
    """Tables (word, n, m, lo, hi) whose blocks have at most ``block`` words or one open place.  least: characters of
    the shortest word."""
    size = F.length("word")
    first = words.select("word", "n", F.explode(F.array(size, size - 1)).alias("m")).where(F.col("m") >= least)
    todo = _halves(first.select("word", "n", "m", F.lit(0).alias("lo"), (F.col("m") + 1).alias("hi")))
    done: list[DataFrame] = []
    while True:
        # how many words share what; wide blocks of few words need no more than their count
        keyed = todo.where("hi - lo > 1").select(*_shared())
        large = written(keyed.groupBy(*_PLACE, "head", "back").agg(F.count("*").alias("size")).where(F.col("size") > block), "large")
        rows = large.agg(F.sum("size")).first()[0]
        if not rows:
            discard(large)
            return [*done, todo]
        # A block with over a thousandth of the rows is one of at most a thousand.
        hot = F.col("size") * 1000 > rows
        heavy, light = F.broadcast(large.where(hot).drop("size")), if_small(large.where(~hot).drop("size"))
        on, cols = [*_PLACE, "head", "back"], ["word", "n", *_PLACE]
        with_keys = todo.select("word", "n", *_shared())
        rest = with_keys.join(heavy, on, "left_anti")
        done.append(rest.join(light, on, "left_anti").select(*cols))
        split = with_keys.join(heavy, on, "left_semi").unionByName(rest.join(light, on, "left_semi"))
        todo = written(_halves(split.select(*cols)), "halves", regroup=False)


class _Near:
    """How many near words each word of a block has, and the best of them: most frequent, then first in order."""

    def __init__(self) -> None:
        self.count: dict[str, int] = defaultdict(int)
        self.best: dict[str, tuple[int, str]] = {}

    def add(self, word: str, n: int, near: tuple[int, str]) -> None:
        self.count[word] += n
        if word not in self.best or near < self.best[word]:
            self.best[word] = near

    def scan(self, words: list[tuple[str, int]], m: int, lo: int, hi: int) -> None:
        if len(words) < 2 or all(len(w) > m for w, _ in words):
            return
        if hi - lo == 1:
            self.verify(words, m, lo)
            return
        mid, end = (lo + hi) // 2, max(0, m - hi)
        before: dict[str, list] = defaultdict(list)
        behind: dict[str, list] = defaultdict(list)
        for x in words:
            w = x[0]
            before[w[lo:mid]].append(x)
            behind[w[len(w) - (m - mid) : len(w) - end]].append(x)
        for group in before.values():
            self.scan(group, m, mid, hi)
        for group in behind.values():
            self.scan(group, m, lo, mid)

    def verify(self, words: list[tuple[str, int]], m: int, at: int) -> None:
        """All but place ``at`` is shared: words of m characters are near each other, and near a longer one that
        has their character behind its own at that place."""
        short = [(-n, w) for w, n in words if len(w) == m]
        if at < m and len(short) > 1:
            first, second = sorted(short)[:2]
            for x in short:
                self.add(x[1], len(short) - 1, second if x == first else first)
        by = {w[at] if at < m else "": (n, w) for n, w in short}
        for w, n in words:
            if len(w) > m and (at == m or w[at] != w[at + 1]) and (s := by.get(w[at + 1] if at < m else "")):
                self.add(w, 1, s)
                self.add(s[1], 1, (-n, w))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def shared(r: tuple) -> tuple:
        w, _, m, lo, hi = r
        return m, lo, hi, w[:lo], w[len(w) - (m - hi) :] if hi < m else ""

    out: list[tuple] = []
    for (m, lo, hi, _, _), block in groupby(rows(), shared):
        near = _Near()
        near.scan([(r[0], r[1]) for r in block], m, lo, hi)
        out += [(w, k, -near.best[w][0], near.best[w][1]) for w, k in near.count.items()]
        if len(out) > 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    w, k, n, best = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(w, pa.string()), pa.array(k, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string())], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, block: int = 10_000, least: int = 1) -> DataFrame:
    """word, n_near, best_n, best, for the words (word, n) that have near words."""
    found: DataFrame | None = None
    for rows in blocks(words, block, least):
        found = rows if found is None else found.unionByName(rows)
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = found.repartitionByRange(parts, *_shared()).sortWithinPartitions(*_shared())
    partial = map_arrow(ordered, _scan, "word string, n_near bigint, best_n bigint, best string")
    sums = partial.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), "best")).alias("b"))
    return sums.select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root for a table (word, form) without cycles: forms are followed to the last, in steps that double."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("__next"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("__next", "root").alias("root"), F.col("__next").isNotNull().alias("moved")), "roots")
        moved = step.where("moved").limit(1).count()
        discard(now)
        now = step.drop("moved")
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = 10, block: int = 10_000, least: int = 1) -> DataFrame:
    """word, form, root, n, n_near, form_n for words (word, n), each once.  A word's form is its best near word, if
    that is at least ``ratio`` times as frequent; its root is the last of the forms that follow."""
    words = written(words.select("word", "n"), "words")
    near = written(near_words(words, block, least), "near")
    own = words.join(near, "word", "left").withColumn("has", F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False)))
    own = own.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("has"), F.col("best")).alias("form"), F.when(F.col("has"), F.col("best_n")).alias("form_n"))
    last = roots(own.where("form IS NOT NULL").select("word", "form"))
    return own.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def with_slips(found: DataFrame, every: int = 31) -> DataFrame:
    """word: runs (doc_id, run), one character deleted from each whose crc32 with its document's id is divisible by ``every``
    (a null id is empty there)."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = found.withColumn("h", h).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    cut = F.concat(F.expr("substr(run, 1, at)"), F.expr("substr(run, at + 2)"))
    return at.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents"), min_chars=7)
    return variants(word_counts(with_slips(found), min_chars=7, min_count=2), least=7)


#: CRC-32, octet by octet and bit by bit, of text of at most two octets a character.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten([CASE WHEN ascii(x) < 128 THEN [ascii(x)::BIGINT] ELSE [192 + (ascii(x) >> 6), 128 + (ascii(x) & 63)] END FOR x IN string_split({0}, '')]),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384))))"""

OP12_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
k AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') || ':' || run AS s FROM r WHERE length(run) >= 7),
c AS MATERIALIZED (SELECT s, {_CRC.format("s")} AS h FROM k),
o AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word
      FROM r JOIN c ON c.s = coalesce(doc_id::VARCHAR, '') || ':' || run),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM o WHERE length(word) >= 7 GROUP BY 1 HAVING count(*) >= 2),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT x.word AS a, x.n AS na, y.word AS b, y.n AS nb FROM d x JOIN d y ON x.s = y.s AND x.i = y.i AND x.word <> y.word
      UNION SELECT d.word, d.n, w.word, w.n FROM d JOIN w ON w.word = d.s
      UNION SELECT w.word, w.n, d.word, d.n FROM d JOIN w ON w.word = d.s),
g AS (SELECT a AS word, count(*) AS n_near, max(nb) AS top FROM p GROUP BY 1),
f AS (SELECT g.word, any_value(n_near) AS n_near, any_value(top) AS top, min(b) AS best FROM g JOIN p ON p.a = g.word AND p.nb = g.top GROUP BY 1),
v AS MATERIALIZED (SELECT w.word, CASE WHEN top >= 10 * n THEN best END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * n THEN top END AS form_n FROM w LEFT JOIN f USING (word)),
t(word, root) AS (SELECT word, word FROM v UNION ALL SELECT t.word, v.form FROM t JOIN v ON v.word = t.root AND v.form IS NOT NULL)
SELECT v.word, v.form, t.root, v.n, v.n_near, v.form_n FROM v JOIN t USING (word) JOIN v z ON z.word = t.root AND z.form IS NULL
"""
