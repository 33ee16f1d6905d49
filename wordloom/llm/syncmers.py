"""Document fingerprints from closed syncmers, by built-in functions alone.

A text is cut at white space into pieces of up to eight characters; in a long stretch without white space (a text in Chinese,
say) every character is a piece, so that pieces do not hang on where the stretch begins.  A k-mer is ``K`` consecutive pieces, an
inner substring ``S`` of them.  A k-mer is an *anchor* (a closed syncmer) if the smallest hash among its inner
substrings is its first or last one.  That depends on the k-mer alone, so a passage has the same anchors
wherever it stands: between two texts, equal anchors at one displacement are a positional match
(``positional_matches``).  A document's fingerprint is all its anchors with their positions.  The likeness of two
fingerprints is the share of their anchors that match in position: that stand at a displacement which several share (Dice),
where an anchor that occurs several times counts no more often than the text that has it less often.
A passage that moved as a whole still matches, and anchors that are equal by chance do not.

Defined results: null and empty texts have the fingerprint "" (likeness 1 to each other, 0 to all else); a
text without an anchor has its first k-mer (or what there is of it) for one; an empty table gives no rows; repeated rows stay;
other columns are ignored; for ``next_text``: null ids come last, rows that share an id are ordered by their
text's hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import few_files, let, table

#: The window arithmetic of ``kmers`` is written for these two: every other k-mer is an anchor.
K, S = 5, 2
#: Characters with so many more before or behind them without a blank are pieces of their own.
STRETCH = 32
PIECE = rf"\S(?=\S{{{STRETCH}}})|(?<=\S{{{STRETCH}}})\S|\S{{1,8}}"
#: Anchors at one displacement that make a positional match.
TOGETHER = 3
#: Buckets of the order by id: about BUCKET_ROWS rows each.  Bounds are a literal of the plan, looked up in two steps of STEP,
#: so beyond STEP * STEP * BUCKET_ROWS rows (half a thousand million) buckets grow.
STEP, BUCKET_ROWS = 512, 2000


def _tail(a: Column, start: int) -> Column:
    return F.slice(a, F.lit(start), F.size(a))


def _with_next(a: Column, use: Callable[[Column, Column], Column]) -> Column:
    return F.zip_with(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))), _tail(a, 2), use)


def inner_substrings(text: Column) -> Column:
    """array<long>: hashes of all stretches of S pieces (of the only piece, if there is one), in order of position."""
    pieces = F.transform(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p))
    return let(pieces, lambda h: F.when(F.size(h) >= S, _with_next(h, lambda a, b: F.xxhash64(a, b))).otherwise(h))


def kmers(inner: Column) -> Column:
    """array<struct<a, b, c, m>>: of each k-mer its first inner substring, the middle and the last one (which make it up),
    and the smallest of those between first and last."""
    smaller = lambda a: _with_next(a, lambda x, y: F.least(x, y))
    n = F.greatest(F.size(inner) - (K - S), F.lit(0))
    part = lambda a, start, name: F.slice(a, F.lit(start), n).alias(name)
    return let(smaller(inner), lambda m: F.arrays_zip(part(inner, 1, "a"), part(inner, 3, "b"), part(inner, 4, "c"), part(m, 2, "m")))


def _closed(x: Column) -> Column:
    return F.least(x["a"], x["c"]) <= x["m"]


def _anchor(x: Column) -> Column:
    return F.hash(x["a"], x["b"], x["c"])


def positioned(text: Column) -> Column:
    """array<long>: all anchors in order of position; the position is in the high 32 bits, the anchor in the low ones."""

    def packed(anchor: Column, pos: Column) -> Column:
        return F.shiftleft(pos.cast("long"), 32).bitwiseOR(anchor.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))

    def own(inner: Column) -> Column:
        # too short a text, or one whose every k-mer is smallest in its middle: the first k-mer stands for it
        found = F.array_compact(F.transform(kmers(inner), lambda x, i: F.when(_closed(x), packed(_anchor(x), i))))
        first = F.when(F.size(inner) > 0, F.array(packed(F.hash(F.slice(inner, 1, K - S + 1)), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
        return let(found, lambda f: F.when(F.size(f) > 0, f).otherwise(first))

    return let(inner_substrings(F.coalesce(text, F.lit(""))), own)


def as_text(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda v: F.hex(v)), " ")


def _by_anchor(found: Column, side: int) -> Column:
    """The anchor in the high 32 bits, then its position and a side."""
    return F.transform(found, lambda v: F.shiftleft(v, 32).bitwiseOR(F.shiftleft(F.shiftrightunsigned(v, 32), 1)).bitwiseOR(F.lit(side).cast("long")))


def _in_both(s: Column, size: Column) -> Column:
    """Of the sorted anchors of two sides, those that have a partner: the sum of each anchor's smaller number of occurrences."""
    one = F.lit(1).cast("long")
    begin = F.struct(F.lit(1 << 40).alias("k"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("alone"))

    def step(x: Column, v: Column) -> Column:
        key, side = F.shiftright(v, 32), 1 - 2 * v.bitwiseAND(one)
        same = x["k"] == key
        return F.struct(key.alias("k"), F.when(same, x["d"] + side).otherwise(side).alias("d"), F.when(same, x["alone"]).otherwise(x["alone"] + F.abs(x["d"])).alias("alone"))

    return F.aggregate(s, begin, step, lambda x: F.shiftright(size - x["alone"] - F.abs(x["d"]), 1))


def matched(a: Column, b: Column) -> Column:
    """How many anchors of two fingerprints stand at a displacement that at least ``TOGETHER`` of them share (or all, where
    there are fewer): of an anchor that occurs several times, neighbours in position meet.  A place can have two neighbours, so
    no more count than have partners of their own.

    Both sides are sorted by anchor and position at once, and displacements of neighbours once more: n log n."""
    one, low = F.lit(1).cast("long"), F.lit(0xFFFFFFFF).cast("long")

    def met(x: Column, y: Column) -> Column:
        # one anchor, two sides: the difference is odd, and with its sign twice the displacement and one
        apart = y.bitwiseAND(low) - x.bitwiseAND(low)
        return F.when((apart.bitwiseAND(one) == 1) & (F.shiftright(x, 32) == F.shiftright(y, 32)), F.when(x.bitwiseAND(one) == 0, apart).otherwise(-apart))

    least = F.least(F.lit(TOGETHER), F.size(a), F.size(b))

    def runs(d: Column) -> Column:
        placed = F.transform(d, lambda v, i: F.shiftleft(v, 28) + i)
        ends = let(placed, lambda p: F.array_compact(_with_next(p, lambda x, y: F.when(F.shiftright(x, 28) != F.shiftright(y, 28), y.bitwiseAND(F.lit((1 << 28) - 1).cast("long"))))))
        edges = F.concat(F.array(F.lit(0).cast("long")), ends, F.array(F.size(d).cast("long")))
        return let(edges, lambda e: F.aggregate(_with_next(e, lambda x, y: y - x), F.lit(0).cast("long"), lambda n, r: n + F.when(r >= least, r).otherwise(0)))

    sides = F.sort_array(F.concat(_by_anchor(a, 0), _by_anchor(b, 1)))
    return let(sides, lambda s: F.least(let(F.sort_array(F.array_compact(_with_next(s, met))), runs), _in_both(s, (F.size(a) + F.size(b)).cast("long"))))


def likeness(a: Column, b: Column) -> Column:
    """Dice of the anchors of two fingerprints that match in position."""
    sizes = F.size(a) + F.size(b)
    return F.when(sizes == 0, F.lit(1.0)).otherwise(2 * matched(a, b).cast("double") / sizes)


def anchors(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, pos (of the k-mer's first piece), anchor: all closed syncmers."""
    k = docs.select(F.col(key).alias("key"), F.posexplode(let(inner_substrings(F.coalesce(F.col(text), F.lit(""))), kmers)).alias("pos", "k"))
    return k.where(_closed(F.col("k"))).select(F.col("key").alias(key), "pos", _anchor(F.col("k")).alias("anchor"))


def positional_matches(a: DataFrame, b: DataFrame, key: str = "doc_id", at_least: int = 2) -> DataFrame:
    """Pairs of a's and b's documents with the number of anchors they share at one displacement."""
    pairs = a.select(F.col(key).alias("a"), F.col("pos").alias("pa"), "anchor").join(b.select(F.col(key).alias("b"), F.col("pos").alias("pb"), "anchor"), "anchor")
    return pairs.groupBy("a", "b", (F.col("pb") - F.col("pa")).alias("displacement")).agg(F.count("*").alias("n")).where(F.col("n") >= at_least)


def _bucket(order: Column, bounds: list[int]) -> Column:
    """How many bounds lie below, in two steps."""
    if not bounds:
        return F.lit(0)

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda b: b < order))

    coarse = below(_longs(bounds[STEP - 1 :: STEP]))
    return coarse * STEP + below(F.slice(_longs(bounds), coarse * STEP + 1, F.lit(STEP)))


def _longs(values: list[int]) -> Column:
    """A literal array: one constant, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def next_text(docs: DataFrame, cols: list[str], key: str = "doc_id", text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """docs with next_<c> for each of cols, from the row that follows in descending order of key; after the
    last row comes the first.

    The order is never put into one task: ids fall into buckets at percentiles of their own; a bucket's first
    row is also sent to the bucket before it in the order, as a guard behind its last row.  Text is shuffled once."""
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ids = docs.select(order.alias("o"))
    n = ids.count()
    buckets = max(1, min(STEP * STEP, -(-n // bucket_rows)))
    bounds: list[int] = []
    if buckets > 1:
        bounds = sorted(set(ids.agg(F.percentile_approx("o", [i / buckets for i in range(1, buckets)], max(100_000, 10 * buckets))).first()[0]))
    # the largest id of each bucket: STEP * STEP rows at most
    top = dict(ids.groupBy(_bucket(F.col("o"), bounds).alias("b")).agg(F.max("o").alias("m")).collect())
    if not top:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in cols))
    filled = sorted(top)
    above = dict(zip(filled, filled[1:], strict=False))
    # of every bucket up to the last filled one: its largest id (an empty one has no rows to ask) and the next that is filled
    most, up = (_longs([values.get(b, -1) for b in range(filled[-1] + 1)]) for values in (top, above))
    rows = docs.withColumn("__o", order).withColumn("__b", _bucket(F.col("__o"), bounds))
    rows = rows.withColumn("__up", F.struct(F.get(most, F.col("__b")).alias("m"), F.get(up, F.col("__b")).cast("int").alias("a")))
    places = F.concat(
        F.array(F.struct(F.col("__b").alias("b"), F.lit(0).alias("guard"))),
        F.when((F.col("__o") == F.col("__up.m")) & (F.col("__up.a") >= 0), F.array(F.struct(F.col("__up.a").alias("b"), F.lit(1).alias("guard")))).otherwise(F.array().cast("array<struct<b:int,guard:int>>")),
        F.when(F.col("__o") == top[filled[-1]], F.array(F.struct(F.lit(filled[0]).alias("b"), F.lit(2).alias("guard")))).otherwise(F.array().cast("array<struct<b:int,guard:int>>")),
    )
    rows = rows.withColumn("__at", F.explode(places)).drop("__up", "__b")
    w = Window.partitionBy("__at.b").orderBy("__at.guard", F.desc("__o"), F.xxhash64(text))
    led = rows.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in cols))
    return few_files(led.where("__at.guard = 0").drop("__at", "__o"), n)


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    led = next_text(docs.withColumn("n_chars", F.length("text").cast("long")), ["text"])
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - cut).cast("int")), F.substr("next_text", F.lit(1), cut))
    texts = led.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    found = texts.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), *(positioned(F.col(c)).alias(c) for c in ("text", "edited", "next_text")))
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("text")).alias("fingerprint"),
        as_text(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"),
        likeness(F.col("text"), F.col("next_text")).alias("near_next"),
    )
