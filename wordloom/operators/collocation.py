"""Collocations in fixed, sentence and dependency spans.

f(n), f(c) and N count all tokens; W is the mean number of places around a hit (2n for fixed spans, also at document
edges).  A word is never its own collocate.  All counts are aggregates joined in, none a separate action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import measures
from wordloom.storage import stored

from . import kwic
from .frequency import vocabulary

#: fixed values: word order is free in some languages, so the sentence is their span
DEFAULT_METHOD = {"ja": "sentence", "de": "sentence", "en": "fixed"}
METHODS = ("sentence", "fixed", "dependency")


def occurrences(tokens: DataFrame, query: str, unit: str, method: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(word, relation) of every collocate occurrence, and one row: w (for dependencies o, the occurrences, which are to be divided by the hits)."""
    if method == "fixed" and "t" in tokens.columns:
        beside = F.flatten(F.array_compact(F.transform("t", lambda x, i: F.when(kwic.matches(x[unit], query), F.transform(kwic.around(F.col("t"), i, window), lambda y: y[unit])))))
        occ = tokens.select(F.explode(beside).alias("word"))
        return occ.select("word", F.lit("").alias("relation")), tokens.sparkSession.range(1).select(F.lit(2.0 * window).alias("w"))
    if method == "fixed":
        rows = kwic.near_hits(tokens, query, unit)
        hits = kwic.find_hits(rows, query, unit)
        asked = hits.select("doc_id", "rn", kwic._offsets(window).alias("k")).select("doc_id", (F.col("rn") + F.col("k")).alias("rn"))
        occ = asked.join(rows.select("doc_id", "rn", F.col(unit).alias("word")), ["doc_id", "rn"])
        return occ.select("word", F.lit("").alias("relation")), tokens.sparkSession.range(1).select(F.lit(2.0 * window).alias("w"))
    if method == "sentence" and "t" in tokens.columns:
        # A sentence's hits are counted, and each of its tokens counts so many times; one further row has the hits.
        def counted(x: Column) -> Column:
            hits = F.size(F.filter(x, lambda y: kwic.matches(y[unit], query)))
            own = lambda h: F.concat(F.transform(x, lambda y: F.struct(y[unit].alias("word"), h.alias("times"), F.lit(0).alias("h"))), F.array(F.struct(F.lit(None).cast("string").alias("word"), F.lit(0).alias("times"), h.alias("h"))))
            return kwic.let(hits, lambda h: F.when(h > 0, own(h)))

        asked = tokens.where(F.exists("t", lambda x: kwic.matches(x[unit], query)))
        rows = asked.select(F.explode(F.flatten(F.array_compact(F.transform(kwic.sentences(F.col("t")), lambda s: counted(s["x"]))))).alias("x"))
        occ = stored(rows.groupBy("x.word").agg(F.sum("x.times").alias("times"), F.sum("x.h").alias("h")), "sentences")
        return occ.where("word IS NOT NULL").select("word", F.lit("").alias("relation"), "times"), occ.agg(F.try_divide((F.sum("times") - F.sum("h")).cast("double"), F.sum("h").cast("double")).alias("w"))
    hit = kwic.is_hit(tokens, query, unit)
    if method == "sentence":
        # How many hits each sentence has multiplies its other tokens: no pairs are made.
        sentence = tokens.groupBy("doc_id", "sentence_id").agg(F.count("*").alias("size"), F.count_if(hit).alias("hits")).where("hits > 0")
        words = tokens.join(sentence.select("doc_id", "sentence_id", "hits"), ["doc_id", "sentence_id"])
        occ = words.groupBy(F.col(unit).alias("word")).agg(F.sum("hits").alias("times")).select("word", F.lit("").alias("relation"), "times")
        return occ, sentence.agg((F.sum(F.col("hits") * (F.col("size") - 1)) / F.sum("hits")).alias("w"))
    if method == "dependency":
        hits = tokens.where(hit).select("doc_id", "position", "head", "dep")
        child = tokens.where("head >= 0").select("doc_id", F.col("head").alias("position"), F.col(unit).alias("word"), F.col("dep").alias("relation"))
        down = hits.select("doc_id", "position").join(child, ["doc_id", "position"]).select("word", "relation")
        parent = tokens.select("doc_id", F.col("position").alias("head"), F.col(unit).alias("word"))
        up = hits.where("head >= 0").select("doc_id", "head", F.concat(F.lit("→"), "dep").alias("relation")).join(parent, ["doc_id", "head"]).select("word", "relation")
        occ = stored(down.unionByName(up), "dependencies")
        return occ, occ.agg(F.count("*").alias("o"))
    raise ValueError(f"unknown method {method}")


def counted_words(tokens: DataFrame, node: str, unit: str = "lemma") -> DataFrame:
    """tokens: a table, or tokens counted by type.  A row for each word: freq, pos, label, fn (a function word), n_hit (occurrences that are hits of node)."""
    return vocabulary(tokens, unit, [F.max(F.col("is_function").cast("int")).alias("fn"), F.coalesce(F.sum(F.when(kwic.is_hit(tokens, node, unit), F.col("n") if "n" in tokens.columns else 1)), F.lit(0)).alias("n_hit")])


def collocation_table(tokens: DataFrame, node: str, unit: str = "lemma", method: str = "sentence", window: int = 5, min_cooccur: int = 1, with_p: bool = False, rows: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """rows: the same tokens from ``annotate.in_rows``, where there are; spans are then cut out of them without a shuffle, and documents without
    hits can be left out of them and tokens be counted by type (``annotate.types``).  For dependencies: the tokens that one joins (``passes.separated``).
    words: their counts from ``counted_words``, where they are at hand.

    collocate, label, pos, is_function, relation, cooccur, freq_node, freq_collocate, expected, mi, t, log_dice, g2
    (and p).  Function words are in it; hiding them is a view's business."""
    occ, w = occurrences(rows if rows is not None else tokens, node, unit, method, window)
    times = F.sum("times") if "times" in occ.columns else F.count("*")
    counts = occ.groupBy("word", "relation").agg(times.alias("cooccur")).where(F.col("cooccur") >= min_cooccur)
    vocab = words if words is not None else stored(counted_words(tokens, node, unit), "words")
    totals = vocab.agg(F.sum("freq").alias("n"), F.sum("n_hit").alias("freq_node"))  # no further pass over tokens
    scalars = totals.crossJoin(F.broadcast(w))
    if "o" in w.columns:
        scalars = scalars.select("n", "freq_node", F.try_divide(F.col("o").cast("double"), F.col("freq_node").cast("double")).alias("w"))
    known = vocab.where("n_hit = 0").select("word", "label", "pos", (F.col("fn") > 0).alias("is_function"), F.col("freq").alias("freq_collocate"))
    joined = counts.join(known, "word").crossJoin(F.broadcast(scalars))
    m = measures.association(F.col("cooccur"), F.col("freq_node"), F.col("freq_collocate"), F.col("n"), F.col("w"))
    out = joined.select(F.col("word").alias("collocate"), F.coalesce("label", "word").alias("label"), "pos", "is_function", "relation", "cooccur", "freq_node", "freq_collocate", *(c.alias(k) for k, c in m.items()))
    if with_p:
        out = out.withColumn("p", measures.p_value("g2"))
    return out.orderBy(F.desc("log_dice"), F.desc("cooccur"), "collocate", "relation")


def view(table: DataFrame, include_function_words: bool = False, max_rows: int = 300) -> DataFrame:
    shown = table if include_function_words else table.where(~F.col("is_function"))
    return shown.orderBy(F.desc("log_dice"), F.desc("cooccur"), "collocate", "relation").limit(max_rows)
