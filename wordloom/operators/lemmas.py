"""A second lemmatiser, learned from word types: a word's ending is exchanged as most known words with that ending have it.

Pairs (surface, lemma) come from a lexicon or an annotated corpus, or are found in the corpus's own vocabulary
(``paradigms``).  Each pair is an edit: so many characters cut off, others put on.  The edits are counted under every
ending of the surface up to ``longest`` characters, and the most frequent one of an ending is its rule.  An ending
whose rule is that of the ending one shorter says nothing new: what is left is a trie of endings, read from a
word's last character inwards, and the deepest node on a word's path decides.  All of it is joins on word types.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: fixed values: inflections of German nouns, adjectives and weak verbs, and what a base form can end in
ENDINGS = ("e", "em", "en", "er", "es", "n", "s", "st", "t", "te", "ten")
BASES = ("", "e", "en")
LONGEST = 5


def paradigms(words: DataFrame, endings: tuple[str, ...] = ENDINGS, bases: tuple[str, ...] = BASES, min_stem: int = 3) -> DataFrame:
    """surface, lemma for words (word, n): the most frequent of the more frequent words that differ by an inflection
    only (ties: the first by name), or the word itself."""
    stems = words.select("word", "n", F.explode(F.array(*map(F.lit, endings))).alias("e")).where(F.endswith("word", F.col("e")) & (F.length("word") - F.length("e") >= min_stem))
    asked = stems.select("word", "n", F.explode(F.array(*(F.concat(F.expr("substr(word, 1, length(word) - length(e))"), F.lit(b)) for b in bases))).alias("base")).where("base <> word")
    found = asked.join(words.select(F.col("word").alias("base"), F.col("n").alias("nb")), "base").where("nb > n")
    best = found.groupBy("word").agg(F.min(F.struct((-F.col("nb")).alias("k"), "base"))["base"].alias("base"))
    return words.join(best, "word", "left").select(F.col("word").alias("surface"), F.coalesce("base", "word").alias("lemma"))


def edits(pairs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """surface, cut, put: pairs that are alike up to the last ``longest`` characters; others follow no ending."""
    size = F.length("surface")
    cut = F.coalesce(*(F.when((size >= k) & F.startswith("lemma", F.expr(f"substr(surface, 1, length(surface) - {k})")), k) for k in range(longest + 1)))
    return pairs.withColumn("cut", cut).where("cut IS NOT NULL").select("surface", "cut", F.expr("substr(lemma, length(surface) - cut + 1)").alias("put"))


def learn(pairs: DataFrame, longest: int = LONGEST, least: int = 2) -> DataFrame:
    """ending, cut, put, support: the trie's nodes.  least: pairs that a rule needs."""
    ends = edits(pairs, longest).select(F.explode(F.sequence("cut", F.least(F.lit(longest), F.length("surface")))).alias("k"), "surface", "cut", "put")
    counts = ends.groupBy(F.when(F.col("k") > 0, F.expr("right(surface, k)")).otherwise("").alias("ending"), "cut", "put").agg(F.count("*").alias("support"))
    best = counts.where(F.col("support") >= least).groupBy("ending").agg(F.min(F.struct((-F.col("support")).alias("s"), "cut", "put")).alias("b"))
    rules = best.select("ending", "b.cut", "b.put", (-F.col("b.s")).alias("support"))
    above = rules.select(F.col("ending").alias("__above"), F.struct("cut", "put").alias("__edit"))
    shorter = F.when(F.length("ending") > 0, F.expr("substr(ending, 2)"))
    return rules.join(above, shorter == F.col("__above"), "left").where(F.col("__edit").isNull() | (F.col("__edit") != F.struct("cut", "put"))).select("ending", "cut", "put", "support")


def apply(words: DataFrame, rules: DataFrame, longest: int = LONGEST) -> DataFrame:
    """surface, lemma for words (surface): by the longest ending that has a rule."""
    paths = words.select("surface", F.explode(F.sequence(F.lit(0), F.least(F.lit(longest), F.length("surface")))).alias("k"))
    paths = paths.select("surface", "k", F.when(F.col("k") > 0, F.expr("right(surface, k)")).otherwise("").alias("ending"))
    deepest = paths.join(rules, "ending").groupBy("surface").agg(F.max(F.struct("k", "cut", "put")).alias("r"))
    done = deepest.select("surface", F.concat(F.expr("substr(surface, 1, length(surface) - r.cut)"), "r.put").alias("lemma"))
    return words.join(done, "surface", "left").select("surface", F.coalesce("lemma", "surface").alias("lemma"))


def lemmatiser(words: DataFrame, pairs: DataFrame | None = None, longest: int = LONGEST, least: int = 2) -> DataFrame:
    """surface, lemma for words (word, n), learned from pairs or else from the words themselves."""
    rules = learn(paradigms(words) if pairs is None else pairs, longest, least)
    return apply(words.select(F.col("word").alias("surface")), rules, longest)
