"""What a language's options change about tokens, as passes over word types.

An option's work depends on a word's form and part of speech alone: a second lemma, or the parts of a compound.  So tokens are
counted by type once, every option adds a column to the few types, and the types that change anything meet the tokens in one
join.  Only the joining of a verb with its prefix looks at a token's neighbours; it is found within a document's row, and the
document carries what was found to its tokens.  So tokens of frequent types, which are nearly all, are never shuffled.

Defined results: without an option tokens are those of the annotator; documents are told apart by their ids; null and empty texts have no
tokens; a language without passes has none.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.storage import stored

from . import german, lemmas
from .annotate import MARK, TOKEN, Annotator, NativeAnnotator, join_separable_verbs
from .basic import repeated_ids

#: Rows that are sent to the executors whole.
MOST_SENT = 200_000
#: Beyond, types with one of so many tokens are sent, at most so many; the rest, with few tokens, is shuffled.
SHARE = 1_000_000


def planned(language: str, options: dict[str, Any]) -> list[str]:
    """The passes that these options ask for, in order."""
    if language != "de":
        return []
    asked = {"lemma_mode": options.get("lemma_mode", "own") != "own", "compound_split": bool(options.get("compound_split")), "separable_verbs": bool(options.get("separable_verbs"))}
    return [name for name, on in asked.items() if on]


def _meet(tokens: DataFrame, types: DataFrame, changed: DataFrame, columns: list[str]) -> DataFrame:
    """tokens + columns of changed, a part of types (surface, pos, n), by a left join in which no key is large."""
    on = ["surface", "pos"]
    side = changed.select(*on, *columns)
    if changed.count() <= MOST_SENT:
        return tokens.join(F.broadcast(side), on, "left")
    total = types.agg(F.sum("n")).first()[0]
    hot = F.col("n") * SHARE > total
    often = F.broadcast(stored(types.where(hot).select(*on).join(side, on, "left"), "often"))
    rest = tokens.join(F.broadcast(types.where(hot).select(*on)), on, "left_anti")
    return tokens.join(often, on).unionByName(rest.join(changed.where(~hot).select(*on, *columns), on, "left"))


def annotate(by: Annotator, docs: DataFrame, language: str, options: dict[str, Any], pairs: DataFrame | None = None, counted: str | None = None) -> DataFrame:
    """The tokens of docs with what options ask for.  pairs (surface, lemma): what the second lemmatiser learns from, instead of
    the vocabulary.  counted: "type" or "document", for the native annotator's tokens counted by type, or by document and type
    (without separable verbs, which are found by place)."""
    todo, native = planned(language, options), isinstance(by, NativeAnnotator)
    if counted and (not native or "separable_verbs" in todo):
        raise ValueError("only types are counted")
    tokens = by.annotate(docs, options) if not counted else stored(by.types(docs, options), "by-type") if counted == "type" else by.counted(docs, options)
    if not todo:
        return tokens
    mode, lower = options.get("lemma_mode", "own"), bool(options.get("lowercase"))
    if mode not in german.MODES:
        raise ValueError(f"unknown mode {mode}")
    low = F.lower if lower else lambda c: c
    names = tokens.columns
    same = tokens.schema["lemma_label"].metadata.get("same_as") == "lemma"
    by_type = tokens if counted == "type" or not native else by.types(docs, options)
    types = stored(by_type.groupBy("surface", "pos").agg((F.sum("n") if native else F.count("*")).alias("n")), "types")
    words = types.where(F.col("pos").isin(*german.CONTENT, "WORD")).groupBy(F.col("surface").alias("word")).agg(F.sum("n").alias("n"))
    own_verbs = "separable_verbs" in todo and native
    if own_verbs:
        found = stored(german.separated(by.in_rows(docs, options, function_words=False), words, lambda c: by.pos(c) == "WORD"), "separated").withColumnRenamed("marks", "__marks")
        side = F.broadcast(found) if found.count() <= MOST_SENT else found
        tokens = by.annotate(docs.join(side, "doc_id", "left"), options, carry=("__marks",))
    changes, columns = types, []
    if "lemma_mode" in todo:
        other = lemmas.lemmatiser(words, pairs).where("lemma <> surface").select("surface", F.col("lemma").alias("__other"))
        changes = changes.join(other, "surface", "left")
        columns.append("__other")
    if "compound_split" in todo:
        parts = german.scored_compounds(types).select("surface", "pos", F.col("parts").alias("__parts"))
        changes = changes.join(parts, ["surface", "pos"], "left")
        columns.append("__parts")
    if columns:
        changed = stored(changes.where(F.coalesce(*columns).isNotNull()), "changes")
        tokens = _meet(tokens, types, changed, columns)
    new: dict[str, Any] = {}
    if mode == "other":
        mark = F.col("pos").isin("PUNCT", "NUM")
        second = low(F.coalesce("__other", "surface"))
        new |= {c: F.when(mark, F.col(c)).otherwise(second) for c in ("lemma", "lemma_label")}
    if mode == "both":
        new["lemma_alt"] = F.when(F.col("pos").isin(*german.CONTENT, "WORD"), low(F.coalesce("__other", "surface"))).otherwise(F.lit(""))
    if "__parts" in columns and counted == "type":
        names = [*names, "compound_parts"]
        new["compound_parts"] = F.coalesce(low(F.col("__parts")), F.lit(""))
    elif "__parts" in columns:
        new["compound_parts"] = F.coalesce(low(F.col("__parts")), "compound_parts")
    tokens = tokens.select(*(new.get(c, F.col(c)).alias(c) for c in names), *(["__marks"] if own_verbs else []))
    if mode == "other" and not lower:
        tokens = german.recapitalise_nouns(tokens)
    if own_verbs:
        tokens = german.join_separated(tokens, "__marks").select(*names)
    elif "separable_verbs" in todo:
        tokens = join_separable_verbs(tokens)
    # what passes do to a lemma they do to its label
    return tokens.withColumn("lemma_label", F.col("lemma").alias("lemma_label", metadata={"same_as": "lemma"})) if same else tokens


def separated(by: Annotator, docs: DataFrame, language: str, options: dict[str, Any]) -> tuple[DataFrame, DataFrame]:
    """What ``annotate`` with separable verbs alone gives, without a row for each token: its tokens counted by type, and those that a dependency joins (doc_id,
    position, lemma, lemma_label, dep, head; positions tell a document's tokens apart, no more).  Where tokens have other dependencies, or
    documents share an id, the tokens themselves, twice."""
    native = isinstance(by, NativeAnnotator) and (type(by).cut, type(by).words, type(by).normalize) == (NativeAnnotator.cut, NativeAnnotator.words, NativeAnnotator.normalize)
    if not native or planned(language, options) != ["separable_verbs"] or repeated_ids(docs.where("doc_id IS NOT NULL")).limit(1).count():
        tokens = annotate(by, docs, language, options)
        return tokens, tokens
    types = stored(by.types(docs, options), "types")
    words = types.where(F.col("pos").isin(*german.CONTENT, "WORD")).select(F.col("surface").alias("word"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), by.normalize(F.col("text"), options).alias("text"))
    pairs = german.separated_pairs(german.closed_clauses(texts, TOKEN, MARK), words, lambda c: by.pos(c) == "WORD")
    verb, particle = by.lemma(F.col("surface"), options), by.lemma(F.col("particle"), options)
    pairs = stored(pairs.select("*", verb.alias("verb_lemma"), particle.alias("particle_lemma"), by.pos(F.col("particle")).alias("particle_pos")), "separated")
    joined = F.concat("prefix", "verb_lemma")
    # a pair takes its tokens from their types and adds them to others
    def token(surface: str, lemma: Any, pos: Any, function: Any, n: int) -> Any:
        return F.struct(F.col(surface).alias("surface"), lemma.alias("lemma"), pos.alias("pos"), function.alias("is_function"), F.lit(n).cast("long").alias("n"))

    word, no = F.lit("WORD"), F.lit("WORD").isin(*by.function_pos)
    own = F.col("particle_pos").isin(*by.function_pos)
    moved = F.array(token("surface", F.col("verb_lemma"), word, no, -1), token("surface", joined, word, no, 1), token("particle", F.col("particle_lemma"), F.col("particle_pos"), own, -1), token("particle", F.col("particle_lemma"), F.lit("PART"), F.lit(True), 1))
    keys = ["surface", "lemma", "pos", "is_function"]
    moved = pairs.select(F.explode(moved).alias("x")).select("x.*").groupBy(*keys).agg(F.sum("n").alias("n"))
    changed = types.select(*keys, "n").unionByName(moved).groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0")
    none, label = F.lit(-1).cast("long"), F.col("lemma").alias("lemma_label", metadata={"same_as": "lemma"})
    two = F.array(F.struct(F.col("verb").alias("position"), joined.alias("lemma"), F.lit("").alias("dep"), none.alias("head")), F.struct(F.col("at").alias("position"), F.col("particle_lemma").alias("lemma"), F.lit("svp").alias("dep"), F.col("verb").alias("head")))
    linked = pairs.select("doc_id", F.explode(two).alias("x")).select("doc_id", "x.*")
    return changed.select("surface", "lemma", label, "pos", "is_function", "n"), linked.select("doc_id", "position", "lemma", label, "dep", "head")
