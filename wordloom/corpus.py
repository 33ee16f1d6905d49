"""Documents and their tokens, lazily."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom import schema
from wordloom.config import Settings
from wordloom.functions import text as tx
from wordloom.operators import passes
from wordloom.operators.annotate import Annotator, annotator
from wordloom.storage import stored


@dataclass(frozen=True)
class Corpus:
    documents: DataFrame
    tokens: DataFrame
    language: str

    def group_columns(self) -> list[str]:
        return schema.group_columns(self.documents)

    def stored(self) -> Corpus:
        """The same, annotated once: what is asked of it from now on reads the stored tokens."""
        return Corpus(self.documents, stored(self.tokens, "tokens"), self.language)

    def named(self, df: DataFrame) -> DataFrame:
        """df + name: the document's, or its number."""
        names = self.documents.select("doc_id", F.col("name").alias("__name")) if "name" in self.documents.columns else self.documents.select("doc_id", F.lit(None).cast("string").alias("__name"))
        return df.join(names, "doc_id", "left").withColumn("name", F.coalesce("__name", F.col("doc_id").cast("string"))).drop("__name")


def prepared(docs: DataFrame, settings: Settings, by: Annotator | None = None) -> tuple[DataFrame, Annotator, dict[str, Any]]:
    """(cleaned texts, annotator, its options)."""
    by = by or annotator(settings.language)
    cleaned = docs.withColumn("text", tx.apply_cleaning(F.coalesce("text", F.lit("")), bool(settings.cleaning.get("aozora"))))
    return cleaned, by, by.default_options() | settings.language_options


def counted(docs: DataFrame, settings: Settings, what: str, by: Annotator | None = None, lemmas: DataFrame | None = None) -> DataFrame:
    """A corpus's tokens counted by "type", or by "document" and type: see ``passes.annotate``."""
    cleaned, by, options = prepared(docs, settings, by)
    return passes.annotate(by, cleaned, settings.language, options, lemmas, what)


def separated(docs: DataFrame, settings: Settings, by: Annotator | None = None) -> tuple[DataFrame, DataFrame]:
    """A corpus's tokens with separable verbs, counted by type, and those that a dependency joins: see ``passes.separated``."""
    cleaned, by, options = prepared(docs, settings, by)
    return passes.separated(by, cleaned, settings.language, options)


def build(docs: DataFrame, settings: Settings | None = None, by: Annotator | None = None, lemmas: DataFrame | None = None) -> Corpus:
    """docs: doc_id, text and any further columns, which become groups.  lemmas (surface, lemma): what the second lemmatiser
    learns from, where an option asks for it; else it learns from the vocabulary."""
    settings = settings or Settings()
    cleaned, by, options = prepared(docs, settings, by)
    documents = cleaned.withColumn("n_chars", F.length("text").cast("long")).drop("text")
    return Corpus(documents, passes.annotate(by, cleaned, settings.language, options, lemmas), settings.language)


def detect_corpus_language(docs: DataFrame, sample: int = 50, chars: int = 5000) -> DataFrame:
    """One row: the proposal for the first documents together (a sampling operator: a report on sample rows)."""
    first = docs.orderBy("doc_id").limit(sample).select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, chars).alias("head"))
    joined = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", "head"))), lambda x: x["head"]), "\n").alias("text"))
    return joined.select(tx.detect_language(F.col("text")).alias("language"))
