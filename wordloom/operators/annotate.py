"""Text to token table.

The native annotator is one projection and one generator: sentences are cut behind their terminators, tokens
taken from each sentence, and a token's position is its place among all of them.  No shuffle and no Python.  A
document's tokens can also stay together in its row (``in_rows``), for concordances and the like.  Other annotators plug in
as subclasses; tables annotated elsewhere come in through ``schema.conform``.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom import schema
from wordloom.config import DEFAULTS
from wordloom.functions import text as tx

from . import advice
from .kwic import let

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
#: The tokens that are no words: one sign each.
MARK = r"[^\s\p{L}\p{M}\p{N}]"
TERMINATORS = ".!?。！？"
#: Closed-class words by language: articles, pronouns, prepositions, conjunctions, auxiliaries, particles.
FUNCTION_WORDS = {
    "en": "a an the this that these those i you he she it we they me him her us them my your his its our their of in on at by to for from with and or but not no as if is are was were be been has have had do does did will would can could which who".split(),
    "de": "der die das den dem des ein eine einen einem einer eines ich du er sie es wir ihr und oder aber nicht kein in im an am auf aus bei mit nach von vom zu zum zur für ist sind war sein hat haben wird werden als wie dass sich".split(),
    "fr": "le la les un une des du de d l et ou mais ne pas je tu il elle nous vous ils elles ce cette ces dans en sur pour par avec qui que à au aux est sont a se son sa ses".split(),
    "es": "el la los las un una unos unas de del al y o pero no yo tú él ella nosotros ellos ellas en con por para que se su sus es son ha lo le les como".split(),
}
ALL_FUNCTION_WORDS = sorted({w for ws in FUNCTION_WORDS.values() for w in ws})


def runs(words: Column) -> Column:
    """array<struct<word, n>>: an array's words, counted."""

    def of(a: Column) -> Column:
        begins = F.array_compact(F.transform(a, lambda x, i: F.when((i == 0) | (x != F.get(a, i - 1)), i)))
        return let(begins, lambda b: F.transform(b, lambda at, j: F.struct(F.get(a, at).alias("word"), (F.coalesce(F.get(b, j + 1), F.size(a)) - at).cast("long").alias("n"))))

    return let(F.sort_array(words), of)


class Annotator(ABC):
    """annotate(): documents (doc_id, text, ...) to a table of schema.TOKENS."""

    language = ""
    supports_dependency = False
    function_pos: tuple[str, ...] = ("PUNCT", "FUNC")

    def default_options(self) -> dict[str, Any]:
        return dict(DEFAULTS["languages"].get(self.language, {}))

    def option_schema(self) -> list[advice.Option]:
        return advice.option_schema(self.language)

    def language_warnings(self, options: dict[str, Any] | None = None) -> list[str]:
        return advice.language_warnings(self.language, options)

    def data_warnings(self, docs: DataFrame, options: dict[str, Any] | None = None) -> list[dict[str, Any]]:
        return advice.data_warnings(docs, self.language, options)

    def normalize(self, text: Column, options: dict[str, Any]) -> Column:
        return tx.unix_newlines(F.coalesce(text, F.lit("")))

    @abstractmethod
    def annotate(self, docs: DataFrame, options: dict[str, Any] | None = None) -> DataFrame: ...


class NativeAnnotator(Annotator):
    """Coarse but exact: words, numbers and marks; a lemma is the lower-cased word (German keeps its case).

    language: a code, or a column of docs that holds one for each document."""

    def __init__(self, language: str = "en", language_col: str | None = None, stopwords: list[str] | None = None):
        self.language, self.language_col, self.stopwords = language, language_col, stopwords

    def normalize(self, text: Column, options: dict[str, Any]) -> Column:
        text = super().normalize(text, options)
        if options.get("nfkc"):
            text = tx.nfkc(text)
        for name, f in (("norm_1996", tx.normalize_1996), ("norm_ss", tx.normalize_ss), ("norm_umlaut", tx.normalize_umlaut)):
            if options.get(name):
                text = f(text)
        return text

    def cut(self, text: Column) -> Column:
        """array<struct<s, w>>: the words of a text in order, each with its sentence's number."""
        sentences = F.split(text, f"(?<=[{TERMINATORS}])")
        return F.flatten(F.transform(sentences, lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(TOKEN), F.lit(0)), lambda w: F.struct(i.alias("s"), w.alias("w")))))

    def words(self, text: Column) -> Column:
        """array<string>: the words of ``cut``.  No token holds a terminator and another sign, so sentences need not be cut for them."""
        if type(self).cut is NativeAnnotator.cut:
            return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
        return F.transform(self.cut(text), lambda x: x["w"])

    def lemma(self, surface: Column, options: dict[str, Any]) -> Column:
        low = F.lower(surface)
        if self.language_col:
            return F.when(F.col("lang") == "de", surface).otherwise(low)
        return low if options.get("lowercase", True) else surface

    def pos(self, surface: Column) -> Column:
        mark = ~F.rlike(surface, F.lit(r"^[\p{L}\p{M}\p{N}]"))
        return F.when(mark, "PUNCT").when(F.rlike(surface, F.lit("^[0-9]+$")), "NUM").when(F.lower(surface).isin(self.stopwords if self.stopwords is not None else ALL_FUNCTION_WORDS), "FUNC").otherwise("WORD")

    def _cut_rows(self, docs: DataFrame, options: dict[str, Any], carry: tuple[str, ...]) -> DataFrame:
        lang = F.coalesce(F.col(self.language_col), F.lit("")) if self.language_col else F.lit(self.language)
        kept = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), *kept, self.cut(self.normalize(F.col("text"), options)).alias("t"))

    def word_rows(self, docs: DataFrame, unit: str = "lemma", options: dict[str, Any] | None = None, carry: tuple[str, ...] = (), function_words: bool = True) -> DataFrame:
        """doc_id, carry, words: a document's words (surfaces or lemmas) in order as an array<string>, for what needs no sentences."""
        options = self.default_options() | (options or {})
        lang = F.coalesce(F.col(self.language_col), F.lit("")) if self.language_col else F.lit(self.language)
        kept = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), *kept, self.words(self.normalize(F.col("text"), options)).alias("words"))
        words = F.col("words") if function_words else F.filter("words", lambda w: ~self.is_function(w))
        if unit == "lemma":
            words = F.transform(words, lambda w: self.lemma(w, options))
        return rows.select("doc_id", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)), words.alias("words"))

    def types(self, docs: DataFrame, options: dict[str, Any] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """carry, surface, lemma, lemma_label, pos, is_function, n: tokens counted by type.  Lemma and part of speech depend on a
        word's form (and language) alone, so they are found once a type and not once a token."""
        options = self.default_options() | (options or {})
        lang = F.coalesce(F.col(self.language_col) == "de", F.lit(False)) if self.language_col else F.lit(False)
        kept = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
        names = [f"carried_{i}" for i in range(len(carry))]
        tokens = docs.select(lang.alias("de"), *kept, F.explode(self.words(self.normalize(F.col("text"), options))).alias("surface"))
        found = tokens.groupBy("de", *names, "surface").agg(F.count("*").alias("n")).withColumn("lang", F.when(F.col("de"), "de").otherwise(""))
        found = found.select(*names, "surface", "n", self.lemma(F.col("surface"), options).alias("lemma"), self.pos(F.col("surface")).alias("pos"))
        label = F.col("lemma").alias("lemma_label", metadata={"same_as": "lemma"})
        return found.select(*(F.col(c).alias(name) for c, name in zip(names, carry)), "surface", "lemma", label, "pos", F.col("pos").isin(*self.function_pos).alias("is_function"), "n")

    def counted(self, docs: DataFrame, options: dict[str, Any] | None = None) -> DataFrame:
        """doc_id, surface, lemma, lemma_label, pos, is_function, compound_parts, n: tokens counted by document and type, in a document's row."""
        options = self.default_options() | (options or {})
        lang = F.coalesce(F.col(self.language_col), F.lit("")) if self.language_col else F.lit(self.language)
        words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.explode(runs(self.words(self.normalize(F.col("text"), options)))).alias("x"))
        words = words.select("doc_id", F.col("x.word").alias("surface"), self.lemma(F.col("x.word"), options).alias("lemma"), self.pos(F.col("x.word")).alias("pos"), F.col("x.n").alias("n"))
        label = F.col("lemma").alias("lemma_label", metadata={"same_as": "lemma"})
        return words.select("doc_id", "surface", "lemma", label, "pos", F.col("pos").isin(*self.function_pos).alias("is_function"), F.lit("").alias("compound_parts"), "n")

    def possible(self, docs: DataFrame, word: str, options: dict[str, Any] | None = None) -> DataFrame:
        """The documents that can have a word: a cheap look at texts, before they are cut.  Not for other than ASCII letters,
        whose small forms can depend on their neighbours; then all."""
        if not re.fullmatch("[A-Za-z]+", word) or type(self).lemma is not NativeAnnotator.lemma:
            return docs
        text = self.normalize(F.col("text"), self.default_options() | (options or {}))
        return docs.where(F.contains(F.lower(text), F.lit(word.lower())))

    def sentences_with(self, docs: DataFrame, word: str, options: dict[str, Any] | None = None) -> DataFrame:
        """As ``in_rows`` for what stays within a sentence, of the sentences that can have a word alone (see ``possible``); sentence_id and
        position tell them and their tokens apart, no more."""
        docs = self.possible(docs, word, options)
        if not re.fullmatch("[A-Za-z]+", word) or type(self).lemma is not NativeAnnotator.lemma or type(self).cut is not NativeAnnotator.cut:
            return self.in_rows(docs, options, function_words=False)
        options = self.default_options() | (options or {})
        sentences = F.split(self.normalize(F.col("text"), options), f"(?<=[{TERMINATORS}])")
        chosen = F.array_join(F.transform(F.filter(sentences, lambda x: F.contains(F.lower(x), F.lit(word.lower()))), lambda x: F.concat(x, F.lit(" "))), "")
        # a sentence without a terminator is the text's last, so those that are left are cut at the same places again
        return self.in_rows(docs.withColumn("text", chosen), {o: False for o in ("nfkc", "norm_1996", "norm_ss", "norm_umlaut")} | {"lowercase": options.get("lowercase", True)}, function_words=False)

    def is_function(self, word: Column) -> Column:
        """pos in function_pos, for words of ``cut``.  A mark is one character, and numbers are no function words: so most words are only looked up."""
        own = type(self)
        if own.cut is not NativeAnnotator.cut or own.pos is not NativeAnnotator.pos or self.function_pos != ("PUNCT", "FUNC"):
            return self.pos(word).isin(*self.function_pos)
        listed = [w for w in (self.stopwords if self.stopwords is not None else ALL_FUNCTION_WORDS) if not re.fullmatch("[0-9]+", w)]
        return F.lower(word).isin(listed) | ((F.length(word) == 1) & ~F.rlike(word, F.lit(r"^[\p{L}\p{M}\p{N}]")))

    def token_counts(self, docs: DataFrame, options: dict[str, Any] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """doc_id, carry, n_tokens: a document's tokens, counted in its row."""
        rows = self.word_rows(docs, "surface", options, carry)
        return rows.select("doc_id", *carry, F.size("words").cast("long").alias("n_tokens"))

    def in_rows(self, docs: DataFrame, options: dict[str, Any] | None = None, carry: tuple[str, ...] = (), function_words: bool = True) -> DataFrame:
        """doc_id, carry, t: a document's tokens as one array<struct<position, sentence_id, surface, lemma, is_function>>, for
        operators whose work stays within a document.  function_words: whether is_function is needed (else it is false)."""
        options = self.default_options() | (options or {})

        def token(x: Column, i: Column) -> Column:
            fn = self.is_function(x["w"]) if function_words else F.lit(False)
            return F.struct(i.cast("long").alias("position"), x["s"].cast("long").alias("sentence_id"), x["w"].alias("surface"), self.lemma(x["w"], options).alias("lemma"), fn.alias("is_function"))

        rows = self._cut_rows(docs, options, carry)
        return rows.select("doc_id", *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)), F.transform("t", token).alias("t"))

    def annotate(self, docs: DataFrame, options: dict[str, Any] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
        """carry: columns of docs that each token keeps, so that tokens need not meet their documents again."""
        options = self.default_options() | (options or {})
        own = [F.col(f"carried_{i}") for i in range(len(carry))]
        d = self._cut_rows(docs, options, carry).select("doc_id", "lang", *own, F.posexplode("t").alias("i", "x"))
        d = d.select("doc_id", F.col("x.s").cast("long").alias("sentence_id"), F.col("i").cast("long").alias("position"), F.col("x.w").alias("surface"), "lang", *own)
        d = d.select("doc_id", "sentence_id", "position", "surface", self.lemma(F.col("surface"), options).alias("lemma"), self.pos(F.col("surface")).alias("pos"), *own)
        return d.select(
            "doc_id",
            "sentence_id",
            "position",
            "surface",
            "lemma",
            F.col("lemma").alias("lemma_label", metadata={"same_as": "lemma"}),
            "pos",
            F.lit("").alias("pos_detail"),
            F.col("pos").isin(*self.function_pos).alias("is_function"),
            F.lit("").alias("dep"),
            F.lit(-1).cast("long").alias("head"),
            F.lit("").alias("lemma_alt"),
            F.lit("").alias("compound_parts"),
            *(F.col(f"carried_{i}").alias(c) for i, c in enumerate(carry)),
        )


class JapaneseScriptAnnotator(NativeAnnotator):
    """Runs of one script as tokens; a stand-in where no dictionary is at hand.  Particles written in hiragana
    of one or two characters count as function words."""

    RUNS = r"[一-鿿々]+|[぀-ゟ]+|[゠-ヿー]+|[\p{L}\p{M}\p{N}]+|[^\s\p{L}\p{M}\p{N}]"
    function_pos = ("補助記号", "助詞")

    def __init__(self) -> None:
        super().__init__("ja")

    def cut(self, text: Column) -> Column:
        # blank sentences take no number
        parts = F.filter(F.split(text, r"(?<=[。！？!?])|\n+"), lambda x: F.rlike(x, F.lit(r"(?U)\S")))
        return F.flatten(F.transform(parts, lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(self.RUNS), F.lit(0)), lambda w: F.struct(i.alias("s"), w.alias("w")))))

    def lemma(self, surface: Column, options: dict[str, Any]) -> Column:
        return surface

    def pos(self, surface: Column) -> Column:
        return F.when(~F.rlike(surface, F.lit(r"^[\p{L}\p{M}\p{N}]")), "補助記号").when(F.rlike(surface, F.lit("^[぀-ゟ]{1,2}$")), "助詞").otherwise("名詞")


_REGISTRY = {"en": lambda: NativeAnnotator("en"), "de": lambda: NativeAnnotator("de"), "fr": lambda: NativeAnnotator("fr"), "es": lambda: NativeAnnotator("es"), "ja": JapaneseScriptAnnotator}


def register(language: str, make: Any) -> None:
    """Plug an annotator in (with a dictionary, a parser, ...)."""
    _REGISTRY[language] = make


def languages() -> list[str]:
    return list(_REGISTRY)


def annotator(language: str) -> Annotator:
    return _REGISTRY[language]()


def join_separable_verbs(tokens: DataFrame) -> DataFrame:
    """A prefix token (dep "svp") goes into its verb's lemma and becomes a particle.  Several prefixes of one verb
    stack, the last one foremost."""
    parts = tokens.where("dep = 'svp' AND head >= 0").groupBy("doc_id", F.col("head").alias("position")).agg(F.array_join(F.transform(F.reverse(F.sort_array(F.collect_list(F.struct("position", F.lower("surface").alias("p"))))), lambda x: x["p"]), "").alias("__prefix"))
    prefix, svp = F.coalesce("__prefix", F.lit("")), F.col("dep") == "svp"
    joined = tokens.join(parts, ["doc_id", "position"], "left")
    new = {"lemma": F.concat(prefix, "lemma"), "lemma_label": F.concat(prefix, "lemma_label"), "pos": F.when(svp, "PART").otherwise(F.col("pos")), "is_function": F.col("is_function") | svp}
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in tokens.columns))


def lemma_comparison(tokens: DataFrame) -> DataFrame:
    """Where a second lemmatiser differs, by how often."""
    other = tokens.where("lemma_alt <> '' AND lemma_alt <> lemma")
    return other.groupBy("surface", "lemma", "lemma_alt").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "surface", "lemma", "lemma_alt")
