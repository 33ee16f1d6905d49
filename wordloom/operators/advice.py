"""What can be chosen for a language, and what one should know about a choice and about the texts."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.config import DEFAULTS
from wordloom.functions import text as tx


@dataclass(frozen=True)
class Option:
    key: str
    label: str
    default: Any
    choices: tuple[str, ...] = ()
    help: str = ""

    @property
    def kind(self) -> str:
        return "choice" if self.choices else "bool"


_OPTIONS: dict[str, list[tuple[str, str, tuple[str, ...], str]]] = {
    "ja": [
        ("lemma_unit", "What a word is counted under", ("lemma", "orth_base"), "lemma: its dictionary entry; orth_base: its base form in the spelling of the text."),
        ("nfkc", "Fold character widths", (), "Width then makes no difference to a letter, digit or mark."),
    ],
    "en": [
        ("lowercase", "Fold case", (), "Capitals then make no difference."),
    ],
    "de": [
        ("lemma_mode", "Lemmas", ("own", "other", "both"), "own: the annotator's; other: learned from word endings; both: counted by the first, with the second beside it."),
        ("separable_verbs", "Join verbs with their prefixes", (), "A prefix that closes a clause goes to the verb it makes another word of."),
        ("compound_split", "Find the parts of compounds", (), "A compound keeps its own count; its parts can be counted beside it."),
        ("lowercase", "Fold case", (), "Nouns then lose what sets them apart from verbs and adjectives of the same letters."),
        ("norm_1996", "Modern spelling", (), "Words that the reform of 1996 changed are counted under one spelling."),
        ("norm_ss", "ss for ß", (), "One spelling for texts with and without ß."),
        ("norm_umlaut", "ae, oe, ue for ä, ö, ü", (), "One spelling for texts with and without umlauts."),
    ],
}


def option_schema(language: str) -> list[Option]:
    """Options of a language, with their defaults; none for one without."""
    defaults = {"lemma_mode": "own"} | DEFAULTS["languages"].get(language, {})
    return [Option(key, label, defaults.get(key, False), choices, text) for key, label, choices, text in _OPTIONS.get(language, [])]


#: (language, option, value for which it holds or None, warning).
_WARNINGS: list[tuple[str, str, Any, str]] = [
    ("ja", "", None, "What counts as a word is what the lexicon lists, so longer expressions fall into several words. Name the lexicon in a report."),
    ("ja", "lemma_unit", "lemma", "Spellings of one entry are added up; orth_base keeps them apart."),
    ("ja", "lemma_unit", "lemma", "Entries can share a label; where a table shows a label twice, its keys differ."),
    ("en", "", None, "Classes of words are the annotator's own; name it, with its version, in a report."),
    ("en", "lowercase", True, "Names and common words of the same letters are one word."),
    ("de", "", None, "Classes and lemmas are the annotator's own; name it, with the way lemmas are made, in a report."),
    ("de", "lowercase", True, "Nouns, verbs and adjectives of the same letters are one word. Make sure that this is wanted."),
    ("de", "separable_verbs", False, "A verb and a prefix that stands apart are two words, so the verb that they make is undercounted."),
    ("de", "compound_split", False, "A compound is one word. Many will occur once only, which leaves little for collocations and key words."),
    ("de", "compound_split", True, "Where compounds are cut is estimated from the corpus; go through the list of parts."),
    ("de", "lemma_mode", "both", "Counts follow the annotator's lemmas; a table lists the words whose learned lemma is another."),
]


def language_warnings(language: str, options: dict[str, Any] | None = None) -> list[str]:
    now = {o.key: o.default for o in option_schema(language)} | (options or {})
    return [text for code, key, value, text in _WARNINGS if code == language and (not key or now.get(key) == value)]


def spelling_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row: old and new spellings in all texts."""
    own = docs.select(tx.orthography_counts(F.col(text)).alias("c"))
    return own.agg(F.coalesce(F.sum("c.old"), F.lit(0)).alias("old"), F.coalesce(F.sum("c.new"), F.lit(0)).alias("new"))


def mixed_spelling(docs: DataFrame, text: str = "text", at_least: int = 3) -> DataFrame:
    """One row: old, new, mixed (both occur at least so often)."""
    return spelling_counts(docs, text).withColumn("mixed", tx.is_mixed(F.col("old"), F.col("new"), at_least))


def data_warnings(docs: DataFrame, language: str, options: dict[str, Any] | None = None, text: str = "text") -> list[dict[str, Any]]:
    """message, suggest_option, suggest_value: German texts in both spellings, unless they are made one anyway."""
    now = {o.key: o.default for o in option_schema(language)} | (options or {})
    if language != "de" or now["norm_1996"]:
        return []
    r = mixed_spelling(docs, text).first()
    if not r["mixed"]:
        return []
    message = f"Words that the reform of 1996 changed stand in their old spelling {r['old']:,} times and in the new one {r['new']:,} times. Counted apart, each looks rarer than it is; norm_1996 counts them together."
    return [{"message": message, "suggest_option": "norm_1996", "suggest_value": True}]
