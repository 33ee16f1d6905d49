"""Words of texts without blanks: the cheapest path through a lattice of lexicon words.

The lexicon is a table (surface, lemma, orth_base, pos, cost); a trie over it gives the words that begin at a character.  A
path costs its words and the links between their parts of speech.  What no word covers becomes an unknown word: one
character, or the rest of a run of one script.  Among equally cheap paths that of fewest words counts, then the one whose
words come first in the lexicon (in the order of surface, part of speech and lemma).

Costs are whole numbers, a hundred times the negative logarithm of a share, learned from annotated tokens (``learn``) or
from what a first segmentation of the corpus itself finds (``train``): counts are made on the executors, and only the lexicon and one
number for two parts of speech are sent.  Work is in proportion to the characters, sentence by sentence, in Arrow batches.

Defined results: null and empty texts have no tokens; blank sentences take no number; blanks are no tokens; an empty lexicon
leaves runs of script.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom import schema
from wordloom.functions import text as tx
from wordloom.storage import stored

from .annotate import Annotator

#: Entries that are sent to the executors; a lexicon is a list of words of a language, which has no more.
MOST_ENTRIES = 2_000_000
UNKNOWN_POS, NOUN, SYMBOL = "未知語", "名詞", "補助記号"
#: Cost of an unknown word and of each of its characters; of a link that was never seen.
UNKNOWN_WORD, UNKNOWN_CHAR, NO_LINK = 1500, 300, 1000
_SENTENCES = re.compile(r"(?<=[。！？!?])|\n+")


def script(c: str) -> str:
    """What runs of unknown characters are made of."""
    if "一" <= c <= "鿿" or c == "々":
        return "han"
    if "぀" <= c <= "ゟ":
        return "hiragana"
    if "゠" <= c <= "ヿ":
        return "katakana"
    if c.isspace():
        return "blank"
    kind = unicodedata.category(c)[0]
    return "letter" if kind in "LM" else "digit" if kind == "N" else "mark"


@dataclass
class Model:
    """entries: (surface, pos, lemma, orth_base, cost) in order; links: (pos, pos) to cost, "" before a sentence's first word."""

    entries: list[tuple[str, str, str, str, int]]
    links: dict[tuple[str, str], int] = field(default_factory=dict)
    no_link: int = NO_LINK

    def __post_init__(self) -> None:
        # nodes of the trie are numbers, its edges (node, character); entries stand at the node where they end
        self.edges: dict[tuple[int, str], int] = {}
        self.at: dict[int, list[int]] = {}
        for k, (surface, *_) in enumerate(self.entries):
            node = 0
            for c in surface:
                node = self.edges.setdefault((node, c), len(self.edges) + 1)
            self.at.setdefault(node, []).append(k)

    def link(self, left: str, right: str) -> int:
        return self.links.get((left, right), self.no_link if self.links else 0)

    def words_at(self, text: str, i: int, run_end: int) -> list[tuple[int, str, int, int]]:
        """(end, pos, cost, entry or -1) of the words that can begin at a character."""
        found, node = [], 0
        for j in range(i, len(text)):
            node = self.edges.get((node, text[j]), 0)
            if not node:
                break
            found += [(j + 1, self.entries[k][1], self.entries[k][4], k) for k in self.at.get(node, ())]
        kind = script(text[i])
        pos = SYMBOL if kind == "mark" else UNKNOWN_POS if kind == "hiragana" else NOUN
        return found + [(end, pos, UNKNOWN_WORD + UNKNOWN_CHAR * (end - i), -1) for end in sorted({i + 1, run_end})]

    def segment(self, text: str) -> list[tuple[int, int, str, int]]:
        """(begin, end, pos, entry) of the words of a sentence's cheapest path."""
        n = len(text)
        run_end = [n] * n
        for i in range(n - 2, -1, -1):
            run_end[i] = run_end[i + 1] if script(text[i]) == script(text[i + 1]) else i + 1
        words, before = [], [set() for _ in range(n + 1)]
        before[0].add("")
        for i in range(n):
            here = self.words_at(text, i, run_end[i]) if before[i] else []
            words.append(here)
            for end, pos, _, _ in here:
                before[end].add(pos)
        # from the end: the best rest behind each part of speech, as (cost, words, entry, word)
        rest: list[dict[str, tuple]] = [{} for _ in range(n)] + [dict.fromkeys(before[n], (0, 0))]
        for i in range(n - 1, -1, -1):
            ways = [(w[2] + rest[w[0]][w[1]][0], rest[w[0]][w[1]][1] + 1, w[3] if w[3] >= 0 else len(self.entries) + w[0], w) for w in words[i]]
            for left in before[i]:
                rest[i][left] = min(((self.link(left, way[3][1]) + way[0], *way[1:]) for way in ways), key=lambda x: x[:3])
        out, i, left = [], 0, ""
        while i < n:
            end, pos, _, k = rest[i][left][3]
            out.append((i, end, pos, k))
            i, left = end, pos
        return out


def learn(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surface, lemma, pos, cost) and links (before, after, cost), from a token table."""
    counts = tokens.groupBy("surface", "lemma", "pos").agg(F.count("*").alias("n"))
    totals = counts.groupBy("pos").agg(F.sum("n").alias("m"))
    cost = lambda share: F.round(-100 * F.log(share)).cast("int").alias("cost")
    words = counts.join(F.broadcast(totals), "pos").select("surface", "lemma", "pos", cost(F.col("n") / F.col("m")))
    sentence = Window.partitionBy("doc_id", "sentence_id").orderBy("position")
    pairs = tokens.select(F.lag("pos", 1, "").over(sentence).alias("before"), F.col("pos").alias("after")).groupBy("before", "after").agg(F.count("*").alias("n"))
    lefts = pairs.groupBy("before").agg(F.sum("n").alias("m"))
    kinds = totals.agg(F.count("*").alias("k"))
    links = pairs.join(F.broadcast(lefts), "before").crossJoin(F.broadcast(kinds)).select("before", "after", cost((F.col("n") + 1) / (F.col("m") + F.col("k"))))
    return words, links


class LatticeAnnotator(Annotator):
    """lexicon: surface, pos and, where known, lemma, orth_base and cost (without: long words are cheap); links: before, after, cost."""

    def __init__(self, lexicon: DataFrame, links: DataFrame | None = None, language: str = "ja", function_pos: tuple[str, ...] = ("助詞", "助動詞", "補助記号", "記号", "空白")):
        self.language, self.function_pos, self.links = language, function_pos, links
        default = {"lemma": F.col("surface"), "orth_base": F.col("surface"), "cost": F.lit(600) + F.greatest(F.lit(0), 400 - 100 * F.length("surface"))}
        given = [F.coalesce(F.col(c), d).alias(c) if c in lexicon.columns else d.alias(c) for c, d in default.items()]
        # one line for a word of one kind: the cheapest
        entries = lexicon.where(F.length("surface") > 0).select("surface", F.coalesce("pos", F.lit(UNKNOWN_POS)).alias("pos"), *given)
        self.lexicon = entries.groupBy("surface", "pos", "lemma", "orth_base").agg(F.min(F.col("cost").cast("int")).alias("cost"))

    def model(self) -> Model:
        found = self.lexicon.limit(MOST_ENTRIES + 1).collect()
        if len(found) > MOST_ENTRIES:
            raise ValueError(f"a lexicon of more than {MOST_ENTRIES} entries")
        links = {} if self.links is None else {(r["before"], r["after"]): r["cost"] for r in self.links.collect()}  # parts of speech, squared
        return Model(sorted((r["surface"], r["pos"], r["lemma"], r["orth_base"], r["cost"]) for r in found), links)

    def normalize(self, text: Any, options: dict[str, Any]) -> Any:
        text = super().normalize(text, options)
        return tx.nfkc(text) if options.get("nfkc") else text

    def annotate(self, docs: DataFrame, options: dict[str, Any] | None = None) -> DataFrame:
        options = self.default_options() | (options or {})
        by_spelling = options.get("lemma_unit", "lemma") == "orth_base"
        model = self.model()
        sent = docs.sparkSession.sparkContext.broadcast((model.entries, model.links))
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), self.normalize(F.col("text"), options).alias("text"))
        names = ["doc_id", "sentence_id", "position", "surface", "lemma", "pos"]
        kinds = [*[pa.int64()] * 3, *[pa.string()] * 3]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Model(*sent.value)
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*_tokens(doc_id, text, model, by_spelling), strict=True)) or [()] * 6, kinds, strict=True)], names=names)

        found = rows.mapInArrow(run, "doc_id long, sentence_id long, position long, surface string, lemma string, pos string")
        t = found.withColumn("is_function", F.col("pos").isin(*self.function_pos)).withColumn("lemma_label", tx.display_label(F.col("lemma"), F.col("surface")))
        return schema.conform(t)


def _tokens(doc_id: int | None, text: str, model: Model, by_spelling: bool) -> Iterator[tuple]:
    position = sentence = 0
    for part in _SENTENCES.split(text or ""):
        if not part or part.isspace():
            continue
        for begin, end, pos, k in model.segment(part):
            surface = part[begin:end]
            if surface.isspace():
                continue
            lemma, orth = (model.entries[k][2], model.entries[k][3]) if k >= 0 else (surface, surface)
            yield doc_id, sentence, position, surface, orth if by_spelling else lemma, pos
            position += 1
        sentence += 1


def train(docs: DataFrame, lexicon: DataFrame, rounds: int = 2, **options: Any) -> LatticeAnnotator:
    """An annotator whose costs come from the corpus: it is segmented, words and links are counted, and so on.  Entries that were never chosen
    keep the cost of the rarest."""
    by = LatticeAnnotator(lexicon, **options)
    entries = by.lexicon
    for _ in range(rounds):
        tokens = stored(by.annotate(docs, {"lemma_unit": "lemma"}), "segmented")
        words, links = learn(tokens)
        rarest = words.agg(F.max("cost").alias("rarest"))
        known = entries.drop("cost").join(words.withColumnRenamed("cost", "learned"), ["surface", "pos", "lemma"], "left").crossJoin(F.broadcast(rarest))
        by = LatticeAnnotator(stored(known.withColumn("cost", F.coalesce("learned", F.col("rarest") + 100, F.lit(1000))).drop("learned", "rarest"), "lexicon"), stored(links, "links"), **options)
    return by
