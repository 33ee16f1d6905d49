"""Outside parsers: texts go to them in bounded chunks, and what they say becomes a token table.

A parser is a function from a chunk of text to its sentences, each a list of words with a lemma, a part of speech and
a head.  It is made once in each Python worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from wordloom import schema

from .annotate import Annotator

#: fixed value: characters that a parser gets at once
CHUNK_CHARS = 200_000
#: Function words by the universal tags that parsers use; fixed values.
FUNCTION_POS = ("ADP", "AUX", "CCONJ", "DET", "PART", "PRON", "SCONJ", "PUNCT", "SYM", "SPACE")


@dataclass(frozen=True)
class Word:
    """head: the number of the head among the words of the chunk, or None."""

    surface: str
    lemma: str = ""
    pos: str = ""
    detail: str = ""
    dep: str = ""
    head: int | None = None


Parser = Callable[[str], list[list[Word]]]


def cut_points(text: str, most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Begin and end of pieces of at most ``most`` characters, which together are the text.  A piece ends behind the last
    empty line that it can hold, else behind the last line, else behind the last blank, else where it is full."""
    if most < 1:
        raise ValueError("a chunk has a character at least")
    begin = 0
    while len(text) - begin > most:
        full = begin + most
        ends = (text.rfind(mark, begin, full) + len(mark) for mark in ("\n\n", "\n", " "))
        end = next((e for e, mark in zip(ends, ("\n\n", "\n", " "), strict=True) if e >= begin + len(mark) + 1), full)
        yield begin, end
        begin = end
    if begin < len(text) or not text:
        yield begin, len(text)


def split_chunks(text: str, most: int = CHUNK_CHARS) -> list[str]:
    return [text[a:z] for a, z in cut_points(text, most)]


def token_rows(doc_id: int, text: str, parse: Parser, most: int = CHUNK_CHARS) -> Iterator[tuple[Any, ...]]:
    """(doc_id, sentence_id, position, surface, lemma, pos, detail, dep, head).  Blank words take no position, though a
    sentence of nothing else takes a number; a head that is blank, unknown or the word itself is -1."""
    position = sentence = 0
    for chunk in split_chunks(text, most):
        sentences = parse(chunk)
        words = [w for s in sentences for w in s]
        seen = [bool(w.surface.strip()) for w in words]
        place, n = [], position
        for there in seen:
            place.append(n if there else -1)
            n += there
        k = 0
        for s in sentences:
            for w in s:
                if seen[k]:
                    known = w.head is not None and 0 <= w.head < len(words) and w.head != k
                    yield doc_id, sentence, place[k], w.surface, w.lemma or w.surface, w.pos, w.detail, w.dep, place[w.head] if known else -1
                k += 1
            sentence += 1
        position = n


class ParserAnnotator(Annotator):
    """make: makes the parser, in the worker that uses it; options go to it."""

    supports_dependency = True
    function_pos = FUNCTION_POS

    def __init__(self, language: str, make: Callable[[dict[str, Any]], Parser], chunk_chars: int = CHUNK_CHARS):
        self.language, self.make, self.chunk_chars = language, make, chunk_chars

    def annotate(self, docs: DataFrame, options: dict[str, Any] | None = None) -> DataFrame:
        options = self.default_options() | (options or {})
        make, most = self.make, self.chunk_chars
        names = ["doc_id", "sentence_id", "position", "surface", "lemma", "pos", "pos_detail", "dep", "head"]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parse = make(options)
            for pdf in batches:
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):  # a document at a time: its tokens are many
                    yield pd.DataFrame(list(token_rows(doc_id, text, parse, most)), columns=names)

        rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), self.normalize(docs["text"], options).alias("text"))
        found = rows.mapInPandas(run, "doc_id long, sentence_id long, position long, surface string, lemma string, pos string, pos_detail string, dep string, head long")
        return schema.conform(found.withColumn("is_function", found["pos"].isin(*self.function_pos)))
