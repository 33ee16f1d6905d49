"""Token counts of texts for a byte-level BPE tokenizer, without their ids.

A tokenizer of this kind cuts a text into pre-tokens and each pre-token into pieces, whatever stands beside it.  So
pieces are counted once for each distinct pre-token of the corpus, and a text's tokens are a sum over its pre-tokens.

1. A pass over the texts collects the distinct pre-tokens with their occurrences; those that are vocabulary entries
   themselves need no more than a table as long as the vocabulary.
2. The pieces of every other distinct pre-token are counted, once, on the executors.
3. A second pass takes each document's pre-token frequencies.  What the vocabulary or a frequent pre-token answers is
   summed on the spot; the rest meets its pieces by a join on the pre-token, and sums come together by document.

Frequent pre-tokens have at least a millionth of all occurrences outside the vocabulary: at most a million, whatever
the input.  They are what is sent to the executors, so no key of the join is frequent.

Pre-tokens are found in numpy, on classes of characters (letter, number, blank, other) that the library itself is
asked for, so its version of Unicode counts.  Strings of added tokens inside a text are one token each, as the library has it.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted one by one, ids may be null
or repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table, written

LETTER, NUMBER, BLANK, OTHER, UNKNOWN = range(5)
#: Characters that are cut at a time; distinct pre-tokens that a task holds.
PART, HELD = 1 << 20, 300_000
_SAFE = re.compile(r"(?<=[A-Za-z0-9]) (?=[A-Za-z0-9])")


class PreTokens:
    """Texts to lists of pre-tokens, for tokenizers whose pre-tokenizer is byte-level with its usual pattern: 's 't 're
    've 'm 'll 'd; letters, numbers or other marks with one space before them; blanks but for the last before a word."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        kind = made.get("pre_tokenizer") or {}
        added = made.get("added_tokens") or []
        plain = all(not x.get(k) for x in added for k in ("lstrip", "rstrip", "single_word", "normalized"))
        if made.get("normalizer") or kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex", True) or not plain:
            raise ValueError(f"{path}: not a plain byte-level tokenizer")
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = sorted((x["content"] for x in added), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, names))) if names else None
        self.classes = np.full(0x110000, UNKNOWN, dtype=np.uint8)

    def pieces(self, pre_tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(pre_tokens, add_special_tokens=False)]

    def vocabulary(self) -> dict[str, int]:
        """Pieces of the vocabulary's entries that are texts (an entry can be half a character)."""
        words = [w for w in (self.tokenizer.decode([i], skip_special_tokens=False) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=False))) if w and "�" not in w]
        return dict(zip(words, self.pieces(words), strict=True))

    def _class_of(self, c: str) -> int:
        """How the library joins a character to its neighbours."""
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        first = [x[1] for x in cut(f"a{c}1")]
        if first == [(0, 2), (2, 3)]:
            return LETTER
        if first == [(0, 1), (1, 3)] and c != " ":
            return NUMBER
        return OTHER if [x[1] for x in cut(f"!{c}!")] == [(0, 3)] else BLANK

    def _cut(self, segments: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """The segments in one string, where pre-tokens begin in it, and where segments begin."""
        whole = "".join(segments)
        n = len(whole)
        c = np.zeros(n + 3, dtype=np.uint32)
        c[:n] = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        kind = self.classes[c]
        if (kind[:n] == UNKNOWN).any():
            for x in np.unique(c[:n][kind[:n] == UNKNOWN]).tolist():
                self.classes[x] = self._class_of(chr(x))
            kind = self.classes[c]
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        begins = np.cumsum(lengths) - lengths
        edge = np.zeros(n + 3, dtype=bool)
        edge[begins] = True
        edge[n:] = True
        start = edge.copy()
        start[1:n] |= kind[1:n] != kind[: n - 1]
        # the last blank before something else stands apart, and a space goes with it
        blank = kind[: n - 1] == BLANK if n else np.zeros(0, dtype=bool)
        last = np.flatnonzero(blank & (kind[1:n] != BLANK) & ~edge[1:n])
        start[last] = True
        start[last[c[last] == 32] + 1] = False
        # short forms, where a lone apostrophe begins a pre-token
        q = np.flatnonzero((c[:n] == 39) & start[:n])
        q = q[~edge[q + 1] & (kind[q + 1] == LETTER)]
        one, two = c[q + 1], np.where(edge[q + 2], 0, c[q + 2])
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = (np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        start[q[short | long] + 1] = False
        start[q[short] + 2] = True
        start[q[long] + 3] = True
        return whole, np.flatnonzero(start[:n]), begins

    @staticmethod
    def _parts(text: str) -> list[str]:
        """A long text in parts, cut where a pre-token surely begins: at a space between two plain characters."""
        out, at = [], 0
        while len(text) - at > PART and (m := _SAFE.search(text, at + PART)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, list[str], int]]:
        """(number of the text, some of its pre-tokens, added tokens beside them); a text comes in one or several parts, in order."""
        waiting: list[tuple[int, str]] = []
        size = 0

        def ready() -> Iterator[tuple[int, list[str], int]]:
            whole, at, begins = self._cut([s for _, s in waiting])
            ends = at.tolist()[1:] + [len(whole)]
            tokens = [whole[i:j] for i, j in zip(at.tolist(), ends, strict=True)]
            first = np.searchsorted(at, begins).tolist()
            for (i, _), x, y in zip(waiting, first, [*first[1:], len(tokens)], strict=True):
                yield i, tokens[x:y], 0

        for i, text in enumerate(texts):
            segments = [text]
            if self.added is not None and (found := len(self.added.findall(text))):
                yield i, [], found
                segments = self.added.split(text)
            for part in (p for s in segments for p in self._parts(s) if p):
                waiting.append((i, part))
                size += len(part)
                if size >= PART:
                    yield from ready()
                    waiting, size = [], 0
        if waiting:
            yield from ready()


@lru_cache(maxsize=1)
def _pre_tokens(path: str) -> PreTokens:
    return PreTokens(path)


@lru_cache(maxsize=1)
def _vocabulary(path: str) -> dict[str, int]:
    return _pre_tokens(path).vocabulary()


def _path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def _texts(column: pa.Array) -> list[str]:
    return [t or "" for t in column.to_pylist()]


def _distinct(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    path = _path(path)
    cut, known = _pre_tokens(path), _vocabulary(path)
    held: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        rest = [(t, n) for t, n in held.items() if t not in known]
        return pa.record_batch([pa.array([t for t, _ in rest], pa.string()), pa.array([n for _, n in rest], pa.int64())], names=["token", "n"])

    for b in batches:
        for _, tokens, _ in cut(_texts(b.column(0))):
            held.update(tokens)
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def _with_pieces(batches: Iterator[pa.RecordBatch], path: str | None) -> Iterator[pa.RecordBatch]:
    cut = _pre_tokens(_path(path))
    for b in batches:
        yield pa.record_batch([*b.columns, pa.array(cut.pieces(b.column(0).to_pylist()), pa.int32())], names=["token", "n", "pieces"])


def pre_token_pieces(docs: DataFrame, tokenizer_path: str | None = None, text: str = "text") -> DataFrame:
    """token, n (occurrences), pieces: the distinct pre-tokens that are no vocabulary entries."""
    found = map_arrow(docs.select(F.col(text).alias("text")), lambda it: _distinct(it, tokenizer_path), "token string, n bigint")
    return map_arrow(found.groupBy("token").agg(F.sum("n").alias("n")), lambda it: _with_pieces(it, tokenizer_path), "token string, n bigint, pieces int")


def _frequencies(batches: Iterator[pa.RecordBatch], path: str | None, frequent: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """A row (row, doc_id, n_bytes, null, tokens known here) for each text, and (row, null, null, token, times) for the others."""
    path = _path(path)
    cut, known = _pre_tokens(path), _vocabulary(path) | frequent
    for b in batches:
        numbers, texts = b.column(0).to_pylist(), _texts(b.column(2))
        sums = [0] * len(texts)
        rest: Counter[tuple[int, str]] = Counter()
        for i, tokens, added in cut(texts):
            here = added
            for t, n in Counter(tokens).items():
                if (pieces := known.get(t)) is not None:
                    here += n * pieces
                else:
                    rest[i, t] += n
            sums[i] += here
        none = pa.nulls(len(rest), pa.int64())
        lengths = pa.array([len(t.encode()) for t in texts], pa.int64())
        yield pa.record_batch([b.column(0), b.column(1), lengths, pa.nulls(len(texts), pa.string()), pa.array(sums, pa.int64())], names=["row", "doc_id", "n_bytes", "token", "times"])
        yield pa.record_batch([pa.array([numbers[i] for i, _ in rest], pa.int64()), none, none, pa.array([t for _, t in rest], pa.string()), pa.array(rest.values(), pa.int64())], names=["row", "doc_id", "n_bytes", "token", "times"])


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = 512, text: str = "text", key: str = "doc_id", share: int = 1_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, a row for each of docs.

    share: pre-tokens with at least one of so many occurrences are sent to the executors, at most so many."""
    pieces = written(pre_token_pieces(docs, tokenizer_path, text), "pieces")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    often = F.col("n") * share >= total
    frequent = {r["token"]: r["pieces"] for r in pieces.where(often).select("token", "pieces").collect()}  # at most share rows
    sent = docs.sparkSession.sparkContext.broadcast(frequent)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    counts = map_arrow(rows, lambda it: _frequencies(it, tokenizer_path, sent.value), "row bigint, doc_id bigint, n_bytes bigint, token string, times bigint")
    # Rows that ask for no pre-token are dealt out by their numbers: a line end before digits is in no pre-token.
    asked = counts.withColumn("token", F.coalesce("token", F.concat(F.lit("\n"), F.col("row").cast("string"))))
    met = asked.join(pieces.where(~often).select("token", "pieces"), "token", "left")
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(F.col("times") * F.coalesce("pieces", F.lit(1))).alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
