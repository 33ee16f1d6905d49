"""Toxicity by a weighted finite-state pattern grammar.

The grammar is the composition of small transducers over token classes: insult I, violent verb V, intent M, intensifier A,
target P, negation N, reported speech R, quotation mark, end of clause ".", other o.  In order:

* the threat transducer writes a violent verb as a threat T where an intent stands before it (*will kill*, not *kill*);
* the insult transducer writes an insult that an intensifier leads, or that follows another insult, as a stronger one, J;
* the negation transducer marks insults and threats in its scope, the reported-speech transducer those after a verb of
  saying, the quotation transducer those between two quotation marks, over clauses and lines up to the closing mark;
* the target transducer marks those near a person addressed.

What the composition writes is a count of accepted patterns ("a targeted insult", "a negated threat", ...), not of words: a
clause without an accepted pattern adds nothing, and the sums over all insults and threats leave out negated and reported
ones.  A document's score is a logistic function of its pattern weights.

Closed classes are word lists; insults are learned: among whole words and word beginnings of the labelled
training rows, those that occur in enough toxic texts and hardly in others, each weighted by its log odds.
The weights of the patterns are then fitted on the same rows.  Both fits use at most ``MAX_TRAINING`` labelled rows, those
whose ids hash lowest, and equal texts count once; all documents are scored, whole.

Defined results: null and empty texts have no clause and get the score of that; without usable labels no
insult is known and all scores are those of the prior; null labels and ids are no training rows; rows with a null id are not held
out; a quotation mark without a partner opens nothing; repeated rows
are scored each; an empty table gives no rows; other columns are ignored or, in ``drop_toxic``, kept.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, small_batches, table, written
from .wordhash import Batch, Table

MAX_TRAINING, THRESHOLD = 20_000, 0.7
#: A word or beginning is an insult if so many toxic texts have it (and this share of them), and of the
#: texts that have it this share is toxic.  As each has its share of the toxic texts, there are at most 1 / MIN_SHARE
#: times as many as a toxic training text has words and beginnings.
MIN_SUPPORT, MIN_SHARE, MIN_PRECISION = 3, 0.01, 0.9
PREFIXES = range(3, 9)

TARGETS = "you your yours yourself u they them their he him his she her we us people man woman everyone anyone du dich dir dein deine euch ihr ihnen sie er ihn man leute tu te toi ton ta tes vous votre vos il elle ils elles lui leur gens ti tus tuyo usted ustedes vosotros ellos ellas gente".split()
NEGATIONS = "not no never none nobody neither nor cannot isn aren don doesn didn won wouldn nicht kein keine keinen nie niemals ne n pas jamais aucun aucune non nunca jamas tampoco ningun ninguna sin".split()
REPORTS = "said says say called calls wrote writes told tells claimed quoted according sagte sagt nannte schrieb behauptet laut dit disait appelle affirme selon dijo dice llamaba escribe afirma segun".split()
VIOLENCE = "kill killed hurt destroy beat smash burn shoot stab strangle murder attack punish die toeten umbringen vernichten schlagen verbrennen tuer frapper detruire bruler matar golpear destruir quemar".split()

INTENTS = "will ll gonna going shall must should want wanna deserve werde wirst wird werden soll sollte muss vais vas va allons vont dois doit voy vas vamos quiero debe debes".split()
INTENSIFIERS = "such so very total totally complete completely absolute utter fucking damn bloody big real echt total voll so ganz verdammter verdammte tellement tres vrai sale gros tan muy maldito maldita puro".split()

_CLAUSE = re.compile(r"[.!?;:\n…]+")
_QUOTES = str.maketrans(dict.fromkeys("“”„«»‹›\"", ' " '))
_APART = str.maketrans({c: " " for c in map(chr, range(128)) if not c.isalnum() and c != '"'})
_OTHER_MARKS = re.compile(r"[^\w\x00-\x7f]")
_OCTETS = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Transducer:
    """Deterministic: from a state and a symbol to a state and the symbol written."""

    start: object
    step: Callable[[object, str], tuple[object, str]]


def compose(*machines: Transducer) -> Transducer:
    """Each machine reads what the one before it writes."""

    def step(state: tuple, symbol: str) -> tuple[tuple, str]:
        new = []
        for m, s in zip(machines, state, strict=True):
            s, symbol = m.step(s, symbol)
            new.append(s)
        return tuple(new), symbol

    return Transducer(tuple(m.start for m in machines), step)


def table_of(machine: Transducer, symbols: str) -> tuple[dict[tuple[int, str], tuple[int, str]], int]:
    """The reachable states as a table."""
    number, todo, rows = {machine.start: 0}, [machine.start], {}
    while todo:
        state = todo.pop()
        for symbol in symbols:
            to, out = machine.step(state, symbol)
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            rows[number[state], symbol] = number[to], out
    return rows, len(number)


def threat(reach: int) -> Transducer:
    """Writes a violent verb up to reach tokens after an intent as a threat."""

    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == "M":
            return reach, "o"
        return 0 if symbol == "." else max(0, left - 1), "T" if symbol == "V" and left else symbol

    return Transducer(0, step)


def insult(reach: int) -> Transducer:
    """Writes an insult up to reach tokens after an intensifier or another insult as a stronger one."""

    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == "I":
            return reach, "J" if left else "I"
        if symbol == "A":
            return reach, "o"
        return 0 if symbol in '."' else max(0, left - 1), symbol

    return Transducer(0, step)


def scope(opener: str, mark: str, reach: int) -> Transducer:
    """Marks what can be meant up to reach tokens after an opener, within the clause."""

    def step(left: int, symbol: str) -> tuple[int, str]:
        if symbol == opener:
            return reach, symbol
        return 0 if symbol == "." else max(0, left - 1), symbol + mark if left and symbol[0] in MEANT else symbol

    return Transducer(0, step)


def quoted(mark: str) -> Transducer:
    """Marks what stands between two quotation marks, however far apart."""

    def step(inside: bool, symbol: str) -> tuple[bool, str]:
        if symbol == '"':
            return not inside, symbol
        return inside, symbol + mark if inside and symbol[0] in MEANT else symbol

    return Transducer(False, step)


def near_target(reach: int) -> Transducer:
    """Marks insults and threats after a target with "+", and writes a target after one of them as "P+"."""

    def step(state: tuple[int, int], symbol: str) -> tuple[tuple[int, int], str]:
        target, insult = state
        if symbol == ".":
            return (0, 0), symbol
        down = max(0, target - 1), max(0, insult - 1)
        if symbol[0] == "P":
            return (reach, 0), "P+" if insult else "P"
        if symbol[0] in MEANT:
            return (down[0], reach), symbol + "+" * bool(target)
        return down, symbol

    return Transducer((0, 0), step)


#: What is insulting (I, J), threatening (T) or at least violent (V).
MEANT = "IJTV"
#: Intents reach four tokens, intensifiers two, negation three, reported speech eight, quotation marks to their end, targets four.
GRAMMAR = compose(threat(4), insult(2), scope("N", "-", 3), scope("R", "r", 8), quoted("q"), near_target(4))
ROWS, _ = table_of(GRAMMAR, 'IVMAPNR".o')
PATTERNS = sorted({out for _, out in ROWS.values() if out[0] in MEANT or out == "P+"})
FEATURES = ["insults", "threats", "density", *PATTERNS]
#: Patterns that are meant: neither negated nor reported nor quoted.
PLAIN = {p for p in PATTERNS if not set(p) & set("-rq")}


class Lexicon:
    """Classes and weights of words.  Which words are insults or threats is remembered by their hashes, for up to
    ``most`` words."""

    def __init__(self, insults: dict[str, float], most: int = 400_000):
        self.words = {k[1:]: w for k, w in insults.items() if k[0] == "="}
        self.starts = {k[1:]: w for k, w in insults.items() if k[0] == "^"}
        self.closed = {w: c for c, ws in (("P", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("M", INTENTS), ("A", INTENSIFIERS), ("V", VIOLENCE), ('"', ['"'])) for w in ws}
        self.hot, self.most = Table(), most

    def __call__(self, word: str) -> tuple[str, float]:
        """Class and weight; the longest known beginning counts."""
        if (w := self.words.get(word)) is not None:
            return "I", w
        for k in reversed(PREFIXES):
            if len(word) >= k and (w := self.starts.get(word[:k])) is not None:
                return "I", w
        return self.closed.get(word, "o"), 1.0

    def screen(self, lowered: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text: whether it has an insult or a threat, and how many words."""
        batch = Batch([words_for_screening(t) for t in lowered])
        if self.hot.size > self.most:
            self.hot = Table()
        is_hot = self.hot.get(batch.hash)
        missing = np.flatnonzero(is_hot < 0)
        if len(missing):
            new, first, back = np.unique(batch.hash[missing], return_index=True, return_inverse=True)
            found = np.array([self(w.decode())[0] in "IV" for w in batch.words(missing[first])], dtype=np.int64)
            self.hot.put(new, found)
            is_hot[missing] = found[back]
        text = np.repeat(np.arange(len(lowered)), batch.count)
        return np.bincount(text, is_hot, len(lowered)) > 0, batch.count


def _blank(mark: re.Match) -> str:
    """Marks and white space part words; what combines with a letter, or is not seen, does not."""
    c = mark.group()
    return c if unicodedata.category(c)[0] in "MC" and not c.isspace() else " "


def parted(text: str) -> str:
    """Quotation marks as words, and blanks for all else outside ASCII that parts words: for the screen and the grammar."""
    text = text.translate(_QUOTES) if any(q in text for q in "“”„«»‹›\"") else text
    return text if text.isascii() else _OTHER_MARKS.sub(_blank, text)


def words_for_screening(text: str) -> bytes:
    """Words between blanks."""
    return parted(text).encode().translate(_OCTETS)


def patterns(lowered: str, n_words: int, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of a text in lower case."""
    out = np.zeros(len(FEATURES))
    sums: Counter = Counter()
    state, text = 0, parted(lowered)
    quotes = text.count('"')
    pairs = quotes - quotes % 2
    for clause in _CLAUSE.split(text):
        classes = [lexicon(w) for w in clause.translate(_APART).split()]
        # of a clause that says nothing only quotation marks reach beyond its end
        if not any(c in "IV" for c, _ in classes):
            classes = [x for x in classes if x[0] == '"']
        for c, weight in [*classes, (".", 1.0)]:
            if c == '"':
                pairs -= 1
                c = c if pairs >= 0 else "o"
            state, said = ROWS[state, c]
            if said[0] in MEANT or said == "P+":
                sums[said] += weight if c == "I" else 1.0
    insults, threats = (sum(v for k, v in sums.items() if k in PLAIN and k[0] in cs) for cs in ("IJ", "T"))
    out[:3] = math.log1p(insults), math.log1p(threats), 100 * insults / (100 + n_words)
    out[3:] = [math.log1p(sums[p]) for p in PATTERNS]
    return out


def features(texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """(texts, FEATURES).  Clauses are read only where a word of the text is an insult or a threat."""
    out = np.zeros((len(texts), len(FEATURES)))
    for at in range(0, len(texts), 200):
        lowered = [(t or "").lower() for t in texts[at : at + 200]]
        hot, n_words = lexicon.screen(lowered)
        for i in np.flatnonzero(hot).tolist():
            out[at + i] = patterns(lowered[i], int(n_words[i]), lexicon)
    return out


def word_features(text: str | None) -> set[str]:
    words = {w.decode() for w in words_for_screening((text or "").lower()).split()}
    return {"=" + w for w in words} | {"^" + w[:k] for w in words for k in PREFIXES if len(w) >= k}


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> DataFrame:
    """text, toxic of at most ``most`` labelled rows outside the held-out fold; equal texts once."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1))
    some = usable.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic")).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # most rows of two numbers
    return joined.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")).select("text", "toxic")


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic:
        return {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys = list(a.keys() | b.keys())
            return pa.record_batch([pa.array(keys, pa.string()), pa.array([a[k] for k in keys], pa.int64()), pa.array([b[k] for k in keys], pa.int64())], names=["f", "a", "b"])

        a: Counter = Counter()
        b: Counter = Counter()
        for batch in batches:
            for t, y in zip(batch.column(0), batch.column(1), strict=True):
                (a if y.as_py() else b).update(word_features(t.as_py()))
                if len(a) + len(b) > 300_000:
                    yield out()
                    a.clear()
                    b.clear()
        yield out()

    seen = map_arrow(rows, count, "f string, a bigint, b bigint").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    support = max(MIN_SUPPORT, MIN_SHARE * toxic)
    good = seen.where((F.col("a") >= support) & (F.col("a") >= MIN_PRECISION * (F.col("a") + F.col("b"))))
    return choose({r["f"]: (r["a"], r["b"]) for r in good.collect()}, toxic, clean)


def choose(found: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Log odds of the candidates {feature: (toxic texts, other texts)} worth keeping.  A beginning gives way to a
    longer one or a word that stands for nearly all of its texts; what is left of the longer ones gives way to it."""

    def shorter(f: str) -> list[str]:
        return ["^" + f[1 : 1 + k] for k in PREFIXES if k < len(f) - 1 or (f[0] == "=" and k == len(f) - 1)]

    vague = {p for f, (a, _) in found.items() for p in shorter(f) if p in found and a >= 0.95 * found[p][0]}
    kept = {f: n for f, n in found.items() if f not in vague}
    odds = {f: math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) for f, (a, b) in kept.items() if not any(p in kept for p in shorter(f))}
    return {f: w for f, w in odds.items() if w > 0}


#: Before any row is seen: insults and threats speak for toxicity, much less if negated or reported.
PRIOR = np.array([-2.0, 1.0, 0.3, 0.0, *(0.2 * (p[0] in "IJT") * (1 if p in PLAIN else 0.5) for p in PATTERNS)])


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 50) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to PRIOR (pattern weights more strongly)."""
    w, x = PRIOR.copy(), np.hstack((np.ones((len(x), 1)), x))
    draw = np.array([0.01, *[penalty] * 3, *[4 * penalty] * len(PATTERNS)])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(draw), x.T @ (y - p) - draw * (w - PRIOR))
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


@dataclass(frozen=True)
class Model:
    insults: dict[str, float]
    weights: np.ndarray

    def scores(self, texts: list[str | None], lexicon: Lexicon) -> np.ndarray:
        z = features(texts, lexicon) @ self.weights[1:] + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING) -> Model:
    rows = written(training_rows(docs, labels, most), "toxic")
    insults = learn_lexicon(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(insults)
        for b in batches:
            yield pa.record_batch([pa.array(features(b.column(0).to_pylist(), lexicon).tolist(), pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    got = map_arrow(rows, run, "x array<double>, toxic int").collect()  # most rows at most
    x = np.array([r["x"] for r in got]).reshape(-1, len(FEATURES))
    return Model(insults, fit(x, np.array([r["toxic"] for r in got], dtype=float)))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(model.insults)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(model.scores(b.column(1).to_pylist(), lexicon))], names=["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return map_arrow(docs.select(F.col(key).alias("key"), F.col(text)), run, f"key {kind}, score double").withColumnRenamed("key", key)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the texts that score at least threshold."""
    model = train(docs, labels)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.insults)
        for t in texts:
            yield pd.Series(model.scores(t.tolist(), lexicon))

    return docs.withColumn("__toxic", scored("text")).where(F.col("__toxic") < threshold).drop("__toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
