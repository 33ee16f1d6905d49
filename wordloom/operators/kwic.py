"""Concordances.

From documents (``kwic_in_rows``): a document's tokens are an array in its row, and a hit's context is a slice of it.
Nothing is shuffled, and only hits become rows.

From a token table (``kwic``): documents without a hit are left out first, the others' rows are numbered, and a hit
meets its context by an equality join on (document, row).

Adjacency is by rows of the table as given: after a filter, neighbours are those that are left.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern(query: str, case_sensitive: bool = True) -> str:
    """A Python pattern for a whole word as a Java one: Unicode classes, named groups."""
    return f"(?{'U' if case_sensitive else 'iuU'})\\A(?:{re.sub(r'\(\?P<', '(?<', query)})\\z"


def matches(column: Column, query: str, regex: bool = False, case_sensitive: bool = True) -> Column:
    if regex:
        return F.rlike(column, F.lit(pattern(query, case_sensitive)))
    return column == query if case_sensitive else F.lower(column) == query.lower()


def is_hit(tokens: DataFrame, query: str, unit: str = "lemma", regex: bool = False, case_sensitive: bool = True) -> Column:
    """By key or, for lemmas, by label."""
    hit = matches(F.col(unit), query, regex, case_sensitive)
    if unit == "lemma" and "lemma_label" in tokens.columns:
        hit = hit | matches(F.col("lemma_label"), query, regex, case_sensitive)
    return F.coalesce(hit, F.lit(False))


def find_hits(tokens: DataFrame, query: str, unit: str = "lemma", regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    return tokens.where(is_hit(tokens, query, unit, regex, case_sensitive))


def matched_keys(hits: DataFrame, unit: str = "lemma") -> DataFrame:
    return hits.groupBy(F.col(unit).alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")


def numbered(tokens: DataFrame) -> DataFrame:
    """tokens + rn, the row's place in its document."""
    return tokens.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id").orderBy("position")))


def content_context(tokens: DataFrame, query: str, unit: str = "lemma") -> DataFrame:
    """Without function words, but with all hits."""
    return tokens.where(~F.col("is_function") | is_hit(tokens, query, unit))


def in_group(tokens: DataFrame, documents: DataFrame | None, group: str, value: str | None = None, excluded: str | None = None) -> DataFrame:
    """Tokens of the documents with a value or, for None, of those without the excluded one.  Where tokens carry
    the group (or are documents themselves), a filter."""
    g = F.coalesce(F.col(group).cast("string"), F.lit(""))
    wanted = g == value if value is not None else g != (excluded or "")
    if group in tokens.columns:
        return tokens.where(wanted)
    return tokens.join(documents.where(wanted).select("doc_id"), "doc_id", "left_semi")


def near_hits(tokens: DataFrame, query: str, unit: str = "lemma", regex: bool = False, case_sensitive: bool = True) -> DataFrame:
    """The tokens of documents that have a hit, numbered."""
    return numbered(tokens.join(find_hits(tokens, query, unit, regex, case_sensitive).select("doc_id").distinct(), "doc_id", "left_semi"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated once for a row, however often use (or a function within it) asks for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def around(t: Column, i: Column, window: int) -> Column:
    """The tokens within window places of place i (from 0), in order and without it."""
    before = F.slice(t, F.greatest(i - window, F.lit(0)) + 1, F.least(F.lit(window), i))
    return F.concat(before, F.slice(t, i + 2, F.lit(window)))


def sentences(t: Column) -> Column:
    """array<struct<at, x>>: the tokens of each sentence that has some, and the place (from 0) of its first.  One pass
    over the document finds where sentences begin, and each token is copied once."""
    begins = F.array_compact(F.transform(t, lambda x, i: F.when((i == 0) | (F.get(t, i - 1)["sentence_id"] != x["sentence_id"]), i)))
    return let(begins, lambda b: F.transform(b, lambda a, j: F.struct(a.alias("at"), F.slice(t, a + 1, F.coalesce(F.get(b, j + 1), F.size(t)) - a).alias("x"))))


def _line(t: Column, x: Column, i: Column, unit: str, window: int, display: str) -> Column:
    """The concordance line of token x at place i (from 0) of t."""
    beside = {k: F.coalesce(F.get(t, i + k)[display], F.lit("")) for k in range(-window, window + 1) if k}
    left, right = ([c.alias(_name(k)) for k, c in beside.items() if (k < 0) == before] for before in (True, False))
    return F.struct(x["position"].alias("position"), x["sentence_id"].alias("sentence_id"), x[unit].alias("key"), *left, x[display].alias("KWIC"), *right)


def _as_rows(rows: DataFrame, lines: Column, window: int, keep: tuple[str, ...]) -> DataFrame:
    """A row for each line of a document, with its sides as text."""
    found = rows.select("doc_id", *keep, F.explode(lines).alias("x")).select("doc_id", "x.*", *keep)
    names = {"left": range(-window, 0), "right": range(1, window + 1)}
    sides = [F.array_join(F.filter(F.array(*(F.col(_name(k)) for k in ks)) if ks else F.array().cast("array<string>"), lambda x: x != ""), " ").alias(name) for name, ks in names.items()]
    return found.select(*(c for c in found.columns if c not in keep), *sides, *keep)


def lines_at(rows: DataFrame, places: str, unit: str = "lemma", window: int = 5, display: str = "surface", keep: tuple[str, ...] = ()) -> DataFrame:
    """The concordance of the tokens at the places (from 0) that a column of rows lists."""
    return _as_rows(rows, F.transform(places, lambda i: _line(F.col("t"), F.get("t", i.cast("int")), i.cast("int"), unit, window, display)), window, keep)


def kwic_in_rows(rows: DataFrame, query: str, unit: str = "lemma", window: int = 5, regex: bool = False, case_sensitive: bool = True, display: str = "surface", collocate: str | None = None, scope: str = "sentence", content: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """As ``kwic``, for rows from ``annotate.in_rows``.  content: without function words, but with all hits; keep: further
    columns of rows.  The work of a document is in proportion to its tokens: hits are lines before they become rows."""
    if collocate and scope not in ("sentence", "fixed"):
        raise ValueError(f"unknown scope {scope}")

    def hit(x: Column) -> Column:
        return matches(x[unit], query, regex, case_sensitive)

    def other(x: Column) -> Column:
        return matches(x[unit], collocate or "")

    def line(t: Column, x: Column, i: Column) -> Column:
        return _line(t, x, i, unit, window, display)

    def found(t: Column) -> Column:
        if collocate and scope == "sentence":
            return F.flatten(F.transform(sentences(t), lambda s: let(F.size(F.filter(s["x"], other)), lambda n: F.array_compact(F.transform(s["x"], lambda x, i: F.when(hit(x) & (n > F.coalesce(other(x), F.lit(False)).cast("int")), line(t, x, s["at"] + i)))))))
        if collocate:
            return F.array_compact(F.transform(t, lambda x, i: F.when(hit(x), F.when(F.exists(around(t, i, window), other), line(t, x, i)))))
        return F.array_compact(F.transform(t, lambda x, i: F.when(hit(x), line(t, x, i))))

    shown = F.filter("t", lambda x: ~x["is_function"] | matches(x[unit], query)) if content else F.col("t")
    return _as_rows(rows, let(shown, found), window, keep)


def _offsets(window: int) -> Column:
    return F.explode(F.array(*(F.lit(k) for k in range(-window, window + 1) if k)))


def hits_near(rows: DataFrame, hits: DataFrame, collocate: str, unit: str = "lemma", scope: str = "sentence", window: int = 5) -> DataFrame:
    """The hits with another token that matches collocate in their sentence, or within window rows.  rows, hits: with rn."""
    other = rows.where(is_hit(rows, collocate, unit))
    if scope == "sentence":
        # two counts per sentence decide it: any match but the hit itself
        per = other.groupBy("doc_id", "sentence_id").agg(F.count("*").alias("__n"))
        own = is_hit(rows, collocate, unit).cast("int")
        return hits.join(per, ["doc_id", "sentence_id"]).where(F.col("__n") > own).drop("__n")
    if scope != "fixed":
        raise ValueError(f"unknown scope {scope}")
    around = other.select("doc_id", "rn", _offsets(window).alias("k")).select("doc_id", (F.col("rn") + F.col("k")).alias("rn")).distinct()
    return hits.join(around, ["doc_id", "rn"], "left_semi")


def kwic(tokens: DataFrame, query: str, unit: str = "lemma", window: int = 5, regex: bool = False, case_sensitive: bool = True, display: str = "surface", collocate: str | None = None, scope: str = "sentence") -> DataFrame:
    """doc_id, position, sentence_id, key, Lw..L1, KWIC, R1..Rw, left, right; blanks beyond a document's edge."""
    rows = near_hits(tokens, query, unit, regex, case_sensitive)
    hits = find_hits(rows, query, unit, regex, case_sensitive)
    if collocate:
        hits = hits_near(rows, hits, collocate, unit, scope, window)
    hits = hits.select("doc_id", "rn", "position", "sentence_id", F.col(unit).alias("key"), F.col(display).alias("KWIC"))
    asked = hits.select("doc_id", F.col("rn").alias("hit"), _offsets(window).alias("k")).withColumn("rn", F.col("hit") + F.col("k")) if window else None
    order = [-k for k in range(window, 0, -1)] + list(range(1, window + 1))
    if asked is not None:
        found = asked.join(rows.select("doc_id", "rn", F.col(display).alias("d")), ["doc_id", "rn"]).groupBy("doc_id", F.col("hit").alias("rn")).agg(*(F.max(F.when(F.col("k") == k, F.col("d"))).alias(_name(k)) for k in order))
        hits = hits.join(found, ["doc_id", "rn"], "left")
    blank = {_name(k): F.coalesce(F.col(_name(k)), F.lit("")) for k in order}

    def side(ks: list[int]) -> Column:
        return F.array_join(F.filter(F.array(*(blank[_name(k)] for k in ks)) if ks else F.array().cast("array<string>"), lambda x: x != ""), " ")

    left, right = [k for k in order if k < 0], [k for k in order if k > 0]
    return hits.select("doc_id", "position", "sentence_id", "key", *(blank[_name(k)].alias(_name(k)) for k in left), "KWIC", *(blank[_name(k)].alias(_name(k)) for k in right), side(left).alias("left"), side(right).alias("right"))


def _name(k: int) -> str:
    return f"L{-k}" if k < 0 else f"R{k}"


def sort_kwic(lines: DataFrame, by: str = "R1", ascending: bool = True) -> DataFrame:
    """Text order breaks ties; an unknown column leaves text order."""
    first = [F.col(by).asc() if ascending else F.col(by).desc()] if by in lines.columns else []
    return lines.orderBy(*first, "doc_id", "position")


def page(lines: DataFrame, number: int = 0, size: int = 500, most: int = 5000, by: str = "R1", ascending: bool = True) -> DataFrame:
    """A page of the sorted concordance, of which at most ``most`` lines are shown."""
    start = number * size
    return sort_kwic(lines, by, ascending).offset(start).limit(max(0, min(size, most - start)))


def drilldown(row: dict) -> dict:
    """kwic() arguments that show where a row of a frequency, collocation or keyness table comes from."""
    if "collocate" in row:
        method = row.get("method", "sentence")
        return {"query": row["node"], "collocate": row["collocate"], "scope": "fixed" if method == "fixed" else "sentence", "window": row.get("window", 5)}
    return {"query": row["word"]}
