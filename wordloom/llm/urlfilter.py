"""URL filters: pattern rules indexed by their rarest literal token.

Each rule is a regular expression over ``host + path`` together with the literal tokens that every match
must contain.  A pass over the URLs counts only tokens that some rule mentions (a table no larger than the
rule list); each rule is filed under the one that is rarest in the data.  A URL is cut into tokens, the
tokens fetch candidate rules from the index, and only those candidates run their regular expression.

A short list (``LITERAL_RULES``) is a literal of the plan: everything is a projection, without a shuffle, so a host with a third
of all pages is no hot spot.  A longer one is a table, for which the same steps are joins: distinct (page, token) rows meet the rules under
their token, tokens that many pages have by a broadcast of their part of the index (``join_hot``), and the best fitting rule of a page is a
maximum, made in part before its shuffle.  The list itself is what the caller holds; nothing about pages is collected.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no rule and gets the
default verdict; an empty table gives an empty result; repeated rows give repeated results; a rule without a whole token
is tried on every URL; columns beyond the id and URL are ignored, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, if_small, join_hot, table, written

_TOKEN = r"[^a-z0-9]+"
#: Rules that are a literal of the plan; a longer list is a table.
LITERAL_RULES = 100


@dataclass(frozen=True)
class Rule:
    """name: None for the method's own patterns, which yield to named rules whatever their length."""

    verdict: str
    regex: str
    tokens: tuple[str, ...]
    name: str | None = None
    rank: int = 0


def site(verdict: str, host: str, path: str) -> Rule:
    """A host with all its subdomains, and a path prefix.  Host labels are whole tokens of a matching URL;
    the last token of the path may go on there, so it is no key."""
    whole = [t for t in re.split(_TOKEN, host) if t] + [t for t in re.split(_TOKEN, path.lower() + "x") if t][:-1]
    rx = "^(?:[^/]*[.])?" + "".join(f"[{c}]" if c in ".+*?()|{}$" else f"\\{c}" if c in "[]^\\" else c for c in host + path)
    return Rule(verdict, rx, tuple(whole), host + path, len(host + path))


def word(verdict: str, *tokens: str) -> Rule:
    """Tokens that stand next to each other in the host."""
    return Rule(verdict, "^(?:[^/]*[^a-z0-9/])?" + "[^a-z0-9/]".join(tokens) + "(?:[^a-z0-9]|$)", tokens)


def glob(verdict: str, pattern: str, name: str | None = None) -> Rule:
    """A pattern over host and path in which ``*`` stands for any characters and all else for itself; between two
    marks that part tokens, or at an end of the pattern, a token is whole and can be the key."""
    rx = "^" + ".*".join("".join(f"[{c}]" if c in ".+?()|{}$" else f"\\{c}" if c in "[]^\\" else c for c in part) for part in pattern.split("*")) + "$"
    whole = re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", pattern.lower())
    return Rule(verdict, rx, tuple(whole), name, len(pattern))


#: The contract's rules, and the patterns that decide where none of them fits.
RULES = [
    site("allow", "org", "/"),
    site("block", "example.org", "/es/"),
    site("block", "example.org", "/en/1"),
    site("allow", "com", "/fr/"),
    site("block", "com", "/de/"),
    word("block", "spam", "farm"),
    word("block", "cheap", "pills"),
    word("block", "casino"),
    word("block", "adult"),
    word("block", "xxx"),
    word("block", "porn"),
    word("block", "malware"),
    word("block", "phishing"),
    word("block", "warez"),
    word("block", "free", "money"),
    word("block", "click", "bait"),
]


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(place: Column) -> Column:
    return F.filter(F.split(ascii_lower(place), _TOKEN), lambda t: t != "")


def token_counts(places: DataFrame, rules: list[Rule]) -> dict[str, int]:
    """How many URLs hold each token that a rule mentions; as many rows as the rules have tokens, at most."""
    mentioned = sorted({t for r in rules for t in r.tokens})
    hits = places.select(F.explode(F.array_intersect(tokens_of(F.col("place")), F.array(*map(F.lit, mentioned)).cast("array<string>"))).alias("t"))
    return {r["t"]: r["n"] for r in hits.groupBy("t").agg(F.count("*").alias("n")).collect()}


def build_index(rules: list[Rule], counts: dict[str, int]) -> dict[str, list[Rule]]:
    """Rules under their rarest token; those without one under "", which every URL has."""
    index: dict[str, list[Rule]] = {}
    for r in rules:
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), t), default=""), []).append(r)
    return index


_RULE = "struct<named:boolean,rank:int,rule:string,verdict:string,regex:string>"


def _asked(place: Column) -> Column:
    """The tokens under which a URL looks for rules."""
    return F.array_distinct(F.concat(F.array(F.lit("")), tokens_of(place)))


def _by_literal(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """places + best, candidates."""
    index = build_index(rules, token_counts(places, rules))

    def row(r: Rule) -> Column:
        return F.struct(F.lit(r.name is not None).alias("named"), F.lit(r.rank).alias("rank"), F.lit(r.name).cast("string").alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.regex).alias("regex"))

    if not index:
        return places.withColumn("best", F.lit(None).cast(_RULE)).withColumn("candidates", F.lit(0))
    lookup = F.create_map(*(x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*map(row, rs)))))
    known = F.array_intersect(_asked(F.col("place")), F.array(*(F.lit(t) for t in sorted(index))))
    fetched = places.withColumn("fetched", F.flatten(F.transform(known, lambda t: F.element_at(lookup, t))))
    run = F.filter(F.col("fetched"), lambda r: F.rlike(F.col("place"), r["regex"]))
    return fetched.withColumn("best", F.array_max(run)).withColumn("candidates", F.size("fetched")).drop("fetched")


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """no, tokens and _RULE's fields."""
    rows = [(i, list(r.tokens), r.name is not None, r.rank, r.name, r.verdict, r.regex) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, "no int, tokens array<string>, named boolean, rank int, rule string, verdict string, regex string")


def table_index(asked: DataFrame, rules: DataFrame) -> DataFrame:
    """token, n (URLs that ask for it, 1 at least), rules: those that are filed under it.  asked: a row for each URL and token."""
    mentioned = rules.select("no", F.explode(F.array_union(F.array(F.lit("")), "tokens")).alias("token"))
    counts = asked.join(if_small(written(mentioned.select("token").distinct(), "mentioned")), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = mentioned.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    # "" stands for no token: it is taken where there is no other
    keys = rarest.groupBy("no").agg(F.min(F.struct((F.col("token") == "").alias("none"), "n", "token")).alias("k")).select("no", "k.n", "k.token")
    filed = rules.join(keys, "no").select("token", "n", F.struct("named", "rank", "rule", "verdict", "regex").alias("r"))
    return filed.groupBy("token").agg(F.greatest(F.max("n"), F.lit(1)).alias("n"), F.collect_list("r").alias("rules"))


def _by_table(places: DataFrame, rules: list[Rule]) -> DataFrame:
    """As _by_literal.  A URL is one row however many pages have it."""
    urls = written(places.groupBy("place").agg(F.count("*").alias("pages")), "places", regroup=False)
    asked = urls.select("place", F.explode(_asked(F.col("place"))).alias("token"))
    index = written(table_index(asked, rule_table(places.sparkSession, rules)), "rules", regroup=False)
    met = join_hot(asked, index, "token", "n", urls.count()).select("place", F.explode("rules").alias("r"))
    tried = met.groupBy("place").agg(F.max(F.when(F.rlike("place", F.col("r.regex")), F.col("r"))).alias("best"), F.count("*").cast("int").alias("candidates"))
    # pages meet their URL again; one that a third of them have is broadcast
    found = urls.join(tried, "place", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    return join_hot(places, written(found, "verdicts", regroup=False), "place", "pages", places.count()).drop("pages")


def filter_urls(pages: DataFrame, rules: list[Rule] = RULES, url: str = "url", keep: tuple[str, ...] = ("page_id",), default: str = "allow", literal: int = LITERAL_RULES) -> DataFrame:
    """keep + host, path, rule, verdict, candidates (rules that ran).  Named rules come before the method's
    patterns, longer ones before shorter.  No rules: the default verdict."""
    u = F.col(url)
    places = pages.select(*keep, host_of(u).alias("host"), path_of(u).alias("path")).withColumn("place", F.concat("host", "path"))
    found = _by_literal(places, rules) if len(rules) <= literal else _by_table(places, rules)
    return found.select(*keep, "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), "candidates")


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) v(h, q, verdict)),
f AS (
  SELECT p.*, (SELECT arg_max(h || q, length(h || q)) FROM r WHERE (p.host = h OR ends_with(p.host, '.' || h)) AND starts_with(p.path, q)) AS rule
  FROM p)
SELECT page_id, host, path, rule,
  coalesce((SELECT verdict FROM r WHERE h || q = f.rule),
    CASE WHEN regexp_matches(host || path, '^([^/]*[^a-z0-9/])?(spam[^a-z0-9/]farm|cheap[^a-z0-9/]pills|casino|adult|xxx|porn|malware|phishing|warez|free[^a-z0-9/]money|click[^a-z0-9/]bait)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""
