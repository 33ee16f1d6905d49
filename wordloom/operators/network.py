"""Co-occurrence networks.  Words are ranked among selected tokens; pairs are counted over all tokens, among those
words.  There are at most ``top_n`` words, so all pairs of them are bounded, and what a sentence holds of them is too."""

from __future__ import annotations

import html
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import measures

from .basic import select_tokens
from .frequency import vocabulary


def top_nodes(tokens: DataFrame, unit: str = "lemma", include_function_words: bool = False, top_n: int = 60) -> DataFrame:
    words = vocabulary(select_tokens(tokens, include_function_words).where(F.col(unit).isNotNull()), unit)
    return words.select("word", F.coalesce("label", "word").alias("label"), "freq").orderBy(F.desc("freq"), "word").limit(top_n)


def pair_counts(tokens: DataFrame, nodes: DataFrame, unit: str = "lemma", method: str = "sentence", window: int = 5) -> tuple[DataFrame, DataFrame]:
    """(a, b, cooccur) with a < b, and (word, unit_freq)."""
    names = nodes.select("word")
    own = tokens.select("doc_id", "sentence_id", "position", F.col(unit).alias("word")).join(names, "word", "left_semi")
    if method == "sentence":
        sets = own.groupBy("doc_id", "sentence_id").agg(F.sort_array(F.collect_set("word")).alias("ws"))  # at most top_n words each
        freq = sets.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("unit_freq"))
        pairs = F.flatten(F.transform("ws", lambda a, i: F.transform(F.slice("ws", i + 2, F.size("ws")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        counted = sets.where(F.size("ws") > 1).select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("cooccur"))
    elif method == "fixed":
        freq = own.groupBy("word").agg(F.count("*").alias("unit_freq"))
        ahead = own.select("doc_id", F.col("word").alias("x"), "position", F.explode(F.sequence(F.lit(1), F.lit(window))).alias("k")).select("doc_id", "x", (F.col("position") + F.col("k")).alias("position"))
        met = ahead.join(own.select("doc_id", "position", F.col("word").alias("y")), ["doc_id", "position"]).where("x <> y")
        counted = met.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.count("*").alias("cooccur"))
    else:
        raise ValueError(f"unknown method {method}")
    return counted, freq


def edges(tokens: DataFrame, nodes: DataFrame, unit: str = "lemma", method: str = "sentence", window: int = 5, min_log_dice: float = 7.0, min_cooccur: int = 2) -> DataFrame:
    """a, b, cooccur, log_dice."""
    pairs, freq = pair_counts(tokens, nodes, unit, method, window)
    fa, fb = (freq.select(F.col("word").alias(k), F.col("unit_freq").alias(f"u{k}")) for k in "ab")
    scored = pairs.join(fa, "a").join(fb, "b").withColumn("log_dice", measures.log_dice(F.col("cooccur"), F.col("ua"), F.col("ub")))
    return scored.where((F.col("log_dice") >= min_log_dice) & (F.col("cooccur") >= min_cooccur)).select("a", "b", "cooccur", "log_dice")


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """word, label, freq, degree, degree_centrality, of words that are linked."""
    ends = links.select(F.explode(F.array("a", "b")).alias("word")).groupBy("word").agg(F.count("*").alias("degree"))
    n = ends.agg(F.count("*").alias("n"))
    out = nodes.join(ends, "word").crossJoin(F.broadcast(n))
    return out.select("word", "label", "freq", "degree", F.coalesce(F.try_divide(F.col("degree").cast("double"), (F.col("n") - 1).cast("double")), F.lit(0.0)).alias("degree_centrality")).orderBy(F.desc("degree_centrality"), "word")


#: Links that are sent to the executors whole.
MOST_LINKS = 500_000


def neighbours(pairs: list[tuple[str, str]]) -> dict[str, list[str]]:
    near: dict[str, list[str]] = {}
    for a, b in sorted(pairs):
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    return near


def paths_through(near: dict[str, list[str]], source: str) -> dict[str, float]:
    """How much of the shortest paths from source to all others leads through each node (Brandes 2001)."""
    order, before = [source], {v: [] for v in near}
    paths, depth = dict.fromkeys(near, 0), {source: 0}
    paths[source] = 1
    for v in order:
        for u in near[v]:
            if u not in depth:
                depth[u] = depth[v] + 1
                order.append(u)
            if depth[u] == depth[v] + 1:
                paths[u] += paths[v]
                before[u].append(v)
    carried = dict.fromkeys(near, 0.0)
    for u in reversed(order):
        for v in before[u]:
            carried[v] += paths[v] / paths[u] * (1 + carried[u])
    return {u: x for u, x in carried.items() if u != source and x}


def shares_of_paths(pairs: list[tuple[str, str]], sources: list[str] | None = None) -> dict[str, float]:
    """Betweenness, as a share of the pairs without the node; of the paths from some nodes only, where sources are named."""
    near = neighbours(pairs)
    score, n = dict.fromkeys(near, 0.0), len(near)
    for source in near if sources is None else sources:
        for v, x in paths_through(near, source).items():
            score[v] += x
    return {v: s / max(1, (n - 1) * (n - 2)) for v, s in score.items()}


def betweenness(links: DataFrame) -> DataFrame:
    """word, betweenness of an unweighted graph.

    The links go to every task, at most MOST_LINKS; the nodes are dealt out, and each is the source of one search."""
    spark = links.sparkSession
    pairs = [(r["a"], r["b"]) for r in links.select("a", "b").limit(MOST_LINKS + 1).collect()]
    if len(pairs) > MOST_LINKS:
        raise ValueError(f"more than {MOST_LINKS} links")
    sent = spark.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = [x for pdf in batches for x in pdf["word"]]
        yield pd.DataFrame([x for x in shares_of_paths(sent.value, own).items() if own], columns=["word", "x"]).astype({"x": float})

    sources = links.select(F.col("a").alias("word")).unionByName(links.select(F.col("b").alias("word"))).distinct()
    parts = sources.repartition(spark.sparkContext.defaultParallelism, "word").mapInPandas(run, "word string, x double")
    return parts.groupBy("word").agg(F.sum("x").alias("betweenness"))


def build(tokens: DataFrame, unit: str = "lemma", include_function_words: bool = False, top_n: int = 60, method: str = "sentence", window: int = 5, min_log_dice: float = 7.0, min_cooccur: int = 2) -> tuple[DataFrame, DataFrame]:
    """(nodes with centralities, edges)."""
    nodes = top_nodes(tokens, unit, include_function_words, top_n)
    links = edges(tokens, nodes, unit, method, window, min_log_dice, min_cooccur)
    full = degrees(nodes, links).join(betweenness(links), "word", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    return full.select("word", "label", "freq", "degree", "degree_centrality", "betweenness").orderBy(F.desc("degree_centrality"), "word"), links


def to_json(nodes: DataFrame, links: DataFrame) -> str:
    """For drawing: a node's size grows with its frequency.  At most top_n nodes are collected."""
    ns, ls = nodes.collect(), links.collect()
    most = max([r["freq"] for r in ns], default=1)
    return json.dumps({"nodes": [{"id": r["word"], "label": r["label"], "size": 10 + 30 * r["freq"] / most} for r in ns], "edges": [{"from": r["a"], "to": r["b"], "value": r["log_dice"], "cooccur": r["cooccur"]} for r in ls]}, ensure_ascii=False)


_PAGE = """<!doctype html><meta charset="utf-8"><title>%s</title><svg id="s" viewBox="-520 -520 1040 1040" style="width:100%%;height:95vh"></svg><script>
const g = %s, at = new Map(g.nodes.map((n, i) => [n.id, [400 * Math.cos(2 * Math.PI * i / g.nodes.length), 400 * Math.sin(2 * Math.PI * i / g.nodes.length)]]));
const s = document.getElementById("s"), put = (kind, a, text) => { const e = document.createElementNS("http://www.w3.org/2000/svg", kind); for (const k in a) e.setAttribute(k, a[k]); if (text) e.textContent = text; s.append(e); };
for (const e of g.edges) { const [a, b] = [at.get(e.from), at.get(e.to)]; put("line", {x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999", "stroke-width": e.value / 6}); }
for (const n of g.nodes) { const p = at.get(n.id); put("circle", {cx: p[0], cy: p[1], r: n.size / 3, fill: "#48c"}); put("text", {x: p[0] * 1.08, y: p[1] * 1.08, "font-size": 14, "text-anchor": "middle"}, n.label); }
</script>"""


def to_html(nodes: DataFrame, links: DataFrame, title: str = "Network") -> str:
    """One page that draws the network in a circle, without other files."""
    return _PAGE % (html.escape(title), to_json(nodes, links).replace("</", "<\\/"))
