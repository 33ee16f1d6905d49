import math

import pytest
from helpers import make_tokens, rows
from pyspark.sql import functions as F

from wordloom import schema
from wordloom.functions import measures
from wordloom.operators import basic, collocation, frequency, keyness, kwic, network


def test_ratios(spark):
    def sttr(words, window):
        return basic.standardized_ttr(make_tokens(spark, [words]), window=window).first()["sttr"]

    assert sttr(list("aabcd"), 2) == 0.75
    assert sttr(list("ab"), 3) is None
    assert basic.basic_stats(make_tokens(spark, [list("aab")])).first()["ttr"] == pytest.approx(2 / 3)


def test_basic_stats(spark):
    t = make_tokens(spark, [["I", "TOP", "book", "OBJ", "read"], ["book", "OBJ", "read"]], {"TOP", "OBJ"})
    r = basic.basic_stats(t).first()
    assert (r["n_tokens_all"], r["n_tokens"], r["n_types"], r["ttr"], r["sttr"], r["n_documents"]) == (8, 5, 3, 0.6, None, 2)
    assert basic.basic_stats(t, include_function_words=True).first()["n_types"] == 5
    assert rows(basic.pos_composition(t), "pos", "count") == [("WORD", 5), ("FUNC", 3)]
    r = basic.corpus_summary(t, t.select("doc_id").distinct(), "en").first()
    assert (r["n_documents"], r["n_tokens"], r["n_types"], r["n_tokens_content"], r["n_types_content"]) == (2, 8, 5, 5, 3)


def test_chunks_cross_documents(spark):
    # a b | b c | (d): document borders do not cut a corpus's running text, but do cut a document's
    t = make_tokens(spark, [list("abb"), list("cd")])
    assert basic.standardized_ttr(t, window=2).first()["sttr"] == 1.0
    assert rows(basic.per_document_stats(t, sttr_window=3), "doc_id", "sttr") == [(0, pytest.approx(2 / 3)), (1, None)]


def test_groups(spark):
    t = make_tokens(spark, [list("ab"), list("abc"), ["a"], list("ab")])
    docs = spark.createDataFrame([(0, "2000", "x"), (1, "2000", "x"), (2, "2000", None), (3, "2020", "y")], "doc_id long, year string, z string")
    assert rows(basic.group_sizes(t, docs, "year"), "group", "n_documents", "n_tokens") == [("2000", 3, 6), ("2020", 1, 2)]
    assert {r["group"]: r["sttr"] for r in basic.per_group_stats(t, docs, "year", sttr_window=2).collect()} == {"2000": 1.0, "2020": 1.0}
    assert [r["group"] for r in basic.per_group_stats(t, docs, "z").collect()] == [None, "x", "y"]
    assert rows(basic.group_sizes(t, docs, "z"), "group") == ["x", "y"]
    assert schema.group_columns(docs.withColumn("encoding", F.lit("utf-8"))) == ["year", "z"]


def test_dispersion(spark):
    docs = [["x"] * 2 + ["y"] + ["z"] * 7, ["y"] * 2 + ["z"] * 18, ["x"] * 4 + ["y"] * 3 + ["z"] * 23]
    f = {r["word"]: r for r in frequency.frequency_table(make_tokens(spark, docs)).collect()}
    assert (f["x"]["freq"], f["x"]["n_parts"], f["x"]["dp"], f["x"]["pmw"]) == (6, 2, pytest.approx(1 / 3), pytest.approx(1e5))
    assert f["y"]["dp"] == pytest.approx(0) and f["y"]["n_parts"] == 3 and f["z"]["rank"] == 1
    one = frequency.frequency_table(make_tokens(spark, [["w"] * 5 + ["o"] * 5, ["o"] * 20, ["o"] * 30]))
    assert {r["word"]: r["dp"] for r in one.collect()}["w"] == pytest.approx(5 / 6)


def test_denominator_and_homographs(spark):
    f = frequency.frequency_table(make_tokens(spark, [["a", "F", "a", "F"]], {"F"})).collect()
    assert [(r["word"], r["pmw"]) for r in f] == [("a", 500000)]
    t = spark.createDataFrame([(0, i, "L", k, lab) for i, (k, lab) in enumerate([("L-1", "L"), ("L-1", "L"), ("L-2", "L"), ("b", "b")])], "doc_id long, position long, surface string, lemma string, lemma_label string")
    t = schema.conform(t)
    f = frequency.frequency_table(t)
    assert [(r["word"], r["label"], r["freq"]) for r in f.collect()][:1] == [("L-1", "L", 2)]
    assert frequency.duplicate_labels(f).first()["n_rows"] == 2
    assert frequency.frequency_table(t, "surface").first()["freq"] == 4


def test_distribution_rank_cutoff(spark):
    t = make_tokens(spark, [["x"] * 2 + ["o"] * 8, ["o"] * 20, ["x"] * 4 + ["o"] * 26])
    d = {r["part"]: r for r in frequency.word_distribution(t, "x").collect()}
    assert [d[k]["freq"] for k in (0, 1, 2)] == [2, 0, 4] and d[2]["share"] == pytest.approx(4 / 6) and d[0]["pmw_in_part"] == 200000
    assert all(r["share"] == 0 for r in frequency.word_distribution(t, "none").collect())
    many = make_tokens(spark, [[f"w{i:03d}" for i in range(150) for _ in range(1 + i % 3)]])
    f = frequency.frequency_table(many).orderBy("rank").collect()
    assert [r["rank"] for r in f] == list(range(1, 151))
    assert [(-r["freq"], r["word"]) for r in f] == sorted((-r["freq"], r["word"]) for r in f)
    assert frequency.high_frequency_cutoff(many).first()["cutoff"] == 3
    assert frequency.high_frequency_cutoff(many.limit(0)).first()["cutoff"] == 2**31


def test_empty_tokens(spark):
    t = make_tokens(spark, [["a"]]).limit(0)
    assert frequency.frequency_table(t).count() == 0
    assert kwic.kwic(t, "a").count() == 0
    assert collocation.collocation_table(t, "a").count() == 0
    assert basic.basic_stats(t).first()["ttr"] is None


def test_kwic(spark):
    t = make_tokens(spark, [list("abcde"), list("cfg")])
    assert rows(kwic.sort_kwic(kwic.kwic(t, "c", window=2), "none"), "L2", "L1", "KWIC", "R1", "R2", "left") == [("a", "b", "c", "d", "e", "a b"), ("", "", "c", "f", "g", "")]
    assert rows(kwic.kwic(t, "e", window=1), "L1", "R1") == [("d", "")]
    assert sorted(rows(kwic.kwic(t, "[cf]", regex=True), "KWIC")) == ["c", "c", "f"]
    assert kwic.kwic(t, "nope").columns[:4] == ["doc_id", "position", "sentence_id", "key"]
    assert kwic.kwic(t, "c", window=0).count() == 2
    e = make_tokens(spark, [["Essen", "essen", "größe"]])
    assert kwic.find_hits(e, "essen").count() == 1 and kwic.find_hits(e, "ESSEN", case_sensitive=False).count() == 2
    assert kwic.find_hits(e, r"\w+", regex=True).count() == 3
    assert kwic.find_hits(e, r"(?P<x>ESS)EN", regex=True, case_sensitive=False).count() == 2


def test_kwic_collocate(spark):
    t = make_tokens(spark, [["s", "w", "say", "s", "n", "home"], ["s", "o", "home"]], sentence=lambda d, p: p // 3)
    assert sorted(rows(kwic.kwic(t, "s", collocate="home"), "position")) == [0, 3]
    assert kwic.kwic(t, "s", window=1, collocate="home", scope="fixed").count() == 0
    assert kwic.kwic(t, "s", window=2, collocate="home", scope="fixed").count() == 2
    # a hit is not its own collocate
    assert kwic.kwic(make_tokens(spark, [["s", "x"]]), "s", collocate="s").count() == 0


def test_measures(spark):
    one = spark.createDataFrame([(3, 10, 5, 100, 2)], "o long, fn long, fc long, n long, w long")
    r = one.select(*(c.alias(k) for k, c in measures.association(*map(F.col, ["o", "fn", "fc", "n", "w"])).items())).withColumn("p", measures.p_value("g2")).first()
    cells = [(3, 20 * 5 / 100), (2, 5 - 20 * 5 / 100), (17, 20 * 95 / 100), (78, 80 * 95 / 100)]
    assert r["expected"] == 1 and r["mi"] == pytest.approx(math.log2(3)) and r["t"] == pytest.approx(2 / math.sqrt(3))
    assert r["log_dice"] == pytest.approx(14 + math.log2(6 / 15))
    assert r["g2"] == pytest.approx(2 * sum(o * math.log(o / e) for o, e in cells))
    assert r["p"] == pytest.approx(math.erfc(math.sqrt(r["g2"] / 2)))


def test_collocations(spark):
    docs = [["I", "TOP", "book", "OBJ", "read", "book", "OBJ", "buy"], ["read"]]
    t = make_tokens(spark, docs, {"TOP", "OBJ"}, sentence=lambda d, p: int(d == 0 and p >= 5))
    f = {r["collocate"]: r for r in collocation.collocation_table(t, "book").collect()}
    assert f["OBJ"]["cooccur"] == 2 and f["OBJ"]["freq_collocate"] == 2 and "book" not in f
    assert f["OBJ"]["mi"] == pytest.approx(math.log2(2 / (2 * 2 * 3 / 9)))
    fixed = {r["collocate"]: r["cooccur"] for r in collocation.collocation_table(t, "book", method="fixed", window=1).collect()}
    assert fixed == {"TOP": 1, "OBJ": 2, "read": 1}
    assert collocation.collocation_table(t, "nothing").count() == 0
    with pytest.raises(ValueError):
        collocation.collocation_table(t, "book", method="other")


def test_network(spark):
    sents = [["cat", "fish", "eat"], ["cat", "fish"], ["dog", "run"], ["cat", "run"]]
    rws = [(0, s, s * 10 + i, w) for s, ws in enumerate(sents) for i, w in enumerate(ws)]
    t = schema.conform(spark.createDataFrame(rws, "doc_id long, sentence_id long, position long, surface string"))
    nodes = network.top_nodes(t)
    pairs, freq = network.pair_counts(t, nodes)
    assert {(r["a"], r["b"]): r["cooccur"] for r in pairs.collect()}[("cat", "fish")] == 2
    assert {r["word"]: r["unit_freq"] for r in freq.collect()}["cat"] == 3
    full, links = network.build(t, min_log_dice=0, min_cooccur=1)
    assert full.first()["word"] == "cat"
    assert network.edges(t, nodes, min_log_dice=13, min_cooccur=1).count() < links.count()
    assert network.build(t, min_log_dice=99)[0].count() == 0
    assert '"nodes"' in network.to_json(full, links)
    with pytest.raises(ValueError):
        network.pair_counts(t, nodes, method="other")


def test_betweenness():
    # a path: the middle lies on every path between others
    b = network.shares_of_paths([("a", "b"), ("b", "c")])
    assert b == {"a": 0.0, "b": 1.0, "c": 0.0}
    assert network.shares_of_paths([("a", "b")]) == {"a": 0.0, "b": 0.0}
    square = network.shares_of_paths([("a", "b"), ("b", "c"), ("c", "d"), ("a", "d")])
    assert all(v == pytest.approx(1 / 6) for v in square.values())


def test_keyness(spark):
    docs = [["x"] * 10 + ["y"] * 10 + ["z"] * 80, ["x"] * 2 + ["y"] * 10 + ["w"] * 88]
    t = make_tokens(spark, docs)
    groups = spark.createDataFrame([(0, "A1"), (1, "B1")], "doc_id long, g string")
    k = {r["word"]: r for r in keyness.keyness_table(keyness.sides(t, groups, "g", "A1", "B1"), with_p=True).collect()}
    assert k["x"]["log_ratio"] == pytest.approx(math.log2(5)) and k["x"]["direction"] == "A" and k["x"]["pmw_a"] == 1e5
    assert k["y"]["log_ratio"] == 0 and k["y"]["direction"] == "=" and k["y"]["g2"] == 0
    assert k["w"]["direction"] == "B" and k["w"]["zero_corrected"] and k["w"]["odds_ratio"] is None
    swapped = {r["word"]: r for r in keyness.keyness_table(keyness.sides(t, groups, "g", "B1", "A1")).collect()}
    assert all(swapped[w]["log_ratio"] == pytest.approx(-r["log_ratio"]) and swapped[w]["g2"] == pytest.approx(r["g2"]) for w, r in k.items())
    assert keyness.keyness_table(keyness.sides(t, groups, "g", "A1", "none")).count() == 0
    assert keyness.sides(t, groups, "g", "A1").where("side = 'B'").count() == 100
