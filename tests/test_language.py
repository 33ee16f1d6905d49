"""Parsers, German word formation, options and warnings, and numbers that have no SQL function."""

import math

import pytest
from helpers import make_tokens, rows

from wordloom import schema
from wordloom.functions import measures
from wordloom.operators import advice, annotate, explain, frequency, german, kwic, parsing
from wordloom.sources import files


def test_chunks_are_the_text():
    text = "a b c\n\nd e\nffff gggg\n\n" + "h" * 30
    for most in range(1, 60):
        chunks = parsing.split_chunks(text, most)
        assert "".join(chunks) == text and all(0 < len(c) <= most for c in chunks)
    assert parsing.split_chunks("one\n\ntwo three", 10) == ["one\n\n", "two three"]
    assert parsing.split_chunks("one two\nthree", 10) == ["one two\n", "three"] and parsing.split_chunks("one two", 5) == ["one ", "two"]
    assert parsing.split_chunks("", 5) == [""] and parsing.split_chunks("abcdef", 4) == ["abcd", "ef"]


def test_parser_annotator(spark):
    def simple(options):
        def parse(chunk):
            out, n = [], 0
            for s in chunk.split("."):
                words = [parsing.Word(w, w.lower(), "X" if w.strip() else "SPACE", head=n + i + 1 if i == 0 else n + i) for i, w in enumerate(s.replace(" ", "| |").split("|")) if w]
                out.append(words)
                n += len(words)
            return out

        return parse

    docs = spark.createDataFrame([(0, "A b. .c d"), (1, "x" * 7), (2, None)], "doc_id long, text string")
    t = parsing.ParserAnnotator("xx", simple, chunk_chars=100).annotate(docs)
    assert [f.name for f in t.schema] == [f.name for f in schema.TOKENS]
    assert [tuple(r) for r in t.where("doc_id = 0").orderBy("position").select("sentence_id", "position", "surface", "lemma", "head").collect()] == [(0, 0, "A", "a", -1), (0, 1, "b", "b", -1), (2, 2, "c", "c", -1), (2, 3, "d", "d", -1)]
    assert parsing.ParserAnnotator("xx", simple, chunk_chars=3).annotate(docs).where("doc_id = 1").count() == 3


def test_german_nouns_and_lemmas(spark):
    t = schema.conform(spark.createDataFrame([(0, 0, "Essen", "essen", "NOUN"), (0, 1, "essen", "essen", "VERB"), (0, 2, ",", ",", "PUNCT")], "doc_id long, position long, surface string, lemma string, pos string"))
    assert rows(german.recapitalise_nouns(t).orderBy("position"), "lemma") == ["Essen", "essen", ","]
    other = spark.createDataFrame([("essen", "ESS"), ("Essen", "mahl"), (",", "komma")], "surface string, lemma string")
    assert rows(german.lemmatise(t, other, "both").orderBy("position"), "lemma", "lemma_alt") == [("essen", "mahl"), ("essen", "ESS"), (",", "")]
    assert rows(german.lemmatise(t, other, "other").orderBy("position"), "lemma") == ["Mahl", "ESS", ","]
    assert german.lemmatise(t, other) is t
    with pytest.raises(ValueError):
        german.lemmatise(t, other, "x")


def test_compounds_from_the_corpus(spark):
    words = ["Autobahn", "Raststätte", "Autobahnraststätte", "Arbeit", "Amt", "Arbeitsamt", "Haus", "tür", "Haustür", "Katze"]
    t = schema.conform(spark.createDataFrame([(0, i, w, "NOUN") for i, w in enumerate(words)], "doc_id long, position long, surface string, pos string"))
    got = {r["surface"]: r["compound_parts"] for r in german.split_compounds(t).collect()}
    assert {w: p for w, p in got.items() if p} == {"Autobahnraststätte": "Autobahn+Raststätte", "Arbeitsamt": "Arbeit+Amt", "Haustür": "Haus+Tür"}
    assert "Amt" in rows(frequency.expand_compounds(german.split_compounds(t)), "surface")


def test_options_and_warnings(spark):
    assert [o.key for o in annotate.annotator("de").option_schema()][:2] == ["lemma_mode", "separable_verbs"]
    assert {o.kind for o in advice.option_schema("ja")} == {"choice", "bool"} and advice.option_schema("xx") == []
    assert len(advice.language_warnings("de")) == 2 and len(advice.language_warnings("de", {"lowercase": True, "separable_verbs": False, "compound_split": True, "lemma_mode": "both"})) == 5
    assert len(advice.language_warnings("en", {"lowercase": False})) == 1 and len(advice.language_warnings("ja")) == 3
    docs = spark.createDataFrame([("daß muß rauh",), ("dass muss rau",), (None,)], "text string")
    found = annotate.annotator("de").data_warnings(docs)
    assert [w["suggest_option"] for w in found] == ["norm_1996"] and "3" in found[0]["message"]
    assert advice.data_warnings(docs, "de", {"norm_1996": True}) == [] == advice.data_warnings(docs, "en") == advice.data_warnings(docs.limit(1), "de")


def test_p_values(spark):
    xs = [0.0, 1e-9, 0.1, 1.0, 3.84, 6.63, 10.83, 50.0, 400.0, 1400.0, 1e5]
    df = spark.createDataFrame([(x,) for x in [*xs, None, float("nan"), -1.0]], "g2 double")
    got = rows(df.select(measures.p_value("g2").alias("p")), "p")
    assert got[: len(xs)] == pytest.approx([math.erfc(math.sqrt(x / 2)) for x in xs], rel=1e-9, abs=1e-300)
    assert got[len(xs) : -1] == [None, None] and got[-1] == pytest.approx(1)


def test_contexts_in_rows_are_those_of_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = annotate.NativeAnnotator(language_col="lang")
    t, r = a.annotate(docs), a.in_rows(docs)
    for options in ({}, {"window": 1, "collocate": "the"}, {"window": 3, "collocate": "the", "scope": "fixed"}, {"regex": True, "window": 0}):
        assert sorted(kwic.kwic(t, "the", **options).collect()) == sorted(kwic.kwic_in_rows(r, "the", **options).collect())
    assert sorted(kwic.kwic(kwic.content_context(t, "the"), "the").collect()) == sorted(kwic.kwic_in_rows(r, "the", content=True).collect())
    assert kwic.drilldown({"word": "a"}) == {"query": "a"} and kwic.drilldown({"node": "a", "collocate": "b", "method": "fixed", "window": 3})["scope"] == "fixed"


def test_statements_are_complete():
    from wordloom.operators import rules

    said = {s.flag for s in explain.STATEMENTS if s.section == explain.NEXT}
    assert said >= set(rules.TEXTS) - explain.TABLE_ONLY - {"CORPUS_TOO_SMALL"}
    row = explain.Row("keyness", {"log_ratio": 0.0}, [rules.make_flag("CORPUS_TOO_SMALL", total_tokens=5, threshold=10)], {"WORD": "a", "GROUP_A": "x", "GROUP_B": "y"})
    sections = dict(explain.explain_sections(row))
    assert sections[explain.FACT] == ["'a' is as frequent in 'x' as in 'y'."] and "5 tokens" in sections[explain.DONT][0]
    assert "{n_total}" in dict(explain.explain_sections(explain.Row("frequency", {"freq": 1})))[explain.PAPER][0]


def test_pdf_texts_are_cleaned(spark, tmp_path, monkeypatch):
    assert files.decode_bytes(b"\x81 ")[1].endswith(("(forced)", "(detected)"))
    docs = spark.createDataFrame([("p", "Sprach-\nwissen\n\n12\n", "PDF (1 pages)"), ("t", "a-\nb\n12", "utf-8")], "name string, text string, encoding string")
    from pyspark.sql import functions as F

    from wordloom.functions import text as tx

    got = docs.select(F.when(F.startswith("encoding", F.lit("PDF")), tx.clean_pdf_text(F.col("text"))).otherwise(F.col("text")).alias("t"))
    assert rows(got, "t") == ["Sprachwissen", "a-\nb\n12"]
    cases = spark.createDataFrame([("　私は\n　人だ",), ("a-\n  b",), ("– 12 –\nx\n1 2\n12345\n７\n--3",)], "t string")
    assert rows(cases.select(tx.clean_pdf_text(F.col("t")).alias("t")), "t") == ["私は　人だ", "a- b", "x 1 2 12345 --3"]


def test_stored_corpus_and_exports(spark):
    from wordloom import corpus
    from wordloom.operators import network
    from wordloom.sources import sinks

    c = corpus.build(spark.createDataFrame([(0, "cat dog. cat dog.")], "doc_id long, text string"))
    s = c.stored()
    assert sorted(s.tokens.collect()) == sorted(c.tokens.collect()) and s.tokens.inputFiles()
    nodes, links = network.build(make_tokens(spark, [["cat", "dog"], ["cat", "dog"]]), min_log_dice=0.0)
    page = network.to_html(nodes, links, "a < b")
    assert "a &lt; b" in page and '"cat"' in page
    assert sinks.csv_bytes(nodes).count(b"\n") == 3
    with pytest.raises(ValueError):
        sinks.csv_bytes(nodes, most=1)
