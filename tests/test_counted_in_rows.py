"""What is counted in a document's row is what its token table gives."""

import pytest
from helpers import same
from pyspark.sql import functions as F

from wordloom import corpus
from wordloom.config import Settings
from wordloom.operators import annotate, basic, collocation, frequency
from wordloom.plans import catalog

TEXTS = [(1, "en", "The cat. the CAT, a dog! 12 Σίσυφος ΣΑΣ"), (2, "de", "Der Hund. der hund, Das Das 7"), (2, "fr", "le chat le chien. Der der"), (None, "en", "lost lost words the"), (3, "en", ""), (4, "en", None), (5, None, "The the cat … dog cat cat"), (6, "en", "x " * 400)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, lang string, text string")


@pytest.fixture(scope="module")
def by():
    return annotate.NativeAnnotator(language_col="lang")


def r9(df):
    return df.select(*(F.round(c, 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes)).toPandas()


@pytest.mark.parametrize("unit,function_words", [("lemma", False), ("surface", True)])
def test_frequency_table(docs, by, unit, function_words):
    """Repeated ids are one document; words without a document count in rates only."""
    got = frequency.table_of_rows(by.word_rows(docs, unit), by, function_words)
    same(r9(got), r9(frequency.frequency_table(by.annotate(docs), unit, function_words)))
    tokens = by.annotate(docs).where("doc_id IS NOT NULL").toPandas()
    sizes = tokens.groupby("doc_id").size()
    chosen = tokens if function_words else tokens[~tokens.is_function]
    for r in got.collect():  # dispersion, written out over all parts
        f = chosen[chosen[unit] == r["word"]].groupby("doc_id").size()
        assert r["dp"] == pytest.approx(sum(abs(f.get(d, 0) / f.sum() - n / sizes.sum()) for d, n in sizes.items()) / 2), r


def test_dispersion_of_large_parts(docs, by, monkeypatch):
    """Words that only large parts can lack meet those by a shuffle."""
    want = r9(frequency.table_of_rows(by.word_rows(docs), by))
    monkeypatch.setattr(frequency, "MOST_SENT", 3)
    same(r9(frequency.table_of_rows(by.word_rows(docs), by)), want)
    same(r9(frequency.frequency_table(by.annotate(docs))), want)


def test_types(docs, by):
    tokens, types = by.annotate(docs), by.types(docs)
    names = ["surface", "lemma", "pos", "is_function"]
    same(types.groupBy(*names).agg(F.sum("n").alias("n")).toPandas(), tokens.groupBy(*names).agg(F.count("*").alias("n")).toPandas())


@pytest.mark.parametrize("window", [2, 3, 7])
def test_statistics(docs, by, window):
    """By document, with repeated ids; by group, whose chunks cross documents and lie within one."""
    tokens, content = by.annotate(docs, carry=("lang",)), by.word_rows(docs, carry=("lang",), function_words=False)
    words = content.select("lang", "doc_id", F.posexplode("words").alias("k", "lemma"))
    same(r9(basic.document_stats_in_rows(content, window)), r9(basic.per_document_stats(words, sttr_window=window)))
    same(r9(basic.group_stats_in_rows(content, "lang", window)), r9(basic.per_group_stats(words, None, "lang", sttr_window=window)))
    once = F.col("doc_id") != 2
    same(r9(basic.document_stats_in_rows(content.where(once), window)), r9(basic.per_document_stats(tokens.where(once), sttr_window=window)))
    same(r9(basic.group_stats_in_rows(content.where(once), "lang", window)), r9(basic.per_group_stats(tokens.where(once), None, "lang", sttr_window=window)))


def test_counted_by_document(docs, by):
    """The counted table gives what tokens give; so do words of two parts of speech."""
    same(r9(frequency.frequency_table(by.counted(docs))), r9(frequency.frequency_table(by.annotate(docs))))
    two = lambda t: t.withColumn("pos", F.when(F.col("surface") == "The", "X").otherwise(F.col("pos"))).withColumn("is_function", F.lit(False))
    want = r9(frequency.frequency_table(by.annotate(docs), include_function_words=True).drop("pos"))
    same(r9(frequency.frequency_table(two(by.counted(docs)), include_function_words=True).drop("pos")), want)
    same(r9(frequency.frequency_table(two(by.annotate(docs)), include_function_words=True).drop("pos")), want)


def test_sentences_with_a_word(spark, by):
    """Neighbours in sentences that can have the word are those in whole texts, with marks in a row and without a last mark."""
    texts = ["The dog sat. A Cat, a dog! No. Concatenate it?! cat... cat cat. Dog", "cat dog\r\nbird", None, "", "dog. bird", "A. cat", "cat.dog.cat"]
    docs = spark.createDataFrame([(i, "de" if i == 5 else "en", t) for i, t in enumerate(texts)], "doc_id long, lang string, text string")
    for word in ("cat", "dog", "…"):
        want = collocation.collocation_table(by.annotate(docs), word)
        same(r9(collocation.collocation_table(by.types(docs), word, rows=by.sentences_with(docs, word))), r9(want))
        fixed = collocation.collocation_table(by.annotate(docs), word, method="fixed", window=2)
        same(r9(collocation.collocation_table(by.types(docs), word, method="fixed", window=2, rows=by.in_rows(by.possible(docs, word)))), r9(fixed))


@pytest.mark.parametrize("repeated", [False, True])
def test_dependencies_of_separated_verbs(spark, repeated):
    """Collocations of prefixes and verbs, from tokens counted by type and the joined ones alone, are those of the token table."""
    texts = ["Ich rufe dich heute an. Wir anrufe anRufen zurückkommen mitgehen", "RUFE rufe ihn AN, an! komme zuruecK komme ZURÜCK; kommen zurück\n", "gehen mit ; mit. gehen\tder\nMIT", "", None, "rufe an kommen ZURÜCK", "rufe zıirück, gehen mit́, x an", "kommen 12 zurück – kommen an"]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)] + ([(0, "rufe ihn doch an. gehen mit")] if repeated else []), "doc_id long, text string")
    settings = Settings(language="de", language_options={"separable_verbs": True})
    tokens = corpus.build(docs, settings).tokens
    counted, linked = corpus.separated(docs, settings)
    assert ("n" in counted.columns) != repeated
    assert tokens.where("dep = 'svp'").count() == linked.where("dep = 'svp'").count() > 4
    for word in ("an", "anrufe", "ZURÜCK", "none"):
        got = collocation.collocation_table(counted, word, method="dependency", rows=linked)
        same(r9(got), r9(collocation.collocation_table(tokens, word, method="dependency")))
    keys = ["surface", "lemma", "pos", "is_function"]
    n = F.sum("n") if "n" in counted.columns else F.count("*")
    same(counted.groupBy(*keys).agg(n.alias("n")).toPandas(), tokens.groupBy(*keys).agg(F.count("*").alias("n")).toPandas())


def test_words_alone(docs, by):
    """The words, ranks and shared labels of the table, without its parts."""
    table, words = frequency.table_of_rows(by.word_rows(docs), by), frequency.words_alone(by.types(docs.where("doc_id IS NOT NULL")))
    same(words.toPandas(), table.select("word", "label", "freq").toPandas())
    assert frequency.zipf(words).collect() == frequency.zipf(table).collect()
    low = [frequency.duplicate_labels(t.withColumn("label", F.lower("word"))).first()["n_rows"] for t in (words, table)]
    assert low[0] == low[1] > 0


def test_chosen_words(docs, by):
    """Only the chosen words meet the parts, with the ranks and dispersion that they have among all."""
    rows = by.word_rows(docs)
    for args in ((2, "WORD", "t"), (3, None, ""), (1, "NUM", "")):
        same(r9(frequency.table_of_rows(rows, by, chosen=frequency.shown(*args))), r9(frequency.filtered(frequency.table_of_rows(rows, by), *args)))


def test_vocabulary_meets_dispersion_where_it_is(spark, docs, by, monkeypatch):
    """Words are stored and shuffled without a label that is the word again, and are not shuffled to meet the few that a part lacks."""
    columns, keep = {}, frequency.stored
    monkeypatch.setattr(frequency, "stored", lambda df, label, *a: columns.setdefault(label, df.columns) and keep(df, label, *a))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frequency.table_of_rows(by.word_rows(docs), by)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "label" not in columns["words"]
    assert [x for x in plan.splitlines() if "LeftOuter" in x and "Broadcast" in x] and not [x for x in plan.splitlines() if "LeftOuter" in x and "Broadcast" not in x]


def test_dispersion_without_ranks(spark, docs, by, sf):
    """What rules read of the table, without ranks: dispersion of judged words alone; the queries of flags sort no vocabulary."""
    rows = by.word_rows(docs)
    table = frequency.table_of_rows(rows, by).select("word", "pos", "freq", "dp", "n_parts")
    same(r9(frequency.dispersion_of_rows(rows, by)), r9(table))
    judged = F.col("freq") >= 3
    same(r9(frequency.dispersion_of_rows(rows, by, judged=judged)), r9(table.withColumn("dp", F.when(judged, F.col("dp")))))
    for query in (catalog.flag_frequency, catalog.flag_labels):
        plan = query(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Sort " not in plan
