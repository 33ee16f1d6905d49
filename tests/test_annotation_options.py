"""Options as passes over word types, the learned lemmatiser, scored compounds, lattices and the positional index."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordloom import corpus
from wordloom.config import Settings
from wordloom.operators import annotate, collocation, explain, frequency, german, index, kwic, lattice, lemmas, passes

GERMAN = [
    "Ich rufe dich morgen an. Er muss anrufen, sie anrufe es.",
    "Die Haustür war offen; die Tür, das Haus, der Hausbau und der Bau. Haustüren? Türen! Häuser.",
    "Das Essen und essen. Wir spielen, er spielt, ich spiele, sie spielten; spielen wir. lachen lacht lache lachen lachen.",
    None,
    "",
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(GERMAN)), "doc_id long, text string")


def german_tokens(texts, **options):
    return corpus.build(texts, Settings(language="de", language_options={"separable_verbs": False} | options)).tokens


def test_plans():
    assert passes.planned("de", {"lemma_mode": "own"}) == [] == passes.planned("en", {"compound_split": True})
    assert passes.planned("de", {"lemma_mode": "both", "separable_verbs": True}) == ["lemma_mode", "separable_verbs"]


def test_no_option_changes_nothing(spark, texts):
    plain = annotate.NativeAnnotator("de").annotate(texts)
    assert sorted(german_tokens(texts).collect()) == sorted(plain.collect())
    with pytest.raises(ValueError):
        german_tokens(texts, lemma_mode="x")


def test_lemma_modes(spark, texts):
    pairs = spark.createDataFrame([("spielt", "spielen"), ("lacht", "lachen"), ("spielten", "spielen"), ("lachten", "lachen"), ("geht", "gehen"), ("Sachen", "Sache"), ("war", "sein")], "surface string, lemma string")
    rules = {r["ending"]: (r["cut"], r["put"], r["support"]) for r in lemmas.learn(pairs).collect()}
    # t becomes en; of the longer endings, which agree, none is kept
    assert rules["t"] == (1, "en", 3) and "ht" not in rules and rules["ten"] == (3, "en", 2)
    words = spark.createDataFrame([("macht",), ("machten",), ("war",), ("Haus",)], "surface string")
    assert dict(lemmas.apply(words, lemmas.learn(pairs)).collect()) == {"macht": "machen", "machten": "machen", "war": "war", "Haus": "Haus"}
    t = corpus.build(texts, Settings(language="de", language_options={"lemma_mode": "other", "separable_verbs": False}), lemmas=pairs).tokens
    assert {r["surface"]: r["lemma"] for r in t.collect()}["spielt"] == "spielen"
    both = corpus.build(texts, Settings(language="de", language_options={"lemma_mode": "both", "separable_verbs": False}), lemmas=pairs).tokens
    found = {r["surface"]: (r["lemma"], r["lemma_alt"]) for r in both.collect()}
    assert found["lacht"] == ("lacht", "lachen") and found["."] == (".", "") and found["und"] == ("und", "")
    assert ("lacht", "lacht", "lachen", 1) in rows(annotate.lemma_comparison(both), "surface", "lemma", "lemma_alt", "count")
    low = corpus.build(texts, Settings(language="de", language_options={"lemma_mode": "other", "lowercase": True, "separable_verbs": False}), lemmas=pairs).tokens
    assert {r["lemma"] for r in low.where("lower(surface) = 'essen'").collect()} == {"essen"}


def test_paradigms(spark):
    words = spark.createDataFrame([("spielen", 5), ("spielt", 2), ("spiele", 2), ("spielten", 1), ("und", 9), ("se", 1)], "word string, n long")
    assert dict(lemmas.paradigms(words).collect()) == {"spielen": "spielen", "spielt": "spielen", "spiele": "spielen", "spielten": "spielen", "und": "und", "se": "se"}


def test_separated_verbs(spark, texts):
    t = {(r["doc_id"], r["position"]): r for r in german_tokens(texts, separable_verbs=True).collect()}
    verb, prefix = t[0, 1], t[0, 4]
    assert (verb["surface"], verb["lemma"], verb["lemma_label"]) == ("rufe", "anrufe", "anrufe")
    assert (prefix["surface"], prefix["pos"], prefix["is_function"], prefix["dep"], prefix["head"]) == ("an", "PART", True, "svp", 1)
    assert sum(r["dep"] == "svp" for r in t.values()) == 1
    assert len(t) == german_tokens(texts).count()


def brute_compounds(surfaces, min_score):
    words = {s.lower() for s in surfaces if len(s) >= 3}
    places = defaultdict(list)  # of each gram: at the beginning, at the end
    for w in words:
        for k in german.GRAMS:
            for i in range(len(w) - k + 1):
                places[w[i : i + k]].append((i == 0, i + k == len(w)))

    def share(grams, test):
        return [sum(map(test, places[g])) / len(places[g]) for g in grams]

    found = {}
    for s in surfaces:
        w, ways = s.lower(), []
        for c in range(3, len(w) - 2):
            for link in german.LINKS:
                end = c - len(link)
                if s[0].isupper() and end >= 3 and w[end:c] == link:
                    before = max(share([w[end - k : end] for k in german.GRAMS if k <= end], lambda x: x[1]))
                    behind = max(share([w[c : c + k] for k in german.GRAMS if c + k <= len(w)], lambda x: x[0]))
                    across = min(share([w[c - k // 2 : c - k // 2 + k] for k in german.GRAMS], lambda x: not x[0] and not x[1]))
                    ways.append((-(before + behind - across), len(link), c, w[:end].capitalize() + "+" + w[c:].capitalize()))
        if ways and -min(ways)[0] >= min_score:
            found[s] = min(ways)[3]
    return found


def test_compounds(spark, texts):
    r = random.Random(11)
    parts = ["".join(r.choice("abens") for _ in range(r.randint(3, 5))) for _ in range(25)]
    surfaces = {x.capitalize() if r.random() < 0.8 else x for x in parts} | {(r.choice(parts) + r.choice(german.LINKS) + r.choice(parts)).capitalize() for _ in range(60)}
    types = spark.createDataFrame([(x, "WORD", 1) for x in surfaces] + [("A1b2c3", "WORD", 1), ("Abcabc", "FUNC", 1)], "surface string, pos string, n long")
    for least in (0.5, -9.0):
        want = brute_compounds(surfaces, least)
        assert {x["surface"]: x["parts"] for x in german.scored_compounds(types, least).collect()} == want and want
    t = german_tokens(spark.createDataFrame([(0, " ".join(sorted(surfaces)))], "doc_id long, text string"), compound_split=True)
    assert {x["surface"]: x["compound_parts"] for x in t.where("compound_parts <> ''").collect()} == brute_compounds(surfaces, 0.5)
    assert t.where("compound_parts <> ''").count() * 2 + t.where("compound_parts = ''").count() == frequency.expand_compounds(t).count()
    assert german_tokens(texts, compound_split=True).count() == german_tokens(texts).count()


def test_many_types_meet_tokens_by_a_shuffle(spark, texts, monkeypatch):
    want = sorted(german_tokens(texts, lemma_mode="both", compound_split=True, separable_verbs=True).collect())
    monkeypatch.setattr(passes, "MOST_SENT", 0)
    monkeypatch.setattr(passes, "SHARE", 20)  # marks and the like are sent, most words are not
    assert sorted(german_tokens(texts, lemma_mode="both", compound_split=True, separable_verbs=True).collect()) == want


# --- lattices ---------------------------------------------------------------------------------------------

LEXICON = [("私", "私-代名詞", "私", "名詞", 300), ("は", "は", "は", "助詞", 50), ("東京", "トウキョウ", "東京", "名詞", 300), ("東", "東", "東", "名詞", 500), ("京都", "京都", "京都", "名詞", 300), ("都", "都", "都", "名詞", 400), ("に", "に", "に", "助詞", 50), ("行く", "行く", "行く", "動詞", 300), ("いく", "行く", "いく", "動詞", 400), ("。", "。", "。", "補助記号", 10)]


def brute_paths(model, text):
    ends = {}
    for i in range(len(text)):
        j = i + 1
        while j < len(text) and lattice.script(text[j]) == lattice.script(text[i]):
            j += 1
        ends[i] = model.words_at(text, i, j)

    def paths(i, left):
        if i == len(text):
            yield 0, 0, (), ()
        for end, pos, cost, k in ends.get(i, []):
            key = k if k >= 0 else len(model.entries) + end
            for c, n, ks, ws in paths(end, pos):
                yield c + cost + model.link(left, pos), n + 1, (key, *ks), ((i, end, pos, k), *ws)

    return list(min(paths(0, ""), key=lambda x: x[:3])[3])


def test_cheapest_paths():
    r = random.Random(3)
    for trial in range(60):
        letters = "ab東あ"
        entries = sorted({("".join(r.choice(letters) for _ in range(r.randint(1, 4))), r.choice(["N", "V"])) for _ in range(12)})
        model = lattice.Model([(s, p, s, s, r.choice([100, 200, 300])) for s, p in entries], {(a, b): r.choice([0, 50, 400]) for a, b in itertools.product(["", "N", "V"], ["N", "V"])} if trial % 3 else {})
        text = "".join(r.choice(letters) for _ in range(r.randint(1, 9)))
        assert model.segment(text) == brute_paths(model, text)


def test_japanese_lattice(spark, tmp_path):
    spark.createDataFrame([(0, "私は東京都に行く。私は京都にいく。\n\n　\nカメラ９！"), (1, None), (2, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    lexicon = spark.createDataFrame([x[:1] + x[1:] for x in LEXICON], "surface string, lemma string, orth_base string, pos string, cost int")
    by = lattice.LatticeAnnotator(lexicon)
    t = by.annotate(docs).orderBy("position")
    assert rows(t, "surface") == ["私", "は", "東京", "都", "に", "行く", "。", "私", "は", "京都", "に", "いく", "。", "カメラ", "9", "！".translate({0xFF01: "!"})]
    assert rows(t, "sentence_id") == [0] * 7 + [1] * 6 + [2] * 3
    assert rows(t, "lemma")[11] == "行く" and rows(t, "lemma_label")[0] == "私" and rows(t, "lemma")[0] == "私-代名詞"
    assert rows(by.annotate(docs, {"lemma_unit": "orth_base"}).orderBy("position"), "lemma")[11] == "いく"
    assert rows(t, "is_function")[:4] == [False, True, False, False]
    words, links = lattice.learn(t)
    assert {(r["before"], r["after"]): r["cost"] for r in links.collect()}["名詞", "助詞"] < 100
    assert words.count() == t.select("surface", "lemma", "pos").distinct().count()
    more = docs.unionByName(spark.createDataFrame([(k, "東京は東京に。都は都に行く。") for k in range(3, 6)], "doc_id long, text string"))
    plain = lexicon.drop("cost")
    assert rows(lattice.LatticeAnnotator(plain).annotate(docs).orderBy("position"), "surface")[2:4] == ["東", "京都"]
    assert rows(lattice.train(more, plain).annotate(docs).orderBy("position"), "surface")[2:4] == ["東京", "都"]
    empty = lattice.LatticeAnnotator(lexicon.limit(0)).annotate(docs).orderBy("position")
    assert rows(empty, "surface")[:3] == ["私", "は", "東京都"]


# --- concordances -----------------------------------------------------------------------------------------


def test_index_reads_what_it_shows(spark, sf):
    odd = [(None, "a thing", "en", "s"), (7, "", "en", "s"), (7, None, "en", "s"), (7, "thing thing thing", "en", "s"), (7, "thing", "de", None)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    by = annotate.NativeAnnotator(language_col="lang")
    r = by.in_rows(docs, carry=("source",))
    x = index.build(docs, by, keep=("source",))
    for query, options in (("thing", {}), ("th[a-z]*ing", {"regex": True, "window": 2}), ("THE", {"case_sensitive": False, "window": 1}), ("nowhere", {})):
        want = kwic.kwic_in_rows(r, query, keep=("source",), **options).collect()
        assert Counter(x.kwic(query, **options).collect()) == Counter(want)
        assert bool(want) == (query != "nowhere")
    plan = x.hits("thing")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    rare = x.vocabulary().where("n_docs = 1").first()["word"]
    lines = x.kwic(rare)
    assert "PartitionFilters" in lines._jdf.queryExecution().executedPlan().toString() and x.hits(rare).select("block").distinct().count() == 1
    t = by.annotate(docs).where("doc_id is not null and doc_id <> 7").groupBy("lemma").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d"))
    ours = {w["word"]: (w["n"], w["n_docs"]) for w in index.build(docs.where("doc_id is not null and doc_id <> 7"), by).vocabulary().collect()}
    assert ours == {w["lemma"]: (w["n"], w["d"]) for w in t.collect()}
    x.discard()
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        x.postings.count()


def test_long_documents_take_time_in_proportion(spark):
    words = ["the", "thing", "was", "seen", "."]
    long = " ".join(words * 40_000)
    docs = spark.createDataFrame([(0, long)], "doc_id long, text string")
    by = annotate.NativeAnnotator("en")
    begin = time.perf_counter()
    r = by.in_rows(docs)
    assert kwic.kwic_in_rows(r, "thing", collocate="the").count() == 40_000
    table = {x["collocate"]: x for x in collocation.collocation_table(by.annotate(docs), "thing", rows=r).collect()}
    assert table["the"]["cooccur"] == 40_000 and table["seen"]["expected"] == pytest.approx(40_000 * 40_000 * 4 / 200_000)
    assert time.perf_counter() - begin < 60


def test_level_sentences():
    def fact(**metrics):
        return dict(explain.explain_sections(explain.Row("collocation", {"cooccur": 30, **metrics}, [], {"WORD": "a", "COLLOCATE": "b"})))[explain.FACT][0]

    assert "above" in fact(log_dice=8.0, mi=4.0, g2=9.0) and "below" not in fact(log_dice=8.0, mi=4.0, g2=9.0)
    low = fact(log_dice=2.0, mi=1.0)
    assert "below" in low and "G2" not in low and "—" not in low
    assert fact() == "'a' and 'b' meet 30 times."


# --- trends and correspondence ----------------------------------------------------------------------------


def test_trends(spark):
    from wordloom import schema
    from wordloom.operators import trends

    counts = {"up": [1, 2, 4, 5, 9], "flat": [3, 3, 3, 3, 3], "down": [9, 0, 0, 1, 0], "rare": [1, 0, 0, 0, 0]}
    years, sizes = [1990, 1995, 2000, 2005, 2010], [40, 40, 50, 40, 80]
    made = []
    for k, (y, size) in enumerate(zip(years, sizes, strict=True)):
        ws = [w for w, ns in counts.items() for _ in range(ns[k])]
        made += [(k, i, w, y) for i, w in enumerate(ws + ["x"] * (size - len(ws)))]
    made.append((9, 0, "up", None))
    raw = spark.createDataFrame(made, "doc_id long, position long, surface string, year int")
    t = schema.conform(raw).join(raw.select("doc_id", "position", "year"), ["doc_id", "position"])
    got = {r["word"]: r for r in trends.trend_table(t, "year").collect()}
    assert set(got) == {"up", "flat", "down", "x"}
    for w in ("up", "flat", "down"):
        x = [n / s * 1e6 for n, s in zip(counts[w], sizes, strict=True)]
        pairs = [(j - i, x[j] - x[i]) for i in range(5) for j in range(i + 1, 5)]
        s = sum((d > 0) - (d < 0) for _, d in pairs)
        var = (5 * 4 * 15 - sum((m := x.count(v)) * (m - 1) * (2 * m + 5) for v in set(x))) / 18
        slopes = sorted(d / a for a, d in pairs)
        z = (s - (s > 0) + (s < 0)) / var**0.5 if var else 0
        assert (got[w]["freq"], got[w]["s"]) == (sum(counts[w]), s)
        assert got[w]["z"] == pytest.approx(z) and got[w]["slope"] == pytest.approx((slopes[4] + slopes[5]) / 2)
        assert got[w]["p"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
    assert trends.trend_table(t.where("year = 1990"), "year").count() == 0


def test_correspondence(spark):
    from wordloom.operators import correspondence

    r = random.Random(2)
    made = [(g, f"w{min(int(r.expovariate(0.2 + 0.1 * k)), 30)}") for k, g in enumerate("abcd") for _ in range(400)] + [(None, "w1"), ("a", "once")]
    t = spark.createDataFrame([(i, g, w, False) for i, (g, w) in enumerate(made)], "doc_id long, g string, lemma string, is_function boolean").repartition(5)
    got, shares = correspondence.analyse(t, "g", axes=2, min_freq=3)
    counts = Counter((w, g) for g, w in made if g)
    words = sorted(w for w, n in Counter(w for g, w in made if g).items() if n >= 3)
    x = np.array([[counts[w, g] for g in "abcd"] for w in words], dtype=float)
    p = x / x.sum()
    row, col = p.sum(axis=1), p.sum(axis=0)
    u, s, v = np.linalg.svd((p - np.outer(row, col)) / np.sqrt(np.outer(row, col)), full_matrices=False)
    ours = {(x["kind"], x["name"]): (x["axis_1"], x["axis_2"]) for x in got.collect()}
    groups = np.array([ours["group", g] for g in "abcd"])
    lines = np.array([ours["word", w] for w in words])
    want = (v[:2].T * s[:2]) / np.sqrt(col)[:, None]
    signs = np.sign((groups * want).sum(axis=0))
    assert groups == pytest.approx(want * signs) and lines == pytest.approx((u[:, :2] * s[:2]) / np.sqrt(row)[:, None] * signs)
    assert shares == pytest.approx(list(s[:2] ** 2 / (s**2).sum())) and len(ours) == len(words) + 4
    assert all(groups[np.abs(groups[:, a]).argmax(), a] > 0 for a in (0, 1))
    assert correspondence.analyse(t.where("g = 'a'"), "g")[0].count() == 0
