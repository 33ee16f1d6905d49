import pytest
from helpers import rows

from wordloom.config import Settings, Thresholds
from wordloom.operators import explain, glossary, rules


@pytest.mark.parametrize(("total", "fires"), [(9999, True), (10000, False)])
def test_corpus_size(total, fires):
    assert bool(rules.check_corpus_size(total)) == fires


@pytest.mark.parametrize(("sizes", "fires"), [({"a": 3, "b": 1}, False), ({"a": 31, "b": 10}, True), ({"a": 5}, False), ({"a": 5, "b": 0}, False)])
def test_imbalance(spark, sizes, fires):
    assert bool(rules.check_group_imbalance(sizes)) == fires
    df = spark.createDataFrame(list(sizes.items()), "group string, n_documents long")
    assert rules.flag_group_imbalance(df).first()["flagged"] == fires


def test_frequency_flags(spark):
    df = spark.createDataFrame([("a", 0.5, 10), ("b", 0.51, 10), ("c", 0.51, 9), ("d", 0.1, 4), ("e", 0.1, 5), ("f", None, 20)], "word string, dp double, freq long")
    assert rows(rules.flag_frequency(df), "flags") == [[], ["DISPERSION_SKEWED"], [], ["LOW_FREQUENCY"], [], []]
    assert rows(rules.flag_frequency(df, n_parts=9), "flags")[1] == []
    assert rows(rules.flag_frequency(df, n_parts=10), "flags")[1] == ["DISPERSION_SKEWED"]


def test_collocation_flags(spark):
    data = [("a", 5, 5.5, 2.0, 8.0, 20.0, 10, 10), ("b", 500, 2.0, 3.0, 9.0, 50.0, 100, 200), ("c", 30, 3.5, 2.0, 7.0, 5.0, 10, 10), ("d", 3, 1.0, 1.0, 2.0, 1.0, 5, 5), ("e", 20, 3.0, 2.0, 7.0, 6.63, 5, 500), ("f", 30, None, None, None, None, 1, 1)]
    df = spark.createDataFrame(data, "collocate string, cooccur long, mi double, t double, log_dice double, g2 double, freq_node long, freq_collocate long")
    cut = spark.createDataFrame([(100,)], "cutoff long")
    got = rows(rules.flag_collocation(df, cutoff=cut), "flags")
    assert got == [["LOW_COOCCURRENCE"], ["BOTH_HIGH_FREQUENCY", "T_HIGH_MI_LOW"], ["NOT_DISTINGUISHABLE"], ["LOW_COOCCURRENCE_MINOR", "NOT_DISTINGUISHABLE"], [], []]
    assert rows(rules.flag_collocation(df), "flags")[1] == ["T_HIGH_MI_LOW"]


def test_keyness_flags(spark):
    df = spark.createDataFrame([("a", 6.62, 0.99, False), ("b", 6.63, 1.0, True), ("c", 50.0, -3.0, False)], "word string, g2 double, log_ratio double, zero_corrected boolean")
    assert rows(rules.flag_keyness(df), "flags") == [["NOT_DISTINGUISHABLE", "EFFECT_SIZE_TOO_SMALL"], ["ZERO_CORRECTED"], []]
    assert rows(rules.flag_keyness(df.select("word", "g2")), "flags")[0] == ["NOT_DISTINGUISHABLE"]
    assert rows(rules.with_marks(rules.flag_keyness(df)), "marks")[1] == "absent in one"


def test_messages():
    flags = rules.explain_flags({"flags": ["LOW_COOCCURRENCE"], "cooccur": 4, "mi": 6.0})
    assert "4 times" in flags[0].message and "6.0" in flags[0].message and flags[0].level == "warning"
    assert rules.make_flag("LOW_FREQUENCY", word="x").message == rules.TEXTS["LOW_FREQUENCY"][1]
    assert {f.code for f in rules.pre_analysis_flags(10, {"g": {"a": 9, "b": 1}})} == {"CORPUS_TOO_SMALL", "GROUP_IMBALANCE"}
    assert rules.check_dp_reliability(9) and not rules.check_dp_reliability(10)


def test_explanation():
    metrics = {"cooccur": 400, "log_dice": 9.0, "mi": 1.0, "t": 10.0, "g2": 90.0}
    row = explain.Row("collocation", metrics, [], {"WORD": "a", "COLLOCATE": "b"})
    heads = [h for h, _ in explain.explain_sections(row)]
    assert heads == [explain.FACT, explain.PAPER]
    assert "disagree" in explain.explain_sections(row)[0][1][0]
    flagged = explain.Row("collocation", metrics, rules.explain_flags(metrics | {"flags": ["T_HIGH_MI_LOW", "BOTH_HIGH_FREQUENCY", "LOW_COOCCURRENCE_MINOR"], "freq_node": 9, "freq_collocate": 8}), {"WORD": "a", "COLLOCATE": "b"})
    sections = dict(explain.explain_sections(flagged))
    assert len(sections[explain.FACT]) == 2 and "both very frequent" in sections[explain.FACT][0]
    assert len(sections[explain.DONT]) == 2 and explain.NEXT in sections
    freq = explain.Row("frequency", {"freq": 12, "pmw": 3.5, "dp": 0.7, "n_total": 1000}, [rules.make_flag("DP_TOO_FEW_PARTS", n_parts=3, threshold=10)], {"WORD": "a"})
    assert "DP =" not in dict(explain.explain_sections(freq))[explain.PAPER][0]
    key = explain.Row("keyness", {"freq_a": 0, "freq_b": 7, "log_ratio": -4.0}, [rules.make_flag("ZERO_CORRECTED", word="a")], {"WORD": "a", "GROUP_A": "x", "GROUP_B": "y"})
    assert "7 times in 'y' and never in 'x'" in explain.explain(key)


def test_formats():
    assert [explain.fmt(k, v) for k, v in [("p", 0.0001), ("p", 0.04), ("freq", 12345), ("log_ratio", 1.5), ("pmw", 1234.56), ("x", None), ("x", float("nan")), ("mi", 1.234)]] == ["< 0.001", "0.040", "12,345", "+1.50", "1,234.6", "—", "—", "1.23"]
    assert [glossary.fmt_threshold(v) for v in (10000, 3.0, 6.63)] == ["10,000", "3", "6.63"]


def test_glossary():
    entries = glossary.load()
    assert set(glossary.REQUIRED) <= set(entries) and len(entries) == 23
    assert "{" not in "".join(v for e in entries.values() for v in e.values())
    assert "20,000" in glossary.load(Thresholds(corpus_min_tokens=20000))["data_size"]["caution"]
    with pytest.raises(glossary.UnknownVariable):
        glossary.render_template("{nothing}", {})
    assert glossary.tooltip("ttr") and "label" in glossary.full_text("ttr") and glossary.caution_head("pmw") == ""


def test_settings():
    s = Settings(language="de", language_options={"norm_ss": True})
    assert Settings.from_yaml(s.to_yaml()) == s
    assert s.tokenization_key() == Settings(language="de", language_options={"norm_ss": True}, sttr_window=5).tokenization_key()
    assert s.tokenization_key() != Settings(language="de").tokenization_key()
