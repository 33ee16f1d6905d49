import io
import zipfile

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordloom import corpus, schema
from wordloom.config import Settings
from wordloom.functions import text as tx
from wordloom.operators import annotate, frequency
from wordloom.sources import files, sinks, tables


@pytest.fixture
def apply(spark):
    def run(f, *texts):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")
        return [r["x"] for r in df.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]

    return run


def test_orthography(apply):
    s = "Ich weiß, daß er es wußte. Daß!"
    assert apply(tx.normalize_1996, s, "Straße groß", None) == ["Ich weiß, dass er es wusste. Dass!", "Straße groß", None]
    assert apply(tx.normalize_ss, "Straße groß ẞ") == ["Strasse gross SS"]
    assert apply(tx.normalize_umlaut, "Äöü") == ["Aeoeue"]
    c = apply(tx.orthography_counts, "daß muß rauh Tip Photo dass muss rau Tipp Foto")[0]
    assert (c["old"], c["new"]) == (5, 5)
    assert len(tx.reform_pairs()) > 60 and "Fußballspiel" not in tx.reform_pairs()


def test_language(apply):
    assert apply(tx.detect_language, "the cat and the dog", "der Hund und die Katze", "猫が好きです", "", None, "123") == ["en", "de", "ja", "ja", "ja", "ja"]


def test_aozora(apply):
    t = "題\n----------\n凡例\n----------\n吾輩《わがはい》は｜猫《ねこ》である。［＃改行］\n底本：「猫」\n以下"
    assert apply(tx.looks_like_aozora, t, "plain") == [True, False]
    assert apply(tx.clean_aozora, t) == ["題\n\n吾輩は猫である。"]


def test_pdf_text(apply):
    assert apply(tx.clean_pdf_text, "Sprach-\nwissenschaft ist\n- 12 -\nschön\n\nNord-\nOstsee\f日本語の\n文章です") == ["Sprachwissenschaft ist schön\n\nNord- Ostsee\n\n日本語の文章です"]


def test_misc(apply):
    assert apply(tx.unix_newlines, "a\r\nb\rc") == ["a\nb\nc"]
    assert apply(tx.nfkc, "ＡＢ１", None) == ["AB1", None]
    assert apply(tx.strip_gutenberg, "x *** START OF THE PROJECT GUTENBERG EBOOK A ***\nbody\n*** END OF THE PROJECT GUTENBERG EBOOK A *** y") == ["body"]
    assert apply(lambda c: tx.display_label(c, F.lit("ライト")), "ライト-light", "-x", "a") == ["ライト", "-x", "a"]


def test_native_annotation(spark):
    docs = spark.createDataFrame([(0, "The cat... sat. 12 Ä!"), (1, ""), (2, None)], "doc_id long, text string")
    t = annotate.annotator("en").annotate(docs)
    assert [f.name for f in t.schema] == [f.name for f in schema.TOKENS]
    got = t.orderBy("doc_id", "position").select("sentence_id", "position", "surface", "lemma", "pos").collect()
    assert [tuple(r) for r in got] == [(0, 0, "The", "the", "FUNC"), (0, 1, "cat", "cat", "WORD"), (0, 2, ".", ".", "PUNCT"), (1, 3, ".", ".", "PUNCT"), (2, 4, ".", ".", "PUNCT"), (3, 5, "sat", "sat", "WORD"), (3, 6, ".", ".", "PUNCT"), (4, 7, "12", "12", "NUM"), (4, 8, "Ä", "ä", "WORD"), (4, 9, "!", "!", "PUNCT")]
    de = annotate.annotator("de").annotate(spark.createDataFrame([(0, "Essen essen daß")], "doc_id long, text string"), {"norm_1996": True})
    assert rows(de.orderBy("position"), "lemma") == ["Essen", "essen", "dass"]


def test_japanese_and_registry(spark):
    docs = spark.createDataFrame([(0, "猫が好き。\n\n　\n犬も！")], "doc_id long, text string")
    t = annotate.annotator("ja").annotate(docs).orderBy("position").collect()
    assert [(r["sentence_id"], r["surface"]) for r in t] == [(0, "猫"), (0, "が"), (0, "好"), (0, "き"), (0, "。"), (1, "犬"), (1, "も"), (1, "!")]
    with pytest.raises(KeyError):
        annotate.annotator("xx")
    annotate.register("xx", lambda: annotate.NativeAnnotator("xx"))
    assert "xx" in annotate.languages()


def test_stacked_prefixes(spark):
    data = [(0, 0, "gibt", "geben", "ROOT", -1), (0, 1, "mit", "mit", "svp", 0), (0, 2, "Ab", "ab", "svp", 0)]
    t = schema.conform(spark.createDataFrame(data, "doc_id long, position long, surface string, lemma string, dep string, head long"))
    got = {r["position"]: r for r in annotate.join_separable_verbs(t).collect()}
    assert got[0]["lemma"] == "abmitgeben" and got[1]["pos"] == "PART" and got[1]["is_function"]


def test_compounds(spark):
    t = schema.conform(spark.createDataFrame([(0, 0, "Autobahnraststätte", "Autobahn+Raststätte"), (0, 1, "x", "")], "doc_id long, position long, surface string, compound_parts string"))
    assert sorted(rows(frequency.expand_compounds(t), "lemma")) == ["Autobahn", "Raststätte", "x"]
    assert frequency.compounds(t).first()["count"] == 1


def test_corpus(spark):
    docs = spark.createDataFrame([(0, "a", "The cat.", "x"), (1, None, "A dog", "y")], "doc_id long, name string, text string, genre string")
    c = corpus.build(docs, Settings())
    assert c.group_columns() == ["genre"] and c.tokens.count() == 5
    assert sorted(rows(c.named(c.documents.select("doc_id")), "name")) == ["1", "a"]
    assert corpus.detect_corpus_language(docs).first()["language"] == "en"


def test_decoding():
    assert files.decode_bytes("ä".encode()) == ("ä", "utf-8")
    assert files.decode_bytes(b"\xef\xbb\xbfa") == ("a", "utf-8-sig")
    assert files.decode_bytes("日本".encode("cp932")) == ("日本", "cp932")
    assert files.decode_bytes(b"\x81")[1] == "utf-8 (forced)"


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "x.txt").write_text("eins", encoding="utf-8")
    (tmp_path / "sub" / "y.TXT").write_bytes("日本".encode("cp932"))
    (tmp_path / "no.md").write_text("skip")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, d in [("b.txt", b"bb"), ("a.txt", "日".encode("cp932")), ("__MACOSX/._a.txt", b"x"), ("readme.md", b"x")]:
            z.writestr(n, d)
    (tmp_path / "z.zip").write_bytes(buf.getvalue())
    got = files.read_files(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [(r["doc_id"], r["name"], r["text"]) for r in got] == [(0, "y", "日本"), (1, "x", "eins"), (2, "a", "日"), (3, "b", "bb")]


def test_tables(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("id;year;genre;text\n1;2000;a;lang und länger\n2;2000;b;noch ein Text\n3;2010;a;\n4;2010;b;kurz aber lang\n", encoding="utf-8")
    t = files.read_table(spark, str(p))
    assert t.columns == ["id", "year", "genre", "text"]
    assert tables.guess_text_column(t).first()["column"] == "text"
    assert sorted(rows(tables.guess_group_columns(t, "text"), "column")) == ["genre", "year"]
    docs = tables.to_documents(t, "text", ["year"], "id").orderBy("doc_id").collect()
    assert [(r["doc_id"], r["name"], r["year"]) for r in docs] == [(0, "1", "2000"), (1, "2", "2000"), (3, "4", "2010")]
    q = tmp_path / "f.tsv"
    q.write_text('1\t"der\t5\n', encoding="utf-8")
    assert files.read_frequency_list(spark, str(q)).first()["word"] == '"der'
    j = tmp_path / "j.csv"
    j.write_bytes("本文,年\n日本,2000\n".encode("cp932"))
    assert files.read_table(spark, str(j)).first()["本文"] == "日本"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("ä", ["X", "Y"])], "word string, flags array<string>")
    e = sinks.export(df, {"word": "Word", "flags": "Notes"})
    assert e.columns == ["Word", "Notes"] and e.first()["Notes"] == "X Y"
    assert sinks.csv_bytes(e).startswith(b"\xef\xbb\xbfWord,Notes")
    sinks.write_csv(e, str(tmp_path / "out"))
    part = next((tmp_path / "out").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")


def test_stream(spark, tmp_path):
    from wordloom.streaming import counts

    for i, s in enumerate(["the cat", "a cat sat"]):
        spark.createDataFrame([(i, s)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts.count_stream(stream, annotate.annotator("en"), str(tmp_path / "store"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r["word"]: r["freq"] for r in counts.current(spark, str(tmp_path / "store")).collect()} == {"the": 1, "cat": 2, "a": 1, "sat": 1}
