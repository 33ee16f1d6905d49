"""Records over byte ranges, encodings from octets, kept results."""

import csv
import io
import random

import pytest
from helpers import rows
from pyspark.sql import functions as F

from wordloom import cache
from wordloom.operators import annotate, frequency
from wordloom.sources import encodings, files, records

GERMAN = "Die Straße führt über die Brücke, dann geht es weiter nach Süden. Später wird es schön. " * 3
FRENCH = "L'été dernier, où êtes-vous allés ? La forêt était belle, le château fermé, ça va. " * 3
RUSSIAN = "Сегодня хорошая погода, и мы пошли гулять в парк. Дети играли у реки. " * 3
JAPANESE = "私は東京に住んでいます。毎日、電車で会社へ行きます。カメラを買いました。\n" * 3


@pytest.mark.parametrize(
    "text,encoding,want",
    [
        (GERMAN, "utf-8", "utf-8"),
        (JAPANESE, "utf-8", "utf-8"),
        (JAPANESE, "cp932", "cp932"),
        (JAPANESE, "euc_jp", "euc_jp"),
        (GERMAN, "latin-1", "cp1252"),
        (FRENCH, "latin-1", "cp1252"),
        (RUSSIAN, "cp1251", "cp1251"),
        (GERMAN, "utf-16", "utf-16"),
        (GERMAN, "utf-16-le", "utf-16-le"),
        (GERMAN, "utf-16-be", "utf-16-be"),
    ],
)
def test_encodings(text, encoding, want):
    data = text.encode(encoding)
    assert encodings.detect(data) == want
    assert encodings.detect(data[:1] + data) in (want, None) or len(data[:1] + data) % 2  # one octet too many
    broken = data[:40] + b"\xff\xfe\xff"[: 1 if "16" in encoding else 3] + data[40:]
    if "16" not in encoding:
        assert encodings.detect(broken) == want
    if want.startswith("cp12"):  # the others are tried first, and some read what is broken
        assert files.decode_bytes(broken) == (broken.decode(want, "replace"), f"{want} (detected)")


def test_nothing_to_detect():
    assert encodings.detect(b"") is None and encodings.detect(b"\x81") is None


def made(n, seed):
    r = random.Random(seed)
    words = ["plain", "日本", 'say "hi"', "a,b", "line\nend", "two\r\nends", "", "ü", "x" * 50, '"', "\n\n"]
    return [[str(i), r.choice(words), " ".join(r.choice(words) for _ in range(r.randint(0, 9)))] for i in range(n)]


@pytest.mark.parametrize("encoding,ends", [("utf-8", "\n"), ("cp932", "\r\n"), ("euc_jp", "\n"), ("utf-8-sig", "\r\n")])
def test_records_over_ranges(spark, tmp_path, encoding, ends):
    table = [[c.replace("ü", "あ") for c in row] for row in made(400, len(encoding))]
    for k, part in enumerate((table[:390], table[390:])):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator=ends)
        w.writerows([["id", "a", "本文"], *part])
        (tmp_path / f"{k}.csv").write_bytes((out.getvalue() + ("" if k else ends * 3)).encode(encoding))
    plain = encoding.removesuffix("-sig")
    want = {tuple(c or None for c in row) for row in table}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for size in ("97", "1000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            got = records.read_delimited(spark, str(tmp_path), ["id", "a", "本文"], plain)
            assert {tuple(r) for r in got.collect()} == want
            if size == "1000":
                ranges = records.read_records(spark, str(tmp_path), plain).select("file", "block").distinct().count()
                assert ranges > 5  # one large file, many tasks
        one = files.read_table(spark, str(tmp_path / "0.csv"))
        assert one.columns == ["id", "a", "本文"] and one.count() == 390
        assert {tuple(r) for r in one.collect()} == {tuple(c or None for c in row) for row in table[:390]}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_marks_that_never_close(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes(b'a,b\n1,2\n3,"open\n4,5\n')
    got = records.read_delimited(spark, str(tmp_path / "x.csv"), ["a", "b"]).collect()
    assert sorted(tuple(r) for r in got) == [("1", "2"), ("3", "open\n4,5\n")]
    (tmp_path / "empty.csv").write_bytes(b"")
    assert records.read_records(spark, str(tmp_path / "empty.csv")).count() == 0


def test_kept_results(spark, tmp_path):
    docs = spark.createDataFrame([(0, "a cat"), (1, "a dog"), (2, None)], "doc_id long, text string")
    assert cache.fingerprint(docs) == cache.fingerprint(docs.orderBy(F.desc("doc_id")).select("text", "doc_id"))
    assert cache.fingerprint(docs) != cache.fingerprint(docs.withColumn("text", F.coalesce("text", F.lit("x")))) != cache.fingerprint(docs.limit(2))
    assert cache.fingerprint(docs) != cache.fingerprint(docs.unionByName(docs))
    kept, made = cache.Results.of(docs, str(tmp_path)), []

    def make():
        made.append(1)
        return frequency.frequency_table(annotate.annotator("en").annotate(docs), include_function_words=True)

    first = rows(kept.get("frequency", {"unit": "lemma", "fn": True}, make).orderBy("rank"), "word", "freq")
    again = cache.Results.of(docs, str(tmp_path)).get("frequency", {"fn": True, "unit": "lemma"}, make)
    assert rows(again.orderBy("rank"), "word", "freq") == first == [("a", 2), ("cat", 1), ("dog", 1)] and made == [1]
    kept.get("frequency", {"unit": "surface"}, make)
    other = cache.Results.of(docs.limit(1), str(tmp_path))
    other.get("frequency", {"fn": True, "unit": "lemma"}, make)
    assert made == [1] * 3 and kept.versions() == sorted([kept.version, other.version])
    kept.drop()
    assert kept.versions() == [other.version]
    kept.get("frequency", {"unit": "lemma", "fn": True}, make)
    assert made == [1] * 4
