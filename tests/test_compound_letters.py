"""Compounds with letters whose other case is several letters or depends on its neighbours, beside the SQL."""

import pytest
from helpers import connect, same

import __spark_entry__

TEXTS = [
    "Miten Laten Roten ßßtz ßßtal ßßtor nßßa nßßo nßßu Mitenßßtz Mitenßßtz. SSßtz SSßtz",  # Miten+ẞßtz, and a word SSßtz
    "Μιτεν Λατεν Ροτεν οδοα οδοβ οδογ νοδα νοδβ νοδγ ΜΙΤΕΝΟΔΟΣ",
    "Aiten Talar Talon ntar nton ntas ntal AİTENTAL",
    None,
]


@pytest.fixture(scope="module")
def letters(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("letters"))
    docs = spark.createDataFrame([(i, text, "de", "web") for i, text in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    docs.selectExpr("*", "length(text) as n_chars").write.parquet(f"{folder}/documents.parquet")
    return folder


def by_both(spark, folder, name):
    found = __spark_entry__.queries()[name](spark, folder).toPandas()
    same(found, connect(folder).sql(__spark_entry__.oracle_sql()[name]).df())
    return found


def test_compound_list(spark, letters):
    found = by_both(spark, letters, "compound_list")
    parts = dict(zip(found["surface"], found["compound_parts"]))
    assert (parts["Mitenßßtz"], parts["ΜΙΤΕΝΟΔΟΣ"], parts["AİTENTAL"]) == ("Miten+ẞßtz", "Μιτεν+Οδοσ", "Aiten+Tal")


def test_frequency_compounds(spark, letters):
    found = by_both(spark, letters, "frequency_compounds")
    count = dict(zip(found["word"], found["freq"]))
    assert (count["ẞßtz"], count["SSßtz"]) == (2, 2)  # not one word with 4
