"""A corpus pipeline over ``documents``: toxic texts go, lines that many documents share go, one document of each
group of near duplicates stays, documents with benchmark passages go, and what is left is packed.

A stage takes (spark, docs, sf_dir), with all that the stage before it kept, and returns the columns of
documents; the last returns packed pieces.  ``n_chars`` follows the text.  The near-duplicate stage links documents
whose sets of five-word shingles have a Jaccard similarity of 0.8 or more: candidates by SimHash and BK-trees, checked
exactly.  op1's settings (three words, three bits) are for op1 alone.

Defined results: null and empty texts are not toxic, are one document for the near-duplicate stage (the smallest id stays), have no
benchmark passage, and are packed as one closing id; documents that repeat an id and a text are one, those that repeat only
an id are told apart by their texts; null ids are kept like others and come last where the smallest id stays; an
empty table gives an empty table with the same columns; further columns of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import decontaminate, linededup, packing, resemblance, toxicity
from wordloom.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linededup.drop_lines(docs, min_docs=10, mode="all")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return resemblance.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("near dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: Learned scores, hashes and token ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"), regroup=False)
    return STAGES[-1][1](spark, docs, sf_dir)
