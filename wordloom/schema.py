"""The token table's contract.  Order-dependent operators name (doc_id, position) themselves; rows have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

TOKENS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("sentence_id", LongType()),
        StructField("position", LongType()),
        StructField("surface", StringType()),
        StructField("lemma", StringType()),
        StructField("lemma_label", StringType()),
        StructField("pos", StringType()),
        StructField("pos_detail", StringType()),
        StructField("is_function", BooleanType()),
        StructField("dep", StringType()),
        StructField("head", LongType()),
        StructField("lemma_alt", StringType()),
        StructField("compound_parts", StringType()),
    ]
)
#: Columns of a document table that are never groups.
CORE = {"doc_id", "name", "n_chars", "encoding", "text"}


def conform(tokens: DataFrame) -> DataFrame:
    """A pre-annotated table with the columns it lacks filled by their defaults and all types as in TOKENS."""
    default = {"sentence_id": F.lit(0), "lemma": F.col("surface"), "lemma_label": None, "pos": F.lit(""), "pos_detail": F.lit(""), "is_function": F.lit(False), "dep": F.lit(""), "head": F.lit(-1), "lemma_alt": F.lit(""), "compound_parts": F.lit("")}
    lemma = F.col("lemma") if "lemma" in tokens.columns else F.col("surface")
    default["lemma_label"] = lemma
    return tokens.select(*((F.coalesce(F.col(f.name), default[f.name]) if f.name in tokens.columns and f.name in default else F.col(f.name) if f.name in tokens.columns else default[f.name]).cast(f.dataType).alias(f.name) for f in TOKENS))


def group_columns(documents: DataFrame) -> list[str]:
    return [c for c in documents.columns if c not in CORE]
