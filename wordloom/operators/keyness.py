"""Words that tell two groups apart.  One pass: both groups' counts are conditional sums of one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions import measures
from wordloom.storage import stored

from .frequency import first_label, words_from


def sides(tokens: DataFrame, documents: DataFrame | None, group: str, a: str, b: str | None = None) -> DataFrame:
    """tokens of either group + side ("A", "B"); without b, all other documents are B.  documents: where tokens do not
    carry the group."""
    g = F.coalesce(F.col(group).cast("string"), F.lit(""))
    side = F.when(g == a, "A")
    side = side.otherwise("B") if b is None else side.when(g == b, "B")
    if group in tokens.columns:
        return tokens.withColumn("side", side).where("side IS NOT NULL")
    return tokens.join(documents.select("doc_id", side.alias("side")).where("side IS NOT NULL"), "doc_id")


def keyness_table(sided: DataFrame, unit: str = "lemma", include_function_words: bool = False, with_p: bool = False) -> DataFrame:
    """word, label, pos, freq_a, freq_b, pmw_a, pmw_b, g2, log_ratio, odds_ratio, zero_corrected, direction (and p);
    empty if a group is."""
    is_a, is_b = F.col("side") == "A", F.col("side") == "B"
    # tokens are counted once; the groups' sizes and the words come from the stored counts
    counts = [F.count("*").alias("n"), F.count_if(is_a).alias("freq_a"), F.count_if(is_b).alias("freq_b"), *first_label(sided, unit)]
    counted = stored(sided.groupBy(F.col(unit).alias("word"), "pos", "is_function").agg(*counts), "sides")
    totals = counted.agg(F.sum("freq_a").alias("na"), F.sum("freq_b").alias("nb")).where("na > 0 AND nb > 0")
    selected = counted.where(F.col("word").isNotNull() if include_function_words else F.col("word").isNotNull() & ~F.col("is_function"))
    sums = [*(F.sum(c).alias(c) for c in ("n", "freq_a", "freq_b")), *([F.min("first").alias("first")] if "first" in counted.columns else [])]
    words = words_from(selected.groupBy("word", "pos").agg(*sums))
    fa, fb, na, nb = (F.col(c) for c in ("freq_a", "freq_b", "na", "nb"))
    ratio = measures.log_ratio(fa, fb, na, nb)
    out = words.crossJoin(F.broadcast(totals)).select(
        "word",
        F.coalesce("label", "word").alias("label"),
        "pos",
        "freq_a",
        "freq_b",
        (fa / na * 1e6).alias("pmw_a"),
        (fb / nb * 1e6).alias("pmw_b"),
        measures.g2_keyness(fa, fb, na, nb).alias("g2"),
        ratio.alias("log_ratio"),
        measures.odds_ratio(fa, fb, na, nb).alias("odds_ratio"),
        ((fa == 0) | (fb == 0)).alias("zero_corrected"),
    )
    out = out.withColumn("direction", F.when(F.col("log_ratio") > 0, "A").when(F.col("log_ratio") < 0, "B").otherwise("="))
    if with_p:
        out = out.withColumn("p", measures.p_value("g2"))
    return out.orderBy(F.desc("log_ratio"), F.desc("g2"), "word")


def view(table: DataFrame, min_total: int = 5, hide_below_g2: float | None = 6.63, direction: str | None = None) -> DataFrame:
    out = table.where(F.col("freq_a") + F.col("freq_b") >= min_total)
    if hide_below_g2 is not None:
        out = out.where(F.col("g2") >= hide_below_g2)
    if direction == "A":
        return out.where("log_ratio > 0").orderBy(F.desc("log_ratio"), F.desc("g2"), "word")
    if direction == "B":
        return out.where("log_ratio < 0").orderBy("log_ratio", F.desc("g2"), "word")
    return out


def hidden_count(table: DataFrame, min_total: int = 5, g2: float = 6.63) -> DataFrame:
    """How many words are hidden because the data do not tell."""
    return table.where((F.col("freq_a") + F.col("freq_b") >= min_total) & (F.col("g2") < g2)).agg(F.count("*").alias("n_hidden"))
