"""Words over ordered groups: is there a trend (Mann-Kendall), and how steep is it (Theil-Sen)?

A word's rates in the groups are an array in its row, with zeros where it does not occur; the test and the slope are
expressions over that array.  Nothing but the counts by word and group is shuffled.  Groups are years or the like: at
most ``MOST_GROUPS``, since a row compares all of them with each other.

Defined results: tokens without a group have no part; a group without tokens is none; with fewer than two groups there are no
rows; where all rates are equal S is 0 and p is 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import measures
from wordloom.storage import stored

from .frequency import counted

MOST_GROUPS = 500


def group_values(sizes: DataFrame) -> list[tuple]:
    """(group, size) in order; sizes: group, size."""
    found = sorted((r["group"], r["size"]) for r in sizes.limit(MOST_GROUPS + 1).collect())
    if len(found) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups")
    return found


def _sum(values: Column, kind: str = "double") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda s, x: s + x)


def trend_table(tokens: DataFrame, group: str, unit: str = "lemma", include_function_words: bool = False, min_freq: int = 5) -> DataFrame:
    """word, freq, s, z, p, slope (per million and group), for words with at least min_freq occurrences.  tokens: a table, or tokens counted by type and group.

    s counts pairs of groups that rise less those that fall; its variance allows for ties; z is corrected for continuity."""
    each = F.col("n") if "n" in tokens.columns else F.lit(1).cast("long")
    parted = tokens.where(F.col(group).isNotNull())
    counts = parted.groupBy(F.col(unit).alias("word"), F.col(group).alias("group")).agg(counted(tokens).alias("size"), F.sum(F.when(F.lit(include_function_words) | ~F.col("is_function"), each).otherwise(0)).alias("n"))
    counts = stored(counts, "trend")  # the groups and the words come from it
    groups = group_values(counts.groupBy("group").agg(F.sum("size").alias("size")))
    k = len(groups)
    if k < 2:
        return counts.limit(0).select("word", *(F.lit(None).cast(t).alias(c) for c, t in (("freq", "bigint"), ("s", "bigint"), ("z", "double"), ("p", "double"), ("slope", "double"))))
    rates = [F.coalesce(F.sum(F.when(F.col("group") == g, F.col("n"))), F.lit(0)) / F.lit(float(size)) * 1e6 for g, size in groups]
    words = counts.where("n > 0 AND word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("freq"), F.array(*rates).alias("x")).where(F.col("freq") >= min_freq)
    steps = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(k - 2)), lambda i: F.transform(F.sequence(i + 1, F.lit(k - 1)), lambda j: F.struct((F.get("x", j) - F.get("x", i)).alias("d"), (j - i).alias("apart")))))
    ties = F.transform("x", lambda a: F.size(F.filter("x", lambda b: a == b)))
    w = words.withColumn("steps", steps).withColumn("ties", ties)
    w = w.withColumn("s", _sum(F.transform("steps", lambda y: F.signum(y["d"]).cast("long")), "long"))
    w = w.withColumn("var", (F.lit(k * (k - 1) * (2 * k + 5)) - _sum(F.transform("ties", lambda t: ((t - 1) * (2 * t + 5)).cast("long")), "long")) / 18)
    w = w.withColumn("z", F.when(F.col("var") > 0, (F.col("s") - F.signum("s")) / F.sqrt("var")).otherwise(0.0))
    w = w.withColumn("slopes", F.sort_array(F.transform("steps", lambda y: y["d"] / y["apart"])))
    m = k * (k - 1) // 2
    middle = (F.get("slopes", F.lit((m - 1) // 2)) + F.get("slopes", F.lit(m // 2))) / 2
    return w.select("word", "freq", "s", "z", measures.p_value(F.col("z") * F.col("z")).alias("p"), middle.alias("slope"))
