"""Reliability rules as flag columns, and as flags with a message for one row.

A rule compares the unrounded value; where a measure is undefined, the rules that need it are silent."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.config import Thresholds

#: Code: (level, message, short mark).
TEXTS: dict[str, tuple[str, str, str]] = {
    "CORPUS_TOO_SMALL": ("warning", "The corpus has {total_tokens:,} tokens, short of {threshold:,}; differences in counts may well be chance. Read concordances, and gather more data before comparing.", "small corpus"),
    "DISPERSION_SKEWED": ("warning", "'{word}' occurs {freq:,} times, but its dispersion of {dp:.2f} is above {threshold}: it is concentrated in few parts. See which before calling it typical.", "skewed"),
    "DP_TOO_FEW_PARTS": ("info", "With {n_parts} parts (fewer than {threshold}) dispersion says little.", "few parts"),
    "LOW_FREQUENCY": ("info", "'{word}' occurs {freq} times; below {threshold}, claim nothing about it.", "rare"),
    "GROUP_IMBALANCE": ("warning", "Group '{group_a}' has {size_a:,} documents and '{group_b}' {size_b:,}, {ratio:.1f} times as many; the larger may dominate.", "imbalance"),
    "LOW_COOCCURRENCE": ("warning", "Only {cooccur} times together, under the minimum of {threshold}: one meeting more or less would move every measure. {mi_note}", "few, looks strong"),
    "LOW_COOCCURRENCE_MINOR": ("info", "They meet only {cooccur} times.", "few"),
    "BOTH_HIGH_FREQUENCY": ("warning", "Each of the two is in the top {top_percent:g} % of the vocabulary ({freq_node:,} and {freq_collocate:,} occurrences); such words share contexts as a rule.", "both frequent"),
    "NOT_DISTINGUISHABLE": ("warning", "G2 = {g2:.1f} is below {threshold}: the data cannot tell this from chance, which does not mean that there is nothing.", "undecided"),
    "T_HIGH_MI_LOW": ("warning", "t = {t:.1f} with MI = {mi:.1f}: the pair is counted often, but neither word prefers the other.", "common neighbour"),
    "ZERO_CORRECTED": ("info", "One group lacks '{word}'. Half a count is given to both sides so that there is a log ratio; an odds ratio is left open.", "absent in one"),
    "EFFECT_SIZE_TOO_SMALL": ("warning", "The log ratio of '{word}', {log_ratio:+.2f}, is within {threshold} of none: too small a difference to report, whatever its p.", "small effect"),
}


@dataclass(frozen=True)
class Flag:
    code: str
    level: str
    message: str
    details: dict[str, Any] = field(default_factory=dict)


def make_flag(code: str, **details: Any) -> Flag:
    """A template that the details do not fill stays as it is."""
    level, template, _ = TEXTS[code]
    try:
        message = template.format(**details).rstrip()
    except (KeyError, ValueError):
        message = template
    return Flag(code, level, message, details)


def _codes(rules: list[tuple[str, Column]]) -> Column:
    return F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(code)) for code, c in rules)))


def flag_frequency(table: DataFrame, th: Thresholds = Thresholds(), n_parts: int | None = None) -> DataFrame:
    """n_parts: how many parts dispersion is over; with too few it is not judged."""
    reliable = F.lit(n_parts is None or n_parts >= th.dp_min_parts)
    return table.withColumn("flags", _codes([("DISPERSION_SKEWED", reliable & (F.col("dp") > th.dp_skew) & (F.col("freq") >= th.dp_min_freq)), ("LOW_FREQUENCY", F.col("freq") < th.low_freq)]))


def _looks_strong(th: Thresholds) -> Column:
    above = [("log_dice", th.log_dice_strong), ("mi", th.mi_meaningful), ("g2", th.g2_significant)]
    return F.exists(F.array(*(F.coalesce(F.col(c) >= v, F.lit(False)) for c, v in above)), lambda x: x)


def flag_collocation(table: DataFrame, th: Thresholds = Thresholds(), cutoff: DataFrame | None = None) -> DataFrame:
    """cutoff: one row with the frequency from which a word is very frequent."""
    cols, few = table.columns, F.col("cooccur") < th.low_cooccur_threshold
    t = table.crossJoin(F.broadcast(cutoff.select(F.col("cutoff").alias("__cutoff")))) if cutoff is not None else table.withColumn("__cutoff", F.lit(None).cast("long"))
    flags = _codes(
        [
            ("LOW_COOCCURRENCE", few & _looks_strong(th)),
            ("LOW_COOCCURRENCE_MINOR", few & ~_looks_strong(th)),
            ("NOT_DISTINGUISHABLE", F.col("g2") < th.g2_significant),
            ("BOTH_HIGH_FREQUENCY", F.least("freq_node", "freq_collocate") >= F.col("__cutoff")),
            ("T_HIGH_MI_LOW", (F.col("t") > th.t_high) & (F.col("mi") < th.mi_low)),
        ]
    )
    return t.select(*cols, flags.alias("flags"))


def flag_keyness(table: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    rules = {"NOT_DISTINGUISHABLE": ("g2", F.col("g2") < th.g2_significant), "EFFECT_SIZE_TOO_SMALL": ("log_ratio", F.abs("log_ratio") < th.log_ratio_min), "ZERO_CORRECTED": ("zero_corrected", F.col("zero_corrected"))}
    return table.withColumn("flags", _codes([(code, c) for code, (col, c) in rules.items() if col in table.columns]))


def flag_group_imbalance(sizes: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """One row: largest, smallest, ratio, flagged.  sizes: group, n_documents."""
    full = sizes.where("n_documents > 0").agg(F.max("n_documents").alias("largest"), F.min("n_documents").alias("smallest"), F.count("*").alias("groups"))
    ratio = F.try_divide(F.col("largest").cast("double"), F.col("smallest").cast("double"))
    return full.select("largest", "smallest", ratio.alias("ratio"), ((F.col("groups") >= 2) & F.coalesce(ratio > th.group_imbalance_ratio, F.lit(False))).alias("flagged"))


def with_marks(flagged: DataFrame) -> DataFrame:
    """+ marks: the flags' short names."""
    names = F.create_map(*(F.lit(x) for code, (_, _, mark) in TEXTS.items() for x in (code, mark)))
    return flagged.withColumn("marks", F.array_join(F.transform("flags", lambda f: F.element_at(names, f)), "; "))


def having(flagged: DataFrame, code: str) -> DataFrame:
    return flagged.where(F.array_contains("flags", code))


# --- flags of single values, with their messages ----------------------------------------------------------


def check_corpus_size(total: int, th: Thresholds = Thresholds()) -> list[Flag]:
    return [make_flag("CORPUS_TOO_SMALL", total_tokens=total, threshold=th.corpus_min_tokens)] if total < th.corpus_min_tokens else []


def check_group_imbalance(sizes: dict[str, int], th: Thresholds = Thresholds()) -> list[Flag]:
    full = {k: v for k, v in sizes.items() if v > 0}
    if len(full) < 2:
        return []
    a, b = max(full, key=full.__getitem__), min(full, key=full.__getitem__)
    ratio = full[a] / full[b]
    return [make_flag("GROUP_IMBALANCE", group_a=a, size_a=full[a], group_b=b, size_b=full[b], ratio=ratio)] if ratio > th.group_imbalance_ratio else []


def check_dp_reliability(n_parts: int, th: Thresholds = Thresholds()) -> list[Flag]:
    return [make_flag("DP_TOO_FEW_PARTS", n_parts=n_parts, threshold=th.dp_min_parts)] if n_parts < th.dp_min_parts else []


def explain_flags(row: dict[str, Any], th: Thresholds = Thresholds()) -> list[Flag]:
    """Messages for a flagged row; the codes are the column's, so rules are written once."""
    mi = row.get("mi")
    note = f"MI ({mi:.1f}) runs high at low counts." if mi is not None and mi > th.mi_high else ""
    limit = {"DISPERSION_SKEWED": th.dp_skew, "LOW_FREQUENCY": th.low_freq, "LOW_COOCCURRENCE": th.low_cooccur_threshold, "NOT_DISTINGUISHABLE": th.g2_significant, "EFFECT_SIZE_TOO_SMALL": th.log_ratio_min}
    return [make_flag(code, **(row | {"threshold": limit.get(code), "mi_note": note, "top_percent": 100 * th.high_freq_top_ratio})) for code in row["flags"]]


def pre_analysis_flags(total_tokens: int, sizes_by_group: dict[str, dict[str, int]], th: Thresholds = Thresholds()) -> list[Flag]:
    return [*check_corpus_size(total_tokens, th), *(f for sizes in sizes_by_group.values() for f in check_group_imbalance(sizes, th))]
