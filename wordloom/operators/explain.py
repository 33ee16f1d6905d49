"""Plain-language explanations of one row of a result, for the driver.

All that can be said is one table of statements.  A statement belongs to a section and names what it needs: a screen, a
flag, comparisons of metrics with thresholds.  One evaluator goes through the table, keeps what holds, and fills in the
values; the table's order is the order of importance."""

from __future__ import annotations

import itertools
import operator
import re
from collections import ChainMap
from dataclasses import dataclass, field
from typing import Any

from wordloom.config import Thresholds

from .glossary import template_variables
from .rules import Flag

FACT, PAPER, DONT, NEXT = "What the data say", "How to report it", "What not to say", "What to do next"
#: How many lines a section has at most, and whether it appears without any.
SECTIONS = {FACT: (2, True), PAPER: (None, True), DONT: (None, False), NEXT: (None, False)}
#: Flags for tables only.
TABLE_ONLY = {"LOW_COOCCURRENCE_MINOR"}
#: Number formats by metric; fixed values.
FORMATS = {"p": ".3f", "log_ratio": "+.2f", "pmw": ",.1f", "pmw_a": ",.1f", "pmw_b": ",.1f", "g2": ",.1f", "ratio": ".1f"}
NOTHING = "—"


@dataclass(frozen=True)
class Row:
    """screen: frequency, collocation or keyness; words: WORD, COLLOCATE, GROUP_A, GROUP_B."""

    screen: str
    metrics: dict[str, Any]
    flags: list[Flag] = field(default_factory=list)
    words: dict[str, str] = field(default_factory=dict)
    settings: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Statement:
    """when: comparisons such as "mi < mi_meaningful", all of which hold; a metric without a value fails any.  Without
    a value is "mi ?".  without: flags that silence it.  last: only if the section would be empty."""

    section: str
    text: str
    flag: str = ""
    screen: str = ""
    when: tuple[str, ...] = ()
    without: tuple[str, ...] = ()
    last: bool = False


def _flagged(code: str, fact: str, step: str) -> list[Statement]:
    return [Statement(FACT, fact, code), Statement(DONT, "{MESSAGE}", code), Statement(NEXT, step, code)]


_DISAGREE = "The measures disagree on '{WORD}' and '{COLLOCATE}': logDice is high ({log_dice}), but "
_NOISE = ("BOTH_HIGH_FREQUENCY", "T_HIGH_MI_LOW")
_STRONG = "log_dice >= log_dice_strong"

#: What each measure says about a pair, against its limit; a measure without a value is left out.
_MEASURES = [
    [(f"{name} >= {limit}", f"{label} is {{{name}}}, {above} ({{{limit}}})"), (f"{name} < {limit}", f"{label} is {{{name}}}, {below} ({{{limit}}})"), (f"{name} ?", "")]
    for name, limit, label, above, below in (
        ("log_dice", "log_dice_strong", "logDice", "above the mark of a strong bond", "below the mark of a strong bond"),
        ("mi", "mi_meaningful", "MI", "above what chance explains", "below what chance explains"),
        ("g2", "g2_significant", "G2", "above the limit of significance", "below the limit of significance"),
    )
]
_LEVELS = [
    Statement(FACT, "'{WORD}' and '{COLLOCATE}' meet {cooccur} times" + "".join(f"{sign} {text}" for sign, text in zip(":;;", filter(None, (text for _, text in case)), strict=False)) + ".", screen="collocation", when=tuple(when for when, _ in case), last=True)
    for case in itertools.product(*_MEASURES)
]

STATEMENTS = [
    Statement(FACT, _DISAGREE + "MI ({mi}) is near chance, as for any two common words.", screen="collocation", when=(_STRONG, "mi < mi_meaningful"), without=_NOISE),
    Statement(FACT, _DISAGREE + "G2 ({g2}) cannot be told from chance.", screen="collocation", when=(_STRONG, "mi >= mi_meaningful", "g2 < g2_significant"), without=_NOISE),
    Statement(FACT, _DISAGREE + "G2 ({g2}) cannot be told from chance.", screen="collocation", when=(_STRONG, "mi ?", "g2 < g2_significant"), without=_NOISE),
    *_flagged("GROUP_IMBALANCE", "The groups differ much in size, so a difference may be that of the larger group's documents.", "Balance the groups, or repeat with a sample of the larger one."),
    *_flagged("BOTH_HIGH_FREQUENCY", "'{WORD}' and '{COLLOCATE}' are both very frequent, which alone accounts for a logDice of {log_dice}.", "Look for collocates below the most frequent {high_freq_top_percent} % of words."),
    *_flagged("T_HIGH_MI_LOW", "'{COLLOCATE}' is near '{WORD}' {cooccur} times and near most other words too (MI = {mi}).", "Rank the collocates by a measure of exclusiveness instead."),
    *_flagged("LOW_COOCCURRENCE", "logDice = {log_dice} and MI = {mi} for '{WORD}' and '{COLLOCATE}' rest on {cooccur} occurrences.", "There are few enough lines to read each: {cooccur}."),
    *_flagged("NOT_DISTINGUISHABLE", "G2 is {g2}, below {threshold}: with these data the result cannot be told from chance.", "Gather more data before deciding."),
    *_flagged("DP_TOO_FEW_PARTS", "With {n_parts} parts, how evenly '{WORD}' is spread cannot be judged.", "Use at least {dp_min_parts} documents, or another division."),
    *_flagged("DISPERSION_SKEWED", "'{WORD}' occurs {freq} times, mostly in few parts (DP = {dp}).", "See the word's distribution over the parts."),
    *_flagged("LOW_FREQUENCY", "'{WORD}' occurs {freq} times, too rarely to speak of a tendency.", "Read the concordance lines one by one."),
    *_flagged("ZERO_CORRECTED", "'{WORD}' occurs {freq_present} times in '{GROUP_PRESENT}' and never in '{GROUP_ABSENT}'.", "Say in which group it occurs, and how often; no ratio is needed."),
    *_flagged("EFFECT_SIZE_TOO_SMALL", "The rates of '{WORD}' differ by a log ratio of {log_ratio}, too little to matter.", "Prefer words with a log ratio of at least {log_ratio_min} in size."),
    *_LEVELS,
    Statement(FACT, "'{WORD}' occurs {freq} times ({pmw} per million) and is concentrated: its dispersion of {dp} is above {dp_skew}.", screen="frequency", when=("dp > dp_skew",), last=True),
    Statement(FACT, "'{WORD}' occurs {freq} times ({pmw} per million) and is spread over the corpus: its dispersion of {dp} is not above {dp_skew}.", screen="frequency", when=("dp <= dp_skew",), last=True),
    Statement(FACT, "'{WORD}' occurs {freq} times ({pmw} per million).", screen="frequency", when=("dp ?",), last=True),
    Statement(FACT, "'{WORD}' is more frequent in '{GROUP_A}': a log ratio of {log_ratio}, at least {log_ratio_min} in size.", screen="keyness", when=("log_ratio > 0",), last=True),
    Statement(FACT, "'{WORD}' is more frequent in '{GROUP_B}': a log ratio of {log_ratio}, at least {log_ratio_min} in size.", screen="keyness", when=("log_ratio < 0",), last=True),
    Statement(FACT, "'{WORD}' is as frequent in '{GROUP_A}' as in '{GROUP_B}'.", screen="keyness", when=("log_ratio == 0",), last=True),
    Statement(PAPER, "Frequency of '{WORD}': {freq} in a corpus of {n_total} tokens, or {pmw} per million; deviation of proportions {dp}.", screen="frequency", without=("DP_TOO_FEW_PARTS",)),
    Statement(PAPER, "Frequency of '{WORD}': {freq} in a corpus of {n_total} tokens, or {pmw} per million.", screen="frequency", flag="DP_TOO_FEW_PARTS"),
    Statement(PAPER, "Collocate '{COLLOCATE}' of '{WORD}', span {window_label}: {cooccur} occurrences; logDice {log_dice}, MI {mi}, t {t}, G2 {g2}.", screen="collocation"),
    Statement(PAPER, "Rates of '{WORD}' per million: '{GROUP_A}' {pmw_a} ({freq_a} in {n_a} tokens), '{GROUP_B}' {pmw_b} ({freq_b} in {n_b}). Log ratio {log_ratio}; G2 {g2}; p {p}.", screen="keyness", without=("ZERO_CORRECTED",)),
    Statement(PAPER, "Rates of '{WORD}' per million: '{GROUP_A}' {pmw_a} ({freq_a} in {n_a} tokens), '{GROUP_B}' {pmw_b} ({freq_b} in {n_b}). Log ratio {log_ratio}, with half a count added on both sides; G2 {g2}; p {p}.", screen="keyness", flag="ZERO_CORRECTED"),
]
_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq}


def _missing(value: Any) -> bool:
    return value is None or value != value


def fmt(key: str, value: Any) -> str:
    """A value as text: by the metric's format if it is a fraction, whole numbers with thousands."""
    if _missing(value):
        return NOTHING
    if not isinstance(value, float):
        return {bool: lambda: ("no", "yes")[value], int: lambda: format(value, ",")}.get(type(value), lambda: str(value))()
    return "< 0.001" if key == "p" and value < 0.001 else format(value, FORMATS.get(key, ".2f"))


class Facts:
    """What a row's statements can refer to."""

    def __init__(self, row: Row, th: Thresholds):
        self.row, self.limits = row, vars(th)
        self.flags = {f.code: f for f in row.flags if f.code not in TABLE_ONLY}
        shown = {k: fmt(k, v) for k, v in row.metrics.items()}
        names = {"window_label": row.settings.get("window_label", "the span")} | row.words
        counts = {g: row.metrics.get(f"freq_{g.lower()}") or 0 for g in "AB"}
        there = [g for g, n in counts.items() if n]
        if row.screen == "keyness" and len(there) == 1:
            lacking = "B" if there == ["A"] else "A"
            names |= {"GROUP_PRESENT": row.words.get(f"GROUP_{there[0]}", ""), "GROUP_ABSENT": row.words.get(f"GROUP_{lacking}", "")}
            shown["freq_present"] = fmt("freq", counts[there[0]])
        self.values = ChainMap(names, shown, template_variables(th))

    def compare(self, condition: str) -> bool:
        name, sign, *limit = condition.split()
        value = self.row.metrics.get(name)
        if sign == "?":
            return _missing(value)
        return not _missing(value) and _COMPARE[sign](value, self.limits[limit[0]] if limit[0] in self.limits else float(limit[0]))

    def holds(self, s: Statement) -> bool:
        return s.screen in ("", self.row.screen) and (not s.flag or s.flag in self.flags) and self.flags.keys().isdisjoint(s.without) and all(map(self.compare, s.when))

    def say(self, s: Statement) -> str:
        """Words come before a flag's details, those before metrics and those before thresholds; unknown names stay."""
        flag = self.flags.get(s.flag)
        own = {"MESSAGE": flag.message, **{k: fmt(k, v) for k, v in flag.details.items() if k not in self.values.maps[0]}} if flag else {}
        return re.sub(r"\{(\w+)\}", lambda m: self.values.new_child(own).get(m[1], m[0]), s.text)


def _unlisted(row: Row) -> list[Statement]:
    """Messages of flags that the table does not know come last."""
    known = {s.flag for s in STATEMENTS if s.section == DONT}
    return [Statement(DONT, "{MESSAGE}", f.code) for f in row.flags if f.code not in known]


def explain_sections(row: Row, th: Thresholds = Thresholds()) -> list[tuple[str, list[str]]]:
    facts = Facts(row, th)
    true = [s for s in [*STATEMENTS, *_unlisted(row)] if facts.holds(s)]
    out = []
    for section, (most, always) in SECTIONS.items():
        for last in (False, True):
            lines = list(dict.fromkeys(facts.say(s) for s in true if s.section == section and s.last == last))[:most]
            if lines or (last and always):
                out.append((section, lines))
                break
    return out


def explain(row: Row, th: Thresholds = Thresholds()) -> str:
    """Sections as text; a section of several lines is a list."""
    text = ""
    for head, lines in explain_sections(row, th):
        mark = "- " if len(lines) > 1 else ""
        text += "".join([head, *(f"\n{mark}{line}" for line in lines), "\n\n"])
    return text.rstrip("\n")
