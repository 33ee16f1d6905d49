"""What the measures mean, with the thresholds in force filled in."""

from __future__ import annotations

import string
from dataclasses import asdict

from wordloom.config import DEFAULTS, Thresholds

FIELDS = ("label", "what", "high", "low", "caution", "range", "example")
REQUIRED = ["frequency", "pmw", "dispersion_dp", "ttr", "ttr_standardized", "mi_score", "t_score", "log_dice", "log_likelihood", "p_value", "log_ratio", "odds_ratio", "correspondence_axis", "network_centrality", "data_size"]
ENTRIES: dict[str, dict[str, str]] = {
    "data_size": {"label": "Size and balance of the data", "what": "How many tokens and documents there are, in all and by group.", "caution": "Below {corpus_min_tokens} tokens, compare nothing. Groups that differ {group_imbalance_ratio} times in documents bias a comparison.", "range": "At least {corpus_min_tokens} tokens and {dp_min_parts} documents."},
    "frequency": {"label": "Frequency", "what": "How often a word occurs.", "caution": "Below {low_freq} occurrences, claim nothing.", "example": "12 means twelve occurrences in the whole corpus."},
    "pmw": {"label": "Per million words", "what": "Frequency for each million tokens, function words included, so corpora of different size compare.", "high": "A common word.", "low": "A rare word."},
    "dispersion_dp": {"label": "Dispersion (DP)", "what": "Half the sum of differences between a word's shares and the corpus's shares over the parts.", "high": "Concentrated in few parts; above {dp_skew} with {dp_min_freq} occurrences it is flagged.", "low": "Spread as the corpus is.", "range": "0 to 1.", "caution": "Unreliable with fewer than {dp_min_parts} parts."},
    "ttr": {"label": "Type/token ratio", "what": "Different words over running words.", "caution": "Falls with length: compare texts of equal length only.", "range": "0 to 1."},
    "ttr_standardized": {"label": "Standardised type/token ratio", "what": "Mean ratio over chunks of {sttr_window} tokens.", "caution": "Undefined below {sttr_window} tokens."},
    "cooccurrence_frequency": {"label": "Co-occurrence", "what": "How often two words meet in a span.", "caution": "Below {low_cooccur_threshold}, measures are unstable."},
    "mi_score": {"label": "MI", "what": "Base-2 logarithm of observed over expected co-occurrence.", "high": "From {mi_meaningful}, more than chance.", "caution": "Favours rare words: above {mi_high}, check the count."},
    "t_score": {"label": "t-score", "what": "Difference from expectation in units of its spread.", "high": "Above {t_high}, unlikely to be chance.", "caution": "Favours frequent words."},
    "log_dice": {"label": "logDice", "what": "14 plus the logarithm of the Dice coefficient; independent of corpus size.", "high": "From {log_dice_strong}, strong.", "range": "At most 14.", "caution": "Two words of the top {high_freq_top_percent} % score high without a bond."},
    "log_likelihood": {"label": "G2", "what": "How badly independence explains a table of counts.", "high": "From {g2_significant}, p < 0.01.", "low": "Undecided, not absent."},
    "p_value": {"label": "p", "what": "How often chance alone would give as large a G2.", "caution": "With much data everything has a small p; judge by effect size."},
    "log_ratio": {"label": "Log ratio", "what": "Base-2 logarithm of the ratio of two rates.", "high": "From {log_ratio_min}, at least {log_ratio_times} times as frequent.", "caution": "Zero counts are corrected by one half."},
    "odds_ratio": {"label": "Odds ratio", "what": "Odds of the word in one group over those in the other.", "caution": "Undefined where a count is zero."},
    "correspondence_axis": {"label": "Correspondence axes", "what": "Directions along which words and groups differ most.", "caution": "Read axes with their share of variation."},
    "network_centrality": {"label": "Centrality", "what": "Degree: how many words a word is linked to. Betweenness: how many shortest paths run through it.", "caution": "Depends on the number of words and the threshold {log_dice_strong}."},
    "token_type": {"label": "Tokens and types", "what": "Running words and different words."},
    "lemma": {"label": "Lemma", "what": "The form that inflected forms are counted under."},
    "lemma_key": {"label": "Lemma key", "what": "A lemma with what tells homographs apart; counted by, not shown."},
    "function_words": {"label": "Function words", "what": "Articles, particles, conjunctions and the like; hidden by default, always in denominators."},
    "short_long_unit": {"label": "Units", "what": "Whether compounds count as one word or several."},
    "compound_splitting": {"label": "Compound splitting", "what": "Counting a compound's parts instead of the compound."},
    "separable_verbs": {"label": "Separable verbs", "what": "A prefix that stands apart is counted with its verb."},
}


class UnknownVariable(ValueError):
    """An entry names a variable that the configuration lacks."""


def fmt_threshold(value: object) -> str:
    if isinstance(value, float):
        return f"{int(value):,}" if value.is_integer() else f"{value:g}"
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value)


def template_variables(th: Thresholds = Thresholds()) -> dict[str, str]:
    own = asdict(th) | {"high_freq_top_percent": 100 * th.high_freq_top_ratio, "log_ratio_times": 2**th.log_ratio_min, "sttr_window": DEFAULTS["basic_stats"]["sttr_window"], "default_window": DEFAULTS["collocation"]["default_window"]}
    return {k: fmt_threshold(v) for k, v in own.items()}


def render_template(text: str, variables: dict[str, str]) -> str:
    try:
        return string.Formatter().vformat(text, (), variables)
    except (KeyError, IndexError) as e:
        raise UnknownVariable(f"unknown variable {e} in {text!r}") from e


def load(th: Thresholds = Thresholds()) -> dict[str, dict[str, str]]:
    missing = [k for k in REQUIRED if k not in ENTRIES]
    if missing:
        raise KeyError(", ".join(missing))
    variables = template_variables(th)
    return {k: {f: render_template(e[f], variables) for f in FIELDS if f in e} for k, e in ENTRIES.items()}


def tooltip(key: str, th: Thresholds = Thresholds()) -> str:
    e = load(th)[key]
    return " ".join(e[f] for f in ("what", "caution") if f in e)


def full_text(key: str, th: Thresholds = Thresholds()) -> str:
    e = load(th)[key]
    return "\n".join(f"{f}: {e[f]}" for f in FIELDS if f in e)


def caution_head(key: str, th: Thresholds = Thresholds()) -> str:
    """The caution's first sentence."""
    return load(th)[key].get("caution", "").split(". ")[0].rstrip(".")
