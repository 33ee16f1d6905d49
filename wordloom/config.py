"""Defaults and thresholds.  Values are those in common use in corpus linguistics; results depend on them, so
they are arguments everywhere."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field
from typing import Any


@dataclass(frozen=True)
class Thresholds:
    # fixed values
    corpus_min_tokens: int = 10000
    dp_skew: float = 0.5
    dp_min_freq: int = 10
    dp_min_parts: int = 10
    low_freq: int = 5
    group_imbalance_ratio: float = 3.0
    low_cooccur_threshold: int = 20
    mi_high: float = 5.0
    t_high: float = 2.0
    mi_low: float = 3.0
    high_freq_top_ratio: float = 0.01
    log_dice_strong: float = 7.0
    mi_meaningful: float = 3.0
    g2_significant: float = 6.63
    log_ratio_min: float = 1.0


DEFAULTS: dict[str, dict[str, Any]] = {
    # fixed values
    "collocation": {"default_window": 5, "min_cooccur": 2, "max_rows": 300},
    "keyness": {"hide_not_distinguishable": True, "min_total_freq": 5},
    "network": {"top_n": 60, "min_cooccur": 2},
    "basic_stats": {"sttr_window": 1000},
    "kwic": {"default_window": 5, "page": 500, "max_rows_display": 5000},
    "languages": {
        "ja": {"lemma_unit": "lemma", "nfkc": True},
        "en": {"lowercase": True},
        "de": {"lowercase": False, "separable_verbs": True, "compound_split": False, "norm_1996": False, "norm_ss": False, "norm_umlaut": False},
    },
}


@dataclass
class Settings:
    """What a run depends on, for a reproducibility record."""

    language: str = "en"
    unit: str = "lemma"
    include_function_words: bool = False
    sttr_window: int = 1000
    kwic_window: int = 5
    language_options: dict[str, Any] = field(default_factory=dict)
    cleaning: dict[str, Any] = field(default_factory=dict)

    def to_yaml(self) -> str:
        import yaml

        return yaml.safe_dump(asdict(self), allow_unicode=True, sort_keys=False)

    @classmethod
    def from_yaml(cls, text: str) -> Settings:
        import yaml

        return cls(**(yaml.safe_load(text) or {}))

    def tokenization_key(self) -> tuple:
        """Equal for settings that give equal token tables: what only affects counting and display is left out."""
        return self.language, tuple(sorted(self.language_options.items())), tuple(sorted(self.cleaning.items()))


def load_thresholds(path: str) -> Thresholds:
    import yaml

    with open(path, encoding="utf-8") as f:
        return Thresholds(**(yaml.safe_load(f) or {}).get("thresholds", {}))
