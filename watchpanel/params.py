"""Settings with their default values."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from watchpanel import fixed_values as fv


@dataclass(frozen=True)
class TextParams:
    """How documents are condensed into one text per entity and day; a limit of None is off."""

    max_docs_per_day: int | None = 3
    use_key_sentences: bool = True
    max_sentences: int | None = 3
    key_max_chars: int | None = 300
    min_sentence_chars: int = 8
    title_max_chars: int | None = 60
    document_max_chars: int | None = 220
    lookback_days: int = 60
    keywords: tuple[str, ...] = fv.RULE_KEYWORDS
    sentence_breaks: str = fv.SENTENCE_BREAKS


@dataclass(frozen=True)
class PrefilterParams:
    """Thresholds of the cheap text prefilter."""

    high: int = 5
    medium: int = 3
    keywords: tuple[str, ...] = fv.RULE_KEYWORDS
    category_terms: tuple[str, ...] = fv.CATEGORY_TERMS
    scan_chars: int | None = None
    allowed: tuple[str, ...] = ("HIGH", "MEDIUM")


MODEL_PREFILTER = PrefilterParams(high=8, medium=5, keywords=fv.MODEL_KEYWORDS)


@dataclass(frozen=True)
class RuleParams:
    """Rule track: decay memory with two thresholds, listing, evaluation."""

    output_start: dt.date = dt.date(2024, 1, 1)
    output_end: dt.date = dt.date(2024, 12, 31)
    decay: float = 0.3
    entry: float = 80.0
    retain: float = 65.0
    top_k: int | None = None
    horizon_days: int = 365
    min_lead_days: int = 1
    market_n: int = 5400
    only_events_in_output: bool = True
    text: TextParams = field(default_factory=TextParams)
    prefilter: PrefilterParams = field(default_factory=PrefilterParams)


@dataclass(frozen=True)
class ModelParams:
    """Model track: feature frame, boosted regression, listing."""

    train_start: dt.date = dt.date(2020, 1, 1)
    train_end: dt.date = dt.date(2023, 12, 31)
    predict_start: dt.date = dt.date(2024, 1, 1)
    predict_end: dt.date = dt.date(2024, 12, 31)
    validation_start: dt.date = dt.date(2023, 1, 1)
    zero_ratio: float = 5.537670
    label_threshold: float = 0.017067
    seed: int = 42
    max_iter: int = 96
    step_size: float = 0.015708
    max_depth: int = 5
    horizon_days: int = 365
    min_lead_days: int = 1
    market_n: int = 5400
