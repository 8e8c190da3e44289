"""Phrase rules: which phrases of which category really apply to a text.

A phrase counts when it occurs at least once outside disclaimer wording and with no negation
near it.  Both conditions are look-around assertions of one regular expression per phrase,
tried only where the phrase occurs, so whole texts are scanned inside the JVM without
splitting them into positions.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import as_column


def _quote(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def _by_length(phrases: Sequence[str]) -> dict[int, str]:
    """Alternations of phrases of equal length."""
    groups: dict[int, list[str]] = {}
    for phrase in phrases:
        if phrase:
            groups.setdefault(len(phrase), []).append(_quote(phrase))
    return {n: "(?:" + "|".join(items) + ")" for n, items in sorted(groups.items())}


@dataclass(frozen=True)
class PhraseRules:
    """Categories with three strengths of phrases, plus negations and disclaimers."""

    categories: Mapping[str, tuple[int, Sequence[str], Sequence[str], Sequence[str]]]
    negations: Sequence[str] = fv.NEGATIONS
    disclaimers: Sequence[str] = fv.DISCLAIMERS
    reach: int = fv.NEGATION_REACH

    def needs_strip(self) -> bool:
        """Whether white space around the text could matter: only to words that have some."""
        phrases = [p for v in self.categories.values() for group in v[1:] for p in group]
        words = [*phrases, *self.negations, *self.disclaimers]
        return any(w != w.strip() for w in words)

    def ordered_categories(self) -> list[tuple[str, int]]:
        return sorted(((c, v[0]) for c, v in self.categories.items()), key=lambda x: x[1])

    def ordered_phrases(self, category: str) -> list[tuple[str, int]]:
        """(phrase, strength 0..2) strongest first, then longest, then as listed."""
        strength: dict[str, int] = {}
        for rank, phrases in enumerate(self.categories[category][1:]):
            for phrase in phrases:
                if phrase:
                    strength.setdefault(phrase, rank)
        return sorted(strength.items(), key=lambda x: (x[1], -len(x[0])))

    def hit_pattern(self, phrase: str) -> str:
        """Expression that finds an occurrence of the phrase that counts."""
        size, reach = len(phrase), self.reach
        checks = []
        for n, words in _by_length(self.negations).items():
            latest = size + reach - n
            if latest >= 0:
                checks.append(f"(?!.{{0,{latest}}}{words})")
            earliest = max(1, n - size - reach)
            if earliest <= reach:
                checks.append(f"(?<!(?={words}).{{{earliest},{reach}}})")
        inside = [f"(?<=(?={d}).{{0,{n - 1}}})" for n, d in _by_length(self.disclaimers).items()]
        if inside:
            checks.append(f"(?!(?:(?:{'|'.join(inside)}).){{{size}}})")
        return f"(?s)(?={_quote(phrase)})" + "".join(checks)


DEFAULT_RULES = PhraseRules(fv.PHRASE_RULES)


def phrase_applies(text: Column | str, phrase: str, rules: PhraseRules = DEFAULT_RULES) -> Column:
    """True when some occurrence is neither disclaimed nor negated."""
    t = as_column(text)
    return t.contains(phrase) & t.rlike(rules.hit_pattern(phrase))


def category_hits(text: Column | str, category: str, rules: PhraseRules = DEFAULT_RULES) -> Column:
    """Applying phrases as array<struct<phrase, strength>>, strongest and longest first."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    phrase_applies(text, phrase, rules),
                    F.struct(F.lit(phrase).alias("phrase"), F.lit(rank).alias("strength")),
                )
                for phrase, rank in rules.ordered_phrases(category)
            ]
        )
    )


def level_name(strength: Column) -> Column:
    return F.when(strength == 0, F.lit("high")).when(strength == 1, F.lit("medium")).otherwise(F.lit("low"))
