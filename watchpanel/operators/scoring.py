"""Batch scoring of texts with a pluggable scorer, and placing the results on the panel."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchpanel import fixed_values as fv
from watchpanel.functions.outputs import with_parsed_dims, with_parsed_score
from watchpanel.functions.text import keep_tail
from watchpanel.operators.panel import KEYS, dense_fill, latest_per_key

Scorer = Callable[[Sequence[str]], Sequence[str]]


@dataclass(frozen=True)
class ColumnScorer:
    """A scorer that is an expression over the text: no Python worker takes part."""

    answer: Callable[[Column], Column]


def _points(text: Column, words: Sequence[str], points: int) -> Column:
    found = sum((text.contains(w).cast("int") for w in words), F.lit(0))
    return F.least(F.lit(100), F.lit(points) * found).cast("string")


def keyword_answers(keywords: Sequence[str] = fv.RULE_KEYWORDS, points: int = 20) -> ColumnScorer:
    """`KeywordScorer` as an expression."""
    return ColumnScorer(lambda t: F.concat(F.lit('{"risk_score": '), _points(t, keywords, points), F.lit("}")))


def dim_keyword_answers(keywords: Mapping[str, Sequence[str]], points: int = 20) -> ColumnScorer:
    """`DimKeywordScorer` as an expression."""
    def answer(t: Column) -> Column:
        fields = [F.concat(F.lit(f'"{d}": '), _points(t, words, points)) for d, words in keywords.items()]
        return F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))

    return ColumnScorer(answer)


class KeywordScorer:
    """Rule scorer: 20 points per different keyword, answered as the JSON a model would give."""

    def __init__(self, keywords: Sequence[str] = fv.RULE_KEYWORDS, points: int = 20) -> None:
        self.keywords = tuple(keywords)
        self.points = points

    def __call__(self, texts: Sequence[str]) -> list[str]:
        return [
            json.dumps({"risk_score": min(100, self.points * sum(k in t for k in self.keywords))})
            for t in texts
        ]


class DimKeywordScorer:
    """Rule scorer for several dimensions: points per different keyword of each one."""

    def __init__(self, keywords: Mapping[str, Sequence[str]], points: int = 20) -> None:
        self.keywords = {dim: tuple(words) for dim, words in keywords.items()}
        self.points = points

    def _answer(self, text: str) -> str:
        found = {d: sum(k in text for k in words) for d, words in self.keywords.items()}
        return json.dumps({d: min(100, self.points * n) for d, n in found.items()})

    def __call__(self, texts: Sequence[str]) -> list[str]:
        return [self._answer(t) for t in texts]


def score_texts(
    df: DataFrame,
    make_scorer: Callable[[], Scorer] | ColumnScorer,
    *,
    text: str = "text",
    batch_size: int = 4,
    parts: int | None = None,
) -> DataFrame:
    """Run a scorer over a text column; adds its answers as `raw_output`.

    `make_scorer` is called once per task, so a model is loaded once for all its batches.  With
    `parts`, rows are dealt out evenly first: scoring cost does not depend on the key, so hot
    entities do not matter.  A `ColumnScorer` is an expression and stays where the texts are.
    """
    if isinstance(make_scorer, ColumnScorer):
        return df.withColumn("raw_output", make_scorer.answer(F.coalesce(F.col(text), F.lit(""))))
    # `add` would change the frame's own schema
    schema = T.StructType([*df.schema.fields, T.StructField("raw_output", T.StringType())])
    rows = df.repartition(parts) if parts else df

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for frame in frames:
            texts = frame[text].fillna("").tolist()
            answers: list[str] = []
            for i in range(0, len(texts), batch_size):
                answers.extend((a or "").strip() for a in scorer(texts[i : i + batch_size]))
            yield frame.assign(raw_output=answers)

    return rows.mapInPandas(run, schema)


def scoring_results(scored: DataFrame, dims: Sequence[str] | None = None) -> DataFrame:
    """`entity, date`, the parsed score or scores, and `parse_ok`."""
    if dims is None:
        return with_parsed_score(scored, "raw_output").select(*KEYS, "risk_score", "parse_ok")
    return with_parsed_dims(scored, "raw_output", dims).select(*KEYS, *dims, "parse_ok")


def debug_rows(scored: DataFrame, text: str = "text", trunc: int = 1200) -> DataFrame:
    """Scoring log: tails of text and answer, parse result and error."""
    parsed = with_parsed_score(scored, "raw_output")
    return parsed.select(
        *KEYS,
        keep_tail(text, 600).alias("text_tail"),
        F.length(text).alias("text_chars"),
        keep_tail("raw_output", trunc).alias("raw_output_trunc"),
        "parse_ok",
        "risk_score",
        "parse_error",
    )


def scoring_summary(results: DataFrame, *, by_task: bool = False) -> DataFrame:
    """Totals, successes, failures and success rate, over all rows or per task."""
    rows = results.withColumn("task", F.spark_partition_id()) if by_task else results
    grouped = rows.groupBy("task") if by_task else rows.groupBy()
    n = F.count(F.lit(1))
    ok = F.count_if("parse_ok")
    return grouped.agg(
        n.alias("n_total"),
        ok.alias("n_parse_ok"),
        (n - ok).alias("n_parse_fail"),
        F.when(n > 0, ok / n).otherwise(F.lit(0.0)).alias("parse_ok_rate"),
    )


def place_results_dense(
    entities: DataFrame,
    results: DataFrame,
    columns: Sequence[str],
    start: dt.date,
    end: dt.date,
    order: str | None = None,
) -> DataFrame:
    """The same on the dense panel of the entities, without shuffling the panel."""
    unique = _unique(results, columns, order)
    values = unique.select(*KEYS, *[F.col(c).cast("float").alias(c) for c in columns])
    return dense_fill(entities, values, {c: None for c in columns}, start, end)


def _unique(results: DataFrame, columns: Sequence[str], order: str | None) -> DataFrame:
    if order is None:
        return results
    return latest_per_key(results.select(*KEYS, *columns, order), order)


def place_results(
    panel: DataFrame, results: DataFrame, columns: Sequence[str], order: str | None = None
) -> DataFrame:
    """Left join results to the panel, null where a day was not scored.

    With `order`, the last result of a key wins.
    """
    unique = _unique(results, columns, order)
    return panel.join(
        unique.select(*KEYS, *[F.col(c).cast("float").alias(c) for c in columns]), KEYS, "left"
    )
