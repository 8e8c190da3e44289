"""Rule track: scores or documents to watchlists and their evaluation.

Everything after the scores works on the days that carry risk: scored days, days with a live
memory, in-status days.  The dense entity-by-day panel is never built here.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import row_max
from watchpanel.operators.documents import daily_text, lookback_text, select_plain, select_prefiltered, with_first_day
from watchpanel.operators.evaluate import daily_metrics, match_runs, matched_days, overall_metrics
from watchpanel.operators.intervals import entry_days, status_days_any
from watchpanel.operators.memory import cut_stale, forward_fill, memory_days
from watchpanel.operators.panel import KEYS, in_range, universe
from watchpanel.operators.scoring import (
    ColumnScorer, Scorer, keyword_answers, place_results_dense, score_texts, scoring_results,
)
from watchpanel.operators.watchlist import listed_rows, ranked, reasoned_rows
from watchpanel.params import RuleParams
from watchpanel.sources.answers import AnswerStore
from watchpanel.sources.storage import materialize


@dataclass
class RuleRun:
    """One run: days with a live memory, in-status days, and what follows from them on demand."""

    alive: DataFrame
    status_days: DataFrame
    params: RuleParams
    panel_start: dt.date

    @property
    def output(self) -> tuple[dt.date, dt.date]:
        return self.params.output_start, self.params.output_end

    @cached_property
    def listed(self) -> DataFrame:
        """`entity, date, score` of the listed days."""
        return listed_rows(
            self.alive,
            self.params.retain,
            top_k=self.params.top_k,
            status_days=self.status_days,
            output=self.output,
        ).select(*KEYS, "score")

    @cached_property
    def _kept(self) -> DataFrame:
        return materialize(self.listed)

    def watchlist(self) -> DataFrame:
        """`date, rank, entity, score`."""
        return ranked(self.__dict__.get("_kept", self.listed))

    def reasoned(self, daily: DataFrame) -> DataFrame:
        """The watchlist with integer scores and the text of the day."""
        return reasoned_rows(self.watchlist(), daily)

    @cached_property
    def evaluation(self) -> RuleEvaluation:
        """Matches, daily and overall metrics.

        The listed and in-status days are a small part of the panel and are used several times
        each, so they are computed once first.
        """
        p, output = self.params, self.output
        listed, status = self._kept.select(*KEYS), materialize(self.status_days)
        events = entry_days(status, self.panel_start)
        matches = match_runs(
            listed,
            events,
            min_lead=p.min_lead_days,
            horizon=p.horizon_days,
            output=output if p.only_events_in_output else None,
        )
        daily = daily_metrics(
            listed, matched_days(matches), status, output=output, market_n=p.market_n
        )
        hits = matches.select("entity", "event_date", F.lit(1).alias("hit"))
        counted = (
            in_range(events, *output, column="event_date")
            .join(hits, ["entity", "event_date"], "left")
            .withColumn("hit", F.coalesce("hit", F.lit(0)))
        )
        settings = {
            "threshold": p.retain,
            "market_n": p.market_n,
            "horizon_days": p.horizon_days,
            "min_lead_days": p.min_lead_days,
            "only_events_in_output": p.only_events_in_output,
            "output_start": output[0],
            "output_end": output[1],
        }
        return RuleEvaluation(events, matches, daily, overall_metrics(daily, counted, settings))


@dataclass(frozen=True)
class RuleEvaluation:
    events: DataFrame
    matches: DataFrame
    daily: DataFrame
    metrics: DataFrame


def daily_max(scores: DataFrame, dims=fv.DIMS) -> DataFrame:
    """Highest of the four dimensions per entity and day."""
    return (
        scores.withColumn("score", row_max(*dims).cast("double"))
        .groupBy(*KEYS)
        .agg(F.max("score").alias("score"))
    )


def run_from_scores(scores: DataFrame, intervals: DataFrame, params: RuleParams) -> RuleRun:
    """Four-dimension score rows and status intervals to watchlist and metrics."""
    output = (params.output_start, params.output_end)
    daily = daily_max(scores.where(F.col("date").between(*[F.lit(x) for x in output])))
    alive = memory_days(
        daily, decay=params.decay, entry=params.entry, retain=params.retain, end=params.output_end
    )
    known = universe(scores)
    status = status_days_any(intervals, *output).join(known, "entity", "left_semi")
    return RuleRun(alive, status, params, params.output_start)


def _scored(tasks: DataFrame, make_scorer, parts: int | None, store: AnswerStore | None) -> DataFrame:
    if store is not None:
        return store.score(tasks, make_scorer, parts=parts)
    return score_texts(tasks, make_scorer, parts=parts)


def run_from_documents(
    documents: DataFrame,
    intervals: DataFrame,
    params: RuleParams,
    make_scorer: Callable[[], Scorer] | ColumnScorer = keyword_answers(),
    *,
    warmup: bool = False,
    scorer_parts: int | None = None,
    first_day_all: bool = False,
    use_daily_text: bool = True,
    store: AnswerStore | None = None,
) -> tuple[RuleRun, DataFrame]:
    """Documents and status intervals to watchlist and metrics; also returns the daily texts.

    The lookback days are scored too; the memory starts empty on the first output day unless
    `warmup` lets them count.  Daily texts and scores are kept in shared storage: documents are read once and every
    text is scored once, whatever is asked for afterwards.  `first_day_all` scores every entity on the
    first output day, whatever the prefilter says; the scorer reads the lookback text unless
    `use_daily_text`.  With a `store`, texts that it has good answers for are not scored again.
    """
    output = (params.output_start, params.output_end)
    first = params.output_start - dt.timedelta(days=params.text.lookback_days)
    daily = materialize(daily_text(documents, first, params.output_end, params.text))
    rows = daily
    if first_day_all:
        known = universe(documents) if intervals is None else universe(documents, intervals)
        rows = with_first_day(rows, known, output[0])
    if not use_daily_text:
        rows = lookback_text(rows, params.text.lookback_days)
    tasks = select_prefiltered(
        rows, output, params.prefilter, use_daily_text=use_daily_text, first_day_all=first_day_all
    )
    results = materialize(scoring_results(_scored(tasks, make_scorer, scorer_parts, store)))
    scores = results.select(*KEYS, F.col("risk_score").cast("double").alias("score"))
    if not warmup:
        scores = scores.where(F.col("date") >= F.lit(params.output_start))
    alive = memory_days(
        scores,
        decay=params.decay,
        entry=params.entry,
        retain=params.retain,
        start=params.output_start,
        end=params.output_end,
    )
    status = status_days_any(intervals, first, params.output_end)
    return RuleRun(alive, status, params, first), daily


def filled_scores(
    documents: DataFrame,
    params: RuleParams,
    make_scorer: Callable[[], Scorer] | ColumnScorer = keyword_answers(),
    *,
    intervals: DataFrame | None = None,
    dims: Sequence[str] | None = None,
    fill: bool = True,
    max_days: int | None = 30,
    scorer_parts: int | None = None,
    first_day_all: bool = False,
    store: AnswerStore | None = None,
) -> DataFrame:
    """The plain scheme: score the lookback text of document days, carry scores forward.

    Returns the dense output panel with `score`, or with `dims` when the scorer gives several
    dimensions.  Entities of `intervals` without documents belong to the panel too.  `first_day_all`
    scores the lookback text of every entity on the first output day, so that scores reach back; with a
    `store`, texts that it has good answers for are not scored again.
    """
    output = (params.output_start, params.output_end)
    first = params.output_start - dt.timedelta(days=params.text.lookback_days)
    known = universe(documents) if intervals is None else universe(documents, intervals)
    daily = daily_text(documents, first, output[1], params.text)
    if first_day_all:
        daily = with_first_day(materialize(daily), known, output[0])
    tasks = select_plain(lookback_text(daily, params.text.lookback_days), output, first_day_all=first_day_all)
    # every text is scored once
    results = materialize(scoring_results(_scored(tasks, make_scorer, scorer_parts, store), dims))
    columns = ["score"] if dims is None else list(dims)
    if dims is None:
        results = results.withColumnRenamed("risk_score", "score")
    placed = place_results_dense(known, results, columns, *output)
    if not fill:
        return placed
    marked = placed.withColumn("_scored", F.col(columns[0]).isNotNull())
    return cut_stale(forward_fill(marked, columns), columns, "_scored", max_days).drop("_scored")
