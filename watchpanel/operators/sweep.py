"""Parameter sweeps as data-parallel jobs."""

from __future__ import annotations

import datetime as dt
import itertools
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel.operators.evaluate import in_label_band, with_daily_ratios
from watchpanel.operators.panel import calendar, in_range
from watchpanel.params import ModelParams
from watchpanel.sources.storage import materialize

_TOLERANCE = 1e-9

# Default search ranges of the model sweep: lowest and highest value, and how values are drawn
SEARCH_RANGES = {
    "zero_ratio": (2.0, 10.0, "even"),
    "label_threshold": (0.001, 0.05, "log"),
    "max_iter": (80, 250, "whole"),
    "step_size": (0.01, 0.2, "log"),
    "max_depth": (4, 6, "whole"),
}


def rule_grid(
    entries: Sequence[float], retains: Sequence[float], decays: Sequence[float]
) -> list[tuple[int, float, float, float]]:
    """(grid_id, entry, retain, decay) for the combinations with retain not above entry."""
    combos = [c for c in itertools.product(entries, retains, decays) if c[1] <= c[0]]
    return [(i, float(e), float(r), float(d)) for i, (e, r, d) in enumerate(combos)]


def with_rule_grid(df: DataFrame, grid: Sequence[tuple[int, float, float, float]]) -> DataFrame:
    """Each row once per grid point, generated in place from a literal list."""
    points = F.array(
        *[
            F.struct(
                F.lit(i).alias("grid_id"), F.lit(e).alias("entry"),
                F.lit(r).alias("retain"), F.lit(d).alias("decay"),
            )
            for i, e, r, d in grid
        ]
    )
    return df.withColumn("_point", F.explode(points)).select(*df.columns, "_point.*")


#: entity-days that a task holds as matrices at once
MATRIX_CELLS = 1 << 19


def _grid_counts(
    values: np.ndarray, status: np.ndarray, events: np.ndarray, grid: Sequence[tuple[int, float, float, float]],
    inside: np.ndarray, min_lead: int, horizon: int,
) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(grid_id, listed per day, correct per day, matched events) over entities (rows) and days (columns).

    All values of a memory fall alike, so its level is the running maximum of value + decay x day; that
    maximum is taken once for a decay, whatever the thresholds.  An entry or retain threshold only moves
    the days at which the level is interrupted and those that start it anew, which are running maxima too.
    """
    n, days = values.shape
    day = np.arange(days, dtype=np.float64)
    none = np.full((n, 1), -1)
    for decay in dict.fromkeys(p[3] for p in grid):
        best = np.maximum.accumulate(np.where(values > 0, values + decay * day, -np.inf), axis=1)
        level = best - decay * day
        before = np.hstack([np.full((n, 1), -np.inf), level[:, :-1]])
        for retain in dict.fromkeys(p[2] for p in grid if p[3] == decay):
            low = level < retain - _TOLERANCE
            cut = low | (before < retain - _TOLERANCE) | (before - decay <= 0)
            last_cut = np.maximum.accumulate(np.where(cut, day, -1), axis=1)
            for grid_id, entry, _, _ in (p for p in grid if p[2] == retain and p[3] == decay):
                last_enter = np.maximum.accumulate(np.where(values >= entry, day, -2), axis=1)
                # a live memory of no risk at all is none
                listed = ~low & (level > 0) & (last_enter >= last_cut) & ~status
                starts = listed & ~np.hstack([none > 0, listed[:, :-1]])
                first = np.maximum.accumulate(np.where(starts, day, -1), axis=1)
                # a run that ends the day before an event, early enough
                last = listed[:, :-1] & ~listed[:, 1:] & events[:, 1:]
                lead = day[1:] - first[:, :-1]
                rows, ends = np.nonzero(last & (lead >= min_lead) & (lead <= horizon) & inside[1:])
                change = np.zeros(days + 1, dtype=np.int64)
                np.add.at(change, first[rows, ends].astype(np.int64), 1)
                np.add.at(change, ends + 1, -1)
                yield grid_id, listed.sum(axis=0), np.cumsum(change[:-1]), len(rows)


def sweep_rules(
    scores: DataFrame,
    status_days: DataFrame,
    events: DataFrame,
    grid: Sequence[tuple[int, float, float, float]],
    *,
    output: tuple[dt.date, dt.date],
    min_lead: int,
    horizon: int,
    market_n: int,
) -> DataFrame:
    """Mean list size, recall, accuracy and false-positive rate of every rule setting, in one job.

    `scores` has one row per entity and day.  The scored days, in-status days and events of an entity
    meet once, as lists of days; the grid is evaluated beside them, and a task hands on one count for
    each grid point and day.  So what is shuffled does not depend on the number of thresholds.
    """
    edge = scores.where(F.col("score") > 0).agg(F.min("date")).first()[0]
    start = min(edge or output[0], output[0])
    days = (output[1] - start).days + 1

    def place(c: str) -> Column:
        return F.datediff(F.col(c), F.lit(start))

    def lists(df: DataFrame, date: str, name: str) -> DataFrame:
        near = df.where(F.col(date).between(F.lit(start), F.lit(output[1])))
        return near.groupBy("entity").agg(F.collect_set(place(date)).alias(name))

    scored = (
        scores.where((F.col("score") > 0) & F.col("date").between(F.lit(start), F.lit(output[1])))
        .groupBy("entity")
        .agg(F.collect_list(F.struct(place("date").alias("day"), F.col("score").cast("double").alias("v"))).alias("scored"))
        .select("entity", F.col("scored.day").alias("days"), F.col("scored.v").alias("values"))
    )
    packed = scored.join(lists(status_days, "date", "status"), "entity", "left").join(
        lists(events, "event_date", "events"), "entity", "left"
    )
    inside = np.arange(days) >= (output[0] - start).days

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = {p[0]: np.zeros(days, dtype=np.int64) for p in grid}
        correct = {p[0]: np.zeros(days, dtype=np.int64) for p in grid}
        hits = {p[0]: 0 for p in grid}
        step = max(1, MATRIX_CELLS // days)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                matrix = np.zeros((part.num_rows, days))
                flags = np.zeros((2, part.num_rows, days), dtype=bool)
                at_days, at_values, *marks = (part.column(c).to_pylist() for c in ("days", "values", "status", "events"))
                for i, (d, v) in enumerate(zip(at_days, at_values)):
                    np.maximum.at(matrix[i], d, v)
                for k, mark in enumerate(marks):
                    for i, d in enumerate(mark):
                        if d:
                            flags[k, i, d] = True
                for grid_id, n, right, met in _grid_counts(matrix, *flags, grid, inside, min_lead, horizon):
                    listed[grid_id] += n
                    correct[grid_id] += right
                    hits[grid_id] += met
        rows = [(g, int(d), int(listed[g][d]), int(correct[g][d]), 0) for g in listed for d in np.flatnonzero(inside & ((listed[g] > 0) | (correct[g] > 0)))]
        rows += [(g, None, 0, 0, n) for g, n in hits.items() if n]
        columns = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["grid_id", "day", "listed_cnt", "correct_cnt", "hit_events"]
        )

    schema = "grid_id long, day long, listed_cnt long, correct_cnt long, hit_events long"
    counts = packed.select("days", "values", "status", "events").mapInArrow(run, schema)
    # read for the days and for the events: a row for each task, grid point and day
    counts = materialize(counts.groupBy("grid_id", "day").agg(*[F.sum(c).alias(c) for c in ("listed_cnt", "correct_cnt", "hit_events")]))
    per_day = counts.where("day is not null").select(
        F.col("grid_id").cast("int").alias("grid_id"), F.date_add(F.lit(start), F.col("day").cast("int")).alias("date"),
        "listed_cnt", "correct_cnt",
    )
    status = in_range(status_days, *output).groupBy("date").agg(F.count(F.lit(1)).alias("status_cnt"))
    # grid points x days rows: a small skeleton, so that empty days count too
    skeleton = with_rule_grid(calendar(scores.sparkSession, *output), grid)
    daily = (
        skeleton.join(per_day, ["grid_id", "date"], "left")
        .join(status, "date", "left")
        .withColumns(
            {c: F.coalesce(c, F.lit(0)) for c in ("listed_cnt", "correct_cnt", "status_cnt")}
        )
    )
    means = with_daily_ratios(daily, market_n).groupBy("grid_id", "entry", "retain", "decay").agg(
        F.avg("listed_cnt").alias("avg_list_size"),
        F.avg("daily_acc").alias("acc"),
        F.avg("daily_fpr").alias("fpr"),
    )
    # runs of an entity do not touch, so an event is matched by one run at most
    hits = counts.where("day is null").select(F.col("grid_id").cast("int").alias("grid_id"), "hit_events")
    total = in_range(events, *output, column="event_date").count()
    return means.join(hits, "grid_id", "left").select(
        "grid_id", "entry", "retain", "decay", "avg_list_size", "acc", "fpr",
        F.coalesce("hit_events", F.lit(0)).alias("hit_events"),
        F.lit(total).cast("bigint").alias("total_events"),
        F.when(F.lit(total) > 0, F.coalesce("hit_events", F.lit(0)) / F.lit(total)).alias("recall"),
    )


def best_within_budget(results: DataFrame, budget: float) -> DataFrame:
    """Settings within the mean list size, best recall first."""
    return results.where(F.col("avg_list_size") <= budget).orderBy(
        F.desc("recall"), "avg_list_size", "grid_id"
    )


def sweep_thresholds(
    scored: DataFrame, thresholds: Sequence[float], *, min_lead: int, horizon: int, market_n: int
) -> DataFrame:
    """Accuracy, false-positive rate and their difference for many listing thresholds at once.

    Takes panel rows with `predicted_label_value`, `y_status`, `st_label_value`.  A row is
    counted for the thresholds it reaches; the counts per day and threshold are all that is
    shuffled.
    """
    points = sorted(float(t) for t in thresholds)
    band = in_label_band("st_label_value", min_lead, horizon)
    predicted = F.col("predicted_label_value").cast("float")
    reached = F.array_compact(
        F.array(*[F.when(predicted >= F.lit(t).cast("float"), F.lit(t)) for t in points])
    )
    listed = (
        scored.where((F.col("y_status") == 0) & (predicted >= F.lit(points[0]).cast("float")))
        .select("date", band.alias("band"), F.explode(reached).alias("threshold"))
        .groupBy("threshold", "date")
        .agg(
            F.count(F.lit(1)).alias("listed_cnt"),
            F.count_if("band").alias("correct_cnt"),
        )
    )
    days = scored.groupBy("date").agg(F.count_if(F.col("y_status") == 1).alias("status_cnt"))
    skeleton = days.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in points])))
    daily = skeleton.join(listed, ["threshold", "date"], "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("listed_cnt", "correct_cnt")}
    )
    means = with_daily_ratios(daily, market_n).groupBy("threshold").agg(
        F.avg("listed_cnt").alias("avg_list_size"),
        F.avg("daily_acc").alias("acc"),
        F.avg("daily_fpr").alias("fpr"),
    )
    objective = F.coalesce("acc", F.lit(0.0)) - F.coalesce("fpr", F.lit(1.0))
    return means.withColumn("objective", objective)


def sweep_models(
    fit_and_score: Callable[[ModelParams], DataFrame],
    base: ModelParams,
    trials: Iterable[Mapping[str, float]],
    thresholds: Sequence[float],
) -> DataFrame:
    """All thresholds for each training setting, stacked.

    Training settings are fitted one after another, each a distributed job; thresholds never
    need another fit.
    """
    from dataclasses import replace

    results = None
    for i, trial in enumerate(trials):
        params = replace(base, **trial)
        scored = sweep_thresholds(
            fit_and_score(params),
            thresholds,
            min_lead=params.min_lead_days,
            horizon=params.horizon_days,
            market_n=params.market_n,
        ).withColumn("trial", F.lit(i))
        for name in ("zero_ratio", "max_iter", "step_size", "max_depth"):
            scored = scored.withColumn(name, F.lit(getattr(params, name)))
        results = scored if results is None else results.unionByName(scored)
    if results is None:
        raise ValueError("no trials given")
    return results
