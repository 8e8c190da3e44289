"""Evaluation of watchlists against status entries, from sparse listing and status days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.functions.columns import day_number
from watchpanel.operators.intervals import day_runs
from watchpanel.operators.panel import KEYS, calendar, in_range


def match_runs(
    listed: DataFrame,
    events: DataFrame,
    *,
    min_lead: int,
    horizon: int,
    output: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """Listing runs that end the day before an entry event, with an allowed lead.

    `listed` holds the effective listing days, `events` holds `entity, event_date`.  In-status
    days are not listed, so a run that led to an event always ends right before it and the
    match is an equi-join.  `output` limits the events that count.
    """
    if output is not None:
        events = in_range(events, *output, column="event_date")
    runs = day_runs(listed).withColumn("event_date", F.date_add("end_date", 1))
    lead = F.datediff("event_date", "start_date")
    return (
        runs.join(events.select("entity", "event_date"), ["entity", "event_date"])
        .withColumn("lead_days", lead)
        .where(F.col("lead_days").between(min_lead, horizon))
        .select("entity", "start_date", "end_date", "event_date", "lead_days")
    )


def matched_days(matches: DataFrame) -> DataFrame:
    """All days of the matched runs."""
    return matches.select(
        "entity", F.explode(F.sequence("start_date", "end_date")).alias("date")
    )


def in_label_band(label: str, min_lead: int, horizon: int) -> Column:
    """Whether 1/horizon <= label <= 1/min_lead, compared in float precision; null is not."""
    low = F.lit(1.0 / horizon if horizon > 0 else float("inf")).cast("float")
    high = F.lit(1.0 / min_lead if min_lead > 0 else float("inf")).cast("float")
    return F.coalesce(F.col(label).cast("float").between(low, high), F.lit(False))


def label_band_correct(
    df: DataFrame, *, min_lead: int, horizon: int, label: str = "st_label_value"
) -> DataFrame:
    """Add `correct`: listed, not in-status, and the label within the band, in float precision."""
    effective = (F.col("predicted_listing") == 1) & (F.col("y_status") == 0)
    correct = effective & in_label_band(label, min_lead, horizon)
    return df.withColumn("effective", effective.cast("int")).withColumn(
        "correct", correct.cast("int")
    )


def event_recall(
    df: DataFrame, *, min_lead: int, horizon: int
) -> DataFrame:
    """Entry events with `hit`: some effective listing min_lead..horizon days before.

    Takes panel rows with `effective` and `entry_event`.  Only listing and event rows matter;
    the latest listing early enough is one running maximum.
    """
    rows = df.where((F.col("effective") == 1) | (F.col("entry_event") == 1)).withColumn(
        "_day", day_number("date")
    )
    early = (
        Window.partitionBy("entity")
        .orderBy("_day")
        .rangeBetween(Window.unboundedPreceding, -min_lead)
    )
    latest = F.max(F.when(F.col("effective") == 1, F.col("_day"))).over(early)
    hit = F.coalesce(F.col("_latest") >= F.col("_day") - horizon, F.lit(False))
    return (
        rows.withColumn("_latest", latest)
        .where(F.col("entry_event") == 1)
        .select("entity", F.col("date").alias("event_date"), hit.cast("int").alias("hit"))
    )


def with_daily_ratios(counts: DataFrame, market_n: int) -> DataFrame:
    listed, correct, status = F.col("listed_cnt"), F.col("correct_cnt"), F.col("status_cnt")
    others = F.lit(market_n) - status - correct
    return counts.withColumn(
        "daily_acc", F.when(listed > 0, correct / listed)
    ).withColumn("daily_fpr", F.when(others > 0, (listed - correct) / others))


def daily_metrics(
    listed: DataFrame,
    correct: DataFrame,
    status: DataFrame,
    *,
    output: tuple[dt.date, dt.date],
    market_n: int,
) -> DataFrame:
    """Counts and ratios of each output day, from listing, correct and in-status days.

    The three sets are stacked and counted in one aggregation with map-side combine.
    """
    def marked(df: DataFrame, kind: int) -> DataFrame:
        return in_range(df, *output).select("date", F.lit(kind).alias("_kind"))

    def number(kind: int) -> Column:
        return F.count_if(F.col("_kind") == kind)

    names = ("listed_cnt", "correct_cnt", "status_cnt")
    counts = (
        marked(listed, 0)
        .unionByName(marked(correct, 1))
        .unionByName(marked(status, 2))
        .groupBy("date")
        .agg(*[number(i).alias(n) for i, n in enumerate(names)])
    )
    days = calendar(listed.sparkSession, *output)
    filled = days.join(counts, "date", "left").select(
        "date", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )
    return with_daily_ratios(filled, market_n)


def daily_metrics_from_panel(df: DataFrame, market_n: int) -> DataFrame:
    """The same from panel rows with `effective`, `correct`, `y_status`."""
    counts = df.groupBy("date").agg(
        F.count_if(F.col("effective") == 1).alias("listed_cnt"),
        F.count_if(F.col("correct") == 1).alias("correct_cnt"),
        F.count_if(F.col("y_status") == 1).alias("status_cnt"),
    )
    return with_daily_ratios(counts, market_n)


def overall_metrics(daily: DataFrame, events: DataFrame, settings: dict | None = None) -> DataFrame:
    """One row: mean accuracy and false-positive rate, recall, list size, and the settings.

    `events` holds one row per entry event with `hit` 0/1.  Both inputs are reduced to one row
    and added up.
    """
    means = daily.agg(
        F.avg("daily_acc").alias("acc"),
        F.avg("daily_fpr").alias("fpr"),
        F.avg("listed_cnt").alias("avg_list_size"),
    )
    nothing = F.lit(None)
    rows = means.select(
        "acc", "fpr", "avg_list_size",
        nothing.cast("bigint").alias("total_events"), nothing.cast("bigint").alias("hit_events"),
    ).unionByName(
        events.agg(
            F.count(F.lit(1)).alias("total_events"),
            F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("hit_events"),
        ).select(
            *[nothing.cast("double").alias(c) for c in ("acc", "fpr", "avg_list_size")],
            "total_events",
            "hit_events",
        )
    )
    result = rows.agg(*[F.max(c).alias(c) for c in rows.columns]).withColumn(
        "recall",
        F.when(F.col("total_events") > 0, F.col("hit_events") / F.col("total_events")),
    )
    for name, value in (settings or {}).items():
        result = result.withColumn(name, F.lit(value))
    return result


def regression_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Mean absolute and root mean squared error."""
    diff = F.col(truth) - F.col(predicted)
    return df.agg(
        F.avg(F.abs(diff)).alias("mae"), F.sqrt(F.avg(diff * diff)).alias("rmse")
    )
