"""Status intervals: merging, expansion to days, runs, next-entry labels."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.functions.columns import day_number
from watchpanel.operators.panel import KEYS, by_entity

OPEN_END = dt.date(2099, 12, 31)


def merge_intervals(df: DataFrame, seq: str | None = None) -> DataFrame:
    """Merge overlapping or touching intervals of an entity.

    Takes `entity, entry_date, remove_date` and further columns; a null end is open.  The other
    columns are those of the first row of a merged interval, ties on the entry day broken by
    `seq`.  Rows of one entry day are reduced first, so that the window holds one row per
    entity and day however many raw intervals an entity has.  (An interval that ends before it
    starts covers nothing and is kept as a row of its own.)
    """
    extra = [c for c in df.columns if c not in ("entity", "entry_date", "remove_date")]
    order = F.col(seq) if seq else F.col("remove_date")
    first = F.struct(*extra) if extra else F.struct(F.lit(0).alias("_none"))
    by_day = (
        df.where(F.col("entity").isNotNull() & F.col("entry_date").isNotNull())
        .withColumn("remove_date", F.coalesce("remove_date", F.lit(OPEN_END)))
        .withColumn("_alone", F.when(F.col("remove_date") < F.col("entry_date"), order))
        .groupBy("entity", "entry_date", "_alone")
        .agg(
            F.max("remove_date").alias("remove_date"),
            F.min(order).alias("_order"),
            F.min_by(first, order).alias("_first"),
        )
    )
    ordered = Window.partitionBy("entity").orderBy("entry_date", "_order")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("remove_date").over(before)
    merged = (
        by_day.withColumn("_new", (reached.isNull() | (F.col("entry_date") > reached)).cast("int"))
        .withColumn("_group", F.sum("_new").over(ordered))
        .groupBy("entity", "_group")
        .agg(
            F.min_by(F.col("entry_date"), F.struct("entry_date", "_order")).alias("entry_date"),
            F.max("remove_date").alias("remove_date"),
            F.min_by(F.col("_first"), F.struct("entry_date", "_order")).alias("_first"),
        )
    )
    kept = [F.col(f"_first.{c}").alias(c) for c in extra]
    return merged.select("entity", "entry_date", "remove_date", *kept)


def _explode_days(df: DataFrame, first: Column, last: Column) -> DataFrame:
    """One row per entity and day; days are clamped before they are generated."""
    return (
        df.withColumn("_first_day", first)
        .withColumn("_last_day", last)
        .where(F.col("_first_day") <= F.col("_last_day"))
        .select("entity", F.explode(F.sequence("_first_day", "_last_day")).alias("date"))
    )


def status_days_as_of(df: DataFrame, start: dt.date, end: dt.date, seq: str | None = None) -> DataFrame:
    """Days on which the latest interval entered so far has not ended yet.

    Each entry counts until the day before the next entry of the entity, so days come out once
    and can be equi-joined instead of compared by range.
    """
    order = F.col(seq) if seq else F.col("remove_date")
    entries = (
        df.where(F.col("entry_date").isNotNull())
        .groupBy("entity", "entry_date")
        .agg(F.max_by(F.coalesce("remove_date", F.lit(OPEN_END)), order).alias("remove_date"))
        .withColumn(
            "_next",
            F.lead("entry_date").over(Window.partitionBy("entity").orderBy("entry_date")),
        )
    )
    last = F.least(
        F.col("remove_date"), F.coalesce(F.date_sub("_next", 1), F.lit(end)), F.lit(end)
    )
    return _explode_days(entries, F.greatest("entry_date", F.lit(start)), last)


def status_days_any(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Days covered by any interval; merged first, so overlaps are not generated twice."""
    spans = merge_intervals(df.select("entity", "entry_date", "remove_date"))
    return _explode_days(
        spans, F.greatest("entry_date", F.lit(start)), F.least("remove_date", F.lit(end))
    )


def panel_status(panel: DataFrame, status_days: DataFrame) -> DataFrame:
    """Panel with `y_status` 1 on the given days and 0 elsewhere."""
    marked = status_days.select(*KEYS, F.lit(1).alias("y_status"))
    return panel.join(marked, KEYS, "left").withColumn(
        "y_status", F.coalesce("y_status", F.lit(0))
    )


def day_runs(days: DataFrame, start: str = "start_date", end: str = "end_date") -> DataFrame:
    """Maximal runs of consecutive calendar days per entity, from one row per entity and day."""
    island = F.date_sub("date", F.row_number().over(by_entity()))
    return (
        days.select(*KEYS)
        .withColumn("_island", island)
        .groupBy("entity", "_island")
        .agg(F.min("date").alias(start), F.max("date").alias(end))
        .drop("_island")
    )


def flag_intervals(df: DataFrame, flag: str) -> DataFrame:
    """Runs of flagged rows over consecutive rows of an entity, whatever days they lie on."""
    w = by_entity()
    starts = (F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) == 0)
    return (
        df.select(*KEYS, flag)
        .withColumn("_starts", starts.cast("int"))
        .withColumn("_run", F.sum("_starts").over(w))
        .where(F.col(flag) == 1)
        .groupBy("entity", "_run")
        .agg(F.min("date").alias("entry_date"), F.max("date").alias("remove_date"))
        .drop("_run")
    )


def entry_events(panel: DataFrame) -> DataFrame:
    """Panel with `entry_event`: status 1 after a day with 0; never on the first panel day."""
    before = F.lag("y_status").over(by_entity())
    event = (F.col("y_status") == 1) & (F.coalesce(before, F.col("y_status")) == 0)
    return panel.withColumn("entry_event", event.cast("int"))


def entry_days(status_days: DataFrame, panel_start: dt.date) -> DataFrame:
    """The same events from status days alone: first days of runs, later than the panel start."""
    runs = day_runs(status_days)
    return runs.where(F.col("start_date") > F.lit(panel_start)).select(
        "entity", F.col("start_date").alias("event_date")
    )


def urgency_labels(panel: DataFrame, entries: DataFrame) -> DataFrame:
    """Add `label`: 1 / days to the next entry, 0 without one, null while in-status.

    `entries` holds `entity, entry_date`.  Entries are put between the panel rows and looked
    back at in descending order, so each label costs one running value.
    """
    rows = panel.select(*KEYS, "y_status").withColumn("_entry", F.lit(None).cast("date"))
    marks = entries.select(
        "entity",
        F.col("entry_date").alias("date"),
        F.lit(None).cast("int").alias("y_status"),
        F.col("entry_date").alias("_entry"),
    ).distinct()
    later = (
        Window.partitionBy("entity")
        .orderBy(F.desc("_day"))
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    days_left = F.datediff("_next", "date")
    label = F.when(F.col("y_status") == 1, F.lit(None).cast("double")).otherwise(
        F.coalesce(F.lit(1.0) / days_left, F.lit(0.0))
    )
    return (
        rows.unionByName(marks)
        .withColumn("_day", day_number("date"))
        .withColumn("_next", F.min("_entry").over(later))
        .where(F.col("_entry").isNull())
        .withColumn("label", label)
        .select(*KEYS, "y_status", "label")
    )
