"""Daily watchlists and their shapes."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.functions.columns import int_score, or_placeholder
from watchpanel.operators.ordering import with_position
from watchpanel.operators.panel import KEYS, calendar

# Spark prunes rank filters before the shuffle up to this limit (spark.sql.optimizer.windowGroupLimitThreshold)
_PRUNED_LIMIT = 1000


def eligible(df: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """Rows at or above the threshold; missing scores never are."""
    return df.where(F.col(score) >= threshold)


def top_per_day(df: DataFrame, k: int, score: str = "score") -> DataFrame:
    """The k highest scores of each day, ties by entity.

    Small k: a rank filter, pruned in each task before the shuffle.  Large k: exact positions
    over ranges, so that one day is never sorted in one task.
    """
    if k <= 0:
        return df.limit(0)
    order = [F.desc(score), F.col("entity")]
    if k <= _PRUNED_LIMIT:
        rank = F.row_number().over(Window.partitionBy("date").orderBy(*order))
        return df.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")
    placed = with_position(df, order, "_rank", group=["date"])
    return placed.where(F.col("_rank") < k).drop("_rank")


def without_status(df: DataFrame, status_days: DataFrame) -> DataFrame:
    """Drop rows on days the entity is in-status."""
    return df.join(status_days.select(*KEYS), KEYS, "left_anti")


def listed_rows(
    df: DataFrame,
    threshold: float,
    *,
    top_k: int | None = None,
    status_days: DataFrame | None = None,
    output: tuple[dt.date, dt.date] | None = None,
    score: str = "score",
) -> DataFrame:
    """Rows on the watchlist: eligible, in the day's top k, and not in-status.

    The top k is taken before in-status rows are dropped, so a day can list fewer than k.
    In-status comes from `status_days`, or from a `y_status` column when that is not given.
    """
    rows = df
    if output is not None:
        rows = rows.where(F.col("date").between(F.lit(output[0]), F.lit(output[1])))
    rows = eligible(rows, threshold, score)
    if top_k is not None:
        rows = top_per_day(rows, top_k, score)
    if status_days is not None:
        return without_status(rows, status_days)
    return rows.where(F.col("y_status") == 0)


def ranked(listed: DataFrame, score: str = "score") -> DataFrame:
    """Add `rank` 1, 2, ... of each day, by score descending, then entity.

    Exact for days of any size: see `operators.ordering`.
    """
    placed = with_position(listed, [F.desc(score), F.col("entity")], "rank", group=["date"])
    return placed.withColumn("rank", F.col("rank") + 1)


def daily_arrays(
    ranked_rows: DataFrame,
    start: dt.date,
    end: dt.date,
    *,
    element: Column | None = None,
    part_size: int = 100_000,
) -> DataFrame:
    """`date, part, entities`: the list of each day, an empty one for days without rows.

    A day longer than `part_size` continues in further parts, so that no array grows without
    bound; parts in order make the list.  A row of another day or without a rank is an error: left out,
    its day would look like one without it.
    """
    item = F.col("entity") if element is None else element
    placed = F.col("date").between(F.lit(start), F.lit(end)) & (F.col("rank") >= 1)
    part = F.when(placed, F.floor((F.col("rank") - 1) / part_size).cast("int")).otherwise(
        F.raise_error(F.concat_ws(" ", F.lit(f"not a ranked row of {start} to {end}: date"), "date", F.lit("rank"), "rank"))
    )
    parts = (
        ranked_rows.withColumn("part", part)
        .groupBy("date", "part")
        .agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("_items"))
        .select("date", "part", F.transform("_items", lambda x: x["item"]).alias("entities"))
    )
    item_type = parts.schema["entities"].dataType
    days = calendar(ranked_rows.sparkSession, start, end)
    return days.join(parts, "date", "left").select(
        "date",
        F.coalesce("part", F.lit(0)).alias("part"),
        F.coalesce("entities", F.array().cast(item_type)).alias("entities"),
    )


def reasoned_rows(ranked_rows: DataFrame, daily: DataFrame, score: str = "score") -> DataFrame:
    """`date, rank, entity, risk_score, is_st, ann_daily` of the listed rows.

    `is_st` is 0 by construction; it is part of the format.
    """
    joined = ranked_rows.join(daily.select(*KEYS, "doc_text"), KEYS, "left")
    return joined.select(
        "date",
        "rank",
        "entity",
        int_score(score).alias("risk_score"),
        F.lit(0).alias("is_st"),
        or_placeholder("doc_text").alias("ann_daily"),
    )


def reason_struct() -> Column:
    """Element of a reasoned watchlist."""
    return F.struct(
        F.col("entity").alias("stock_code"), "risk_score", "is_st", "ann_daily"
    )


def flagged_days(df: DataFrame, flag: str) -> DataFrame:
    """Ranked rows of the flagged entities of each day, by entity."""
    placed = with_position(
        df.where(F.col(flag) == 1).select(*KEYS), ["entity"], "rank", group=["date"]
    )
    return placed.withColumn("rank", F.col("rank") + 1)


def label_rows(df: DataFrame, value: str, empty: str) -> DataFrame:
    """`date, entity, label` with six decimals, null where the label is empty."""
    label = F.when(F.col(empty) != 1, F.round(F.col(value).cast("double"), 6))
    return df.select("date", "entity", label.alias("label"))


def label_maps(rows: DataFrame, part_size: int = 100_000) -> DataFrame:
    """`date, part, labels`: entity to label maps of about `part_size` entries at most.

    The number of parts comes from the largest day; an entity is met once per day, so its hash
    spreads the entries evenly.
    """
    largest = rows.groupBy("date").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    parts = max(1, math.ceil((largest or 0) / part_size))
    part = F.pmod(F.xxhash64("entity"), F.lit(parts)).cast("int")
    pairs = F.array_sort(F.collect_list(F.struct("entity", "label")))
    return (
        rows.withColumn("part", part)
        .groupBy("date", "part")
        .agg(F.map_from_entries(pairs).alias("labels"))
    )


def model_flags(df: DataFrame, threshold: float) -> DataFrame:
    """Add the listing flag (not in-status and predicted at or above the threshold) and the
    observed in-status flag."""
    empty = F.coalesce("y_label_empty", F.lit(0))
    reached = F.col("predicted_label_value").cast("float") >= F.lit(threshold).cast("float")
    listed = (empty == 0) & reached
    return (
        df.withColumn("predicted_label_empty", F.lit(0))
        .withColumn("predicted_label", F.col("predicted_label_value"))
        .withColumn("predicted_st", empty)
        .withColumn("predicted_blacklist", listed.cast("int"))
    )


def highest_entity(df: DataFrame, score: str = "score") -> DataFrame:
    """One row: the entity with the highest score, the first by code among equals."""
    best = df.groupBy("entity").agg(F.max(score).alias(score))
    return best.agg(
        F.min_by("entity", F.struct((-F.col(score)).alias("s"), F.col("entity"))).alias("entity"),
        F.max(score).alias(score),
    )


def decay_trace(
    df: DataFrame,
    retain: float,
    *,
    entity: str | None = None,
    raw: str = "raw_score",
    score: str = "score",
    margin: int = 30,
) -> DataFrame:
    """Raw and decayed score of one entity around its active days.

    Without an entity, the one with the highest decayed score (one row, broadcast).
    """
    if entity is None:
        chosen = highest_entity(df, score).select("entity")
        rows = df.join(F.broadcast(chosen), "entity", "left_semi")
    else:
        rows = df.where(F.col("entity") == F.lit(entity))
    active = (F.coalesce(F.col(raw), F.lit(0.0)) > 0) | (F.col(score) > 0)
    whole = Window.partitionBy("entity")
    first = F.min(F.when(active, F.col("date"))).over(whole)
    last = F.max(F.when(active, F.col("date"))).over(whole)
    near = F.col("_first").isNull() | F.col("date").between(
        F.date_sub("_first", margin), F.date_add("_last", margin)
    )
    return (
        rows.withColumn("_first", first)
        .withColumn("_last", last)
        .where(near)
        .select(*KEYS, raw, score, (F.col(score) >= retain).alias("listed"))
    )
