"""Positions in a total order, without ever holding one group or the table in one task.

The rows are range-partitioned by the order, checkpointed, and numbered inside each range; the
row counts of the ranges give the position at which each range starts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.sources.storage import materialize


def _ranged(df: DataFrame, keys: Sequence[Column | str], parts: int | None) -> DataFrame:
    """The rows in ranges of the order, with the range's number and the place in it."""
    # without a number, adaptive execution joins neighbouring small ranges; order is kept
    ranged = df.repartitionByRange(*([parts] if parts else []), *keys)
    return materialize(
        ranged.sortWithinPartitions(*keys)
        .withColumn("_ordering_range", F.spark_partition_id())
        # grows by one from row to row of a sorted partition
        .withColumn("_ordering_place", F.monotonically_increasing_id())
    )


def _with_starts(rows: DataFrame, size: Column, group: Sequence[str]) -> DataFrame:
    """Add what the ranges before a row's own hold of its group, and its group's first place in the range."""
    earlier = (
        Window.partitionBy(*[F.col(g) for g in group])
        .orderBy("_ordering_range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # one row per range and group met in it: at most (ranges + groups) rows
    starts = (
        rows.groupBy("_ordering_range", *group)
        .agg(size.alias("_ordering_sum"), F.min("_ordering_place").alias("_ordering_first"))
        .withColumn("_ordering_start", F.coalesce(F.sum("_ordering_sum").over(earlier), F.lit(0)))
        .drop("_ordering_sum")
    )
    # null groups are groups too; Spark broadcasts the starts if they are small
    keys = ["_ordering_range", *group]
    same = [F.col(c).eqNullSafe(F.col(f"_start_{c}")) for c in keys]
    named = starts.toDF(*[f"_start_{c}" if c in keys else c for c in starts.columns])
    return rows.join(named, reduce(and_, same)).drop(*[f"_start_{c}" for c in keys])


def with_running_total(
    df: DataFrame,
    order: Sequence[Column | str],
    weight: Column | str,
    out: str,
    *,
    group: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add the sum of `weight` over the rows of the group up to and including this one.

    `order` must make the rows of a group distinguishable.  Groups may be of any size: they are
    cut where the ranges are cut.  `parts` fixes the number of ranges.
    """
    weighted = df.withColumn(
        "_ordering_weight", F.col(weight) if isinstance(weight, str) else weight
    )
    rows = _ranged(weighted, [*group, *order], parts)
    inside = (
        Window.partitionBy("_ordering_range", *group)
        .orderBy("_ordering_place")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = rows.withColumn("_ordering_inside", F.sum("_ordering_weight").over(inside))
    return (
        _with_starts(summed, F.sum("_ordering_weight"), group)
        .withColumn(out, F.col("_ordering_start") + F.col("_ordering_inside"))
        .drop("_ordering_range", "_ordering_place", "_ordering_first", "_ordering_weight", "_ordering_inside", "_ordering_start")
    )


def with_position(
    df: DataFrame,
    order: Sequence[Column | str],
    out: str,
    *,
    group: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """Add the 0-based position of each row, over everything or inside its group.

    Use `group` for few groups (days); the table of range starts holds one row per group.
    """
    rows = _ranged(df, [*group, *order], parts)
    # a group's rows are neighbours in a range, so their places count on from its first one
    placed = _with_starts(rows, F.count(F.lit(1)), group).withColumn(
        out, F.col("_ordering_start") + F.col("_ordering_place") - F.col("_ordering_first")
    )
    return placed.drop("_ordering_range", "_ordering_place", "_ordering_first", "_ordering_start")
