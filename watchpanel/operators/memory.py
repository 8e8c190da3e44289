"""Decaying risk memory, forward fill and staleness.

Memory of one entity, day by day: the state falls by `decay`; a new positive value lifts a live
state to at least itself, and starts a dead one only from `entry` on; a state under `retain`
dies.  Because all values fall at the same speed, the state of a live memory is the running
maximum of `value + decay * day`, so two passes of one window replace the day-by-day loop:

1. best value so far, and from it the level it would have today;
2. last day the level was interrupted, and last day a value of at least `entry` came in.

The memory is alive when the latter is not before the former.  Gaps between rows are accounted
for, so days without a value may be left out.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.functions.columns import day_number

_TOLERANCE = 1e-9


def _number(x: Column | str | float) -> Column:
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def decay_memory(
    df: DataFrame,
    values: Mapping[str, str],
    *,
    decay: Column | str | float,
    entry: Column | str | float,
    retain: Column | str | float | None = None,
    keys: Sequence[str] = ("entity",),
    output: tuple[dt.date, dt.date] | None = None,
    warmup: bool = True,
) -> DataFrame:
    """Add the memory state of each value column: `values` maps value to output column.

    One row per key and `date`.  `decay`, `entry` and `retain` may be columns (parameter sweeps
    carry them per row).  With `output`, days outside it get 0, and with `warmup=False` the days
    before it do not count either.
    """
    d, enter = _number(decay), _number(entry)
    keep = enter if retain is None else _number(retain)
    day = F.col("_day")
    w = Window.partitionBy(*keys).orderBy("_day")
    rows = df.withColumn("_day", day_number("date"))
    inside = counted = F.lit(True)
    if output is not None:
        inside = F.col("date").between(F.lit(output[0]), F.lit(output[1]))
        counted = F.col("date") <= F.lit(output[1]) if warmup else inside

    def usable(name: str) -> Column:
        v = F.col(name).cast("double")
        return counted & v.isNotNull() & ~F.isnan(v) & (v > 0)

    def best_so_far(name: str) -> Column:
        v = F.col(name).cast("double")
        here = F.struct((v + d * day).alias("k"), v.alias("v"), day.alias("t"))
        return F.max(F.when(usable(name), here)).over(w)

    def interrupted(i: int) -> Column:
        """The level of today, or of some day since the last row, is too low."""
        best, last = F.col(f"_best{i}"), F.lag(f"_best{i}").over(w)
        yesterday = last["v"] - d * (day - 1 - last["t"])
        return (
            best.isNull()
            | (F.col(f"_level{i}") < keep - _TOLERANCE)
            | last.isNull()
            | (yesterday < keep - _TOLERANCE)
            | (yesterday - d <= 0)
        )

    names = list(enumerate(values))
    rows = rows.withColumns({f"_best{i}": best_so_far(name) for i, name in names})
    rows = rows.withColumns(
        {f"_level{i}": F.col(f"_best{i}.v") - d * (day - F.col(f"_best{i}.t")) for i, _ in names}
    )
    # the same window throughout: one sort and one shuffle
    rows = rows.withColumns({f"_cut{i}": interrupted(i) for i, _ in names})
    rows = rows.withColumns(
        {
            **{f"_last_cut{i}": F.max(F.when(F.col(f"_cut{i}"), day)).over(w) for i, _ in names},
            **{
                f"_last_enter{i}": F.max(
                    F.when(usable(name) & (F.col(name).cast("double") >= enter), day)
                ).over(w)
                for i, name in names
            },
        }
    )

    def state(i: int) -> Column:
        level = F.col(f"_level{i}")
        alive = (
            inside
            & (level >= keep - _TOLERANCE)
            & (F.col(f"_last_enter{i}") >= F.coalesce(f"_last_cut{i}", F.lit(-(2**31))))
        )
        return F.when(alive, F.greatest(level, F.lit(0.0))).otherwise(F.lit(0.0))

    helpers = [f"{p}{i}" for i, _ in names for p in ("_best", "_level", "_cut", "_last_cut", "_last_enter")]
    return rows.withColumns({out: state(i) for i, out in enumerate(values.values())}).drop(
        "_day", *helpers
    )


def memory_days(
    scores: DataFrame,
    *,
    decay: Column | str | float,
    entry: Column | str | float,
    retain: Column | str | float | None = None,
    end: dt.date,
    start: dt.date | None = None,
    keys: Sequence[str] = ("entity",),
    value: str = "score",
) -> DataFrame:
    """Only the days on which the memory is alive, from the scored days alone.

    The sparse form of `decay_memory`: each live scored day stands for the days until the next
    scored one or until the level falls under `retain`.  Nothing is generated for the entities
    and days without risk, which are nearly all of a panel.  With `decay` 0 a level never falls.
    """
    d = _number(decay)
    keep = _number(entry) if retain is None else _number(retain)
    carried = [c for c in scores.columns if c not in (*keys, "date", value)]
    lived = decay_memory(
        scores.where(F.col(value) > 0),
        {value: "_state"},
        decay=decay,
        entry=entry,
        retain=retain,
        keys=keys,
    )
    w = Window.partitionBy(*keys).orderBy("date")
    next_day = F.lead("date").over(w)
    # without decay a state lasts to the end
    reach = F.coalesce(
        F.floor(F.try_divide(F.col("_state") - keep, d) + F.lit(1.0)).cast("int"), F.datediff(F.lit(end), "date")
    )
    last = F.least(F.date_add("date", reach), F.coalesce(F.date_sub("_next", 1), F.lit(end)), F.lit(end))
    first = F.col("date") if start is None else F.greatest("date", F.lit(start))
    level = F.col("_state") - d * F.datediff("_alive_day", "date")
    return (
        lived.withColumn("_next", next_day)
        .where(F.col("_state") > 0)
        .withColumn("_from", first)
        .withColumn("_to", last)
        .where(F.col("_from") <= F.col("_to"))
        .withColumn("_alive_day", F.explode(F.sequence("_from", "_to")))
        .withColumn("_level", level)
        .where((F.col("_level") >= keep - _TOLERANCE) & (F.col("_level") > 0))
        .select(*keys, *carried, F.col("_alive_day").alias("date"), F.col("_level").alias("score"))
    )


def forward_fill(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Carry the last known value of an entity forward; 0 before the first."""
    w = Window.partitionBy("entity").orderBy("date")
    for name in columns:
        df = df.withColumn(name, F.coalesce(F.last(name, True).over(w), F.lit(0.0)))
    return df


def cut_stale(
    df: DataFrame, columns: Sequence[str], scored: str, max_days: int | None = 30
) -> DataFrame:
    """Zero the values more than `max_days` after the last scored day; None keeps them."""
    if max_days is None:
        return df
    w = Window.partitionBy("entity").orderBy("date")
    last = F.last(F.when(F.col(scored), F.col("date")), True).over(w)
    df = df.withColumn("_scored_on", last)
    stale = F.coalesce(F.datediff("date", "_scored_on") > max_days, F.lit(False))
    for name in columns:
        df = df.withColumn(name, F.when(stale, F.lit(0.0)).otherwise(F.col(name)))
    return df.drop("_scored_on")
