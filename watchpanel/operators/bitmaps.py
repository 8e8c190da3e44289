"""Evaluation of a list against labels from bitmaps of days: no panel is built.

An entity is one row with a bit for each day of the period, 64 to a number: the days it is in the panel,
listed, in-status, and inside the label band.  They come from one aggregation with map-side combine; what
is counted afterwards are the set bits.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel.operators.evaluate import in_label_band, with_daily_ratios
from watchpanel.operators.panel import in_range
from watchpanel.sources.storage import materialize

KINDS = ("panel", "listed", "status", "band")


def _bit(words: Column, day: Column) -> Column:
    """Whether the bit of a day is set."""
    word = F.get(words, F.shiftright(day, 6))
    return F.getbit(word, day.bitwiseAND(F.lit(63))) == 1


def day_bitmaps(
    keys: DataFrame, truth: DataFrame, listed: DataFrame, start: dt.date, end: dt.date, *, min_lead: int, horizon: int
) -> DataFrame:
    """`entity, panel, listed, status, band`: arrays of 64-bit words, for entities with a day in `keys`."""
    n = (end - start).days // 64 + 1

    def marked(df: DataFrame, **kinds: Column) -> DataFrame:
        flags = [kinds.get(k, F.lit(False)).alias(k) for k in KINDS]
        return in_range(df, start, end).select("entity", F.datediff("date", F.lit(start)).alias("day"), *flags)

    yes = F.lit(True)
    rows = (
        marked(keys, panel=yes)
        .unionByName(marked(listed, listed=yes))
        .unionByName(marked(truth, status=F.col("y_status") == 1, band=in_label_band("st_label_value", min_lead, horizon)))
        .where("panel or listed or status or band")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("day").bitwiseAND(F.lit(63)))

    def words(kind: str) -> Column:
        here = [F.bit_or(F.when(F.col(kind) & (F.shiftright("day", 6) == w), bit)) for w in range(n)]
        return F.array(*[F.coalesce(x, F.lit(0).cast("bigint")) for x in here]).alias(kind)

    return rows.groupBy("entity").agg(*map(words, KINDS)).where(F.exists("panel", lambda w: w != 0))


def _days_of(words: Column, n: int) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda d: _bit(words, d))


def _both(a: Column | str, b: Column | str, but: bool = False) -> Column:
    """Bits of `a` that are in `b`, or with `but` those that are not."""
    return F.zip_with(a, b, lambda x, y: x.bitwiseAND(F.bitwise_not(y) if but else y))


def evaluate_list(
    keys: DataFrame, truth: DataFrame, listed: DataFrame, start: dt.date, end: dt.date, *, min_lead: int, horizon: int, market_n: int
) -> tuple[DataFrame, DataFrame]:
    """Daily metrics, and entry events with `hit`, of listed rows by the label rule.

    The same as from the dense panel of `keys`: rows outside it do not count, a listing on an in-status
    day is none, an event is a status day after a panel day without.  Raises when the panel is empty or
    an entity lacks one of its days.
    """
    n = (end - start).days + 1
    maps = materialize(day_bitmaps(keys, truth, listed, start, end, min_lead=min_lead, horizon=horizon))
    size = F.aggregate(F.transform("panel", lambda w: F.bit_count(w)), F.lit(0), lambda a, x: a + x)
    # a row of a few words
    shape = maps.agg(
        F.count(F.lit(1)).alias("entities"), F.min(size).alias("least"),
        F.array(*[F.bit_or(F.get("panel", F.lit(w))) for w in range((n - 1) // 64 + 1)]).alias("any"),
    ).first()
    if not shape["entities"]:
        raise ValueError("the panel is empty")
    days = [d for d in range(n) if shape["any"][d // 64] >> (d % 64) & 1]
    if shape["least"] != len(days):
        raise ValueError(f"not a complete entity x day panel: some entity has {shape['least']} of {len(days)} days")
    status = _both("status", "panel")
    rows = maps.select("entity", status.alias("status"), _both(_both("listed", "panel"), "status", but=True).alias("effective"), "band")
    rows = rows.withColumn("correct", _both("effective", "band"))
    marks = rows.select(
        F.explode(_days_of(F.zip_with("effective", "status", lambda x, y: x.bitwiseOR(y)), n)).alias("day"), "effective", "correct", "status"
    ).select("day", *[_bit(F.col(c), F.col("day")).alias(c) for c in ("effective", "correct", "status")])
    names = {"listed_cnt": "effective", "correct_cnt": "correct", "status_cnt": "status"}
    counts = marks.groupBy("day").agg(*[F.count_if(c).alias(name) for name, c in names.items()])
    calendar = maps.sparkSession.range(1).select(F.explode(F.array(*[F.lit(d) for d in days])).alias("day"))
    filled = calendar.join(counts, "day", "left").select(
        F.date_add(F.lit(start), F.col("day")).alias("date"), *[F.coalesce(c, F.lit(0)).alias(c) for c in names]
    )
    panel_days = F.array(*[F.lit(d) for d in days])
    # a status day whose panel day before has none
    turn = F.filter(
        F.sequence(F.lit(1), F.lit(max(len(days) - 1, 1))),
        lambda i: F.coalesce(_bit(F.col("status"), F.get(panel_days, i)), F.lit(False)) & ~_bit(F.col("status"), F.get(panel_days, i - 1)),
    )
    events = (
        rows.select("entity", F.explode(F.transform(turn, lambda i: F.get(panel_days, i))).alias("day"), _days_of(F.col("effective"), n).alias("seen"))
        .withColumn("hit", F.exists("seen", lambda d: d.between(F.col("day") - horizon, F.col("day") - min_lead)))
        .select("entity", F.date_add(F.lit(start), F.col("day")).alias("event_date"), F.col("hit").cast("int").alias("hit"))
    )
    return with_daily_ratios(filled, market_n), events
