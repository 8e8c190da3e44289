"""From dated documents to one text per entity and day, the lookback text, and the prefilter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import day_number, or_placeholder
from watchpanel.functions.text import clean_text, document_line, with_key_sentences, with_prefilter
from watchpanel.operators.panel import KEYS
from watchpanel.params import PrefilterParams, TextParams


def usable_documents(df: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Documents of the period with a title and a category; both cleaned.

    Takes `id, entity, publish_date, category_name, title, content`; adds the day as `date`.
    The range filter comes first, so it reaches the scan.
    """
    return (
        df.where(F.col("publish_date") >= F.lit(start))
        .where(F.col("publish_date") < F.lit(end + dt.timedelta(days=1)))
        .where(F.col("entity").isNotNull())
        .where(F.col("title").isNotNull() & F.col("category_name").isNotNull())
        .withColumn("date", F.to_date("publish_date"))
        .withColumn("title", clean_text("title"))
        .withColumn("category_name", clean_text("category_name"))
        .where((F.col("title") != "") & (F.col("category_name") != ""))
    )


def first_documents(df: DataFrame, n: int | None) -> DataFrame:
    """The first n documents of each entity and day, by publish time and id; all when n is None.

    The rank limit is pushed below the shuffle, so each task sends at most n documents of a
    key, however many it has.
    """
    order = Window.partitionBy(*KEYS).orderBy("publish_date", "id")
    placed = df.withColumn("rank", F.row_number().over(order))
    return placed if n is None else placed.where(F.col("rank") <= n)


def daily_lines(
    df: DataFrame, start: dt.date, end: dt.date, params: TextParams = TextParams()
) -> DataFrame:
    """One composed line per kept document: `entity, date, rank, line`.

    Lines are composed before the per-day limit, where the documents are read: what is shuffled
    for the limit is a short line instead of a whole text.  Most entity-days have no more
    documents than the limit, so little composing is in vain, and none of it is skewed.
    """
    usable = usable_documents(df, start, end)
    if params.use_key_sentences and "content" in df.columns:
        keyed = with_key_sentences(usable, "content", "_key", params)
    else:
        keyed = usable.withColumn("_key", F.lit(""))
    lines = keyed.select(
        *KEYS,
        "publish_date",
        "id",
        document_line("category_name", "title", "_key", params).alias("line"),
    )
    return first_documents(lines, params.max_docs_per_day).select(*KEYS, "rank", "line")


def daily_text(
    df: DataFrame, start: dt.date, end: dt.date, params: TextParams = TextParams()
) -> DataFrame:
    """`entity, date, doc_text` for the days with documents, lines in publish order.

    At most `max_docs_per_day` lines are collected per group (with None the day's text holds them
    all), and the group key is the key of the window before it, so there is one shuffle for both.
    """
    lines = daily_lines(df, start, end, params)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "line")))
    text = F.array_join(F.transform(ordered, lambda x: x["line"]), fv.JOINER)
    return lines.groupBy(*KEYS).agg(text.alias("doc_text"))


def with_first_day(daily: DataFrame, entities: DataFrame, day: dt.date) -> DataFrame:
    """Sparse daily texts with a row for every entity on `day`, empty where it has no document."""
    first = entities.select("entity", F.lit(day).alias("date"))
    missing = first.join(daily.where(F.col("date") == F.lit(day)).select(*KEYS), KEYS, "left_anti")
    return daily.unionByName(missing.withColumn("doc_text", F.lit(None).cast("string")))


def lookback_text(df: DataFrame, days: int, text: str = "doc_text", out: str = "lookback") -> DataFrame:
    """Add the texts of the last `days` days of the entity, this day included, oldest first.

    Works on dense or sparse rows, one per entity and day: the frame is a range of days.
    """
    w = Window.partitionBy("entity").orderBy("_day").rangeBetween(-(days - 1), 0)
    kept = F.collect_list(F.nullif(F.col(text), F.lit("")))
    return (
        df.withColumn("_day", day_number("date"))
        .withColumn(out, F.array_join(kept.over(w), fv.JOINER))
        .drop("_day")
    )


def text_panel(
    panel: DataFrame,
    documents: DataFrame,
    start: dt.date,
    end: dt.date,
    params: TextParams = TextParams(),
) -> DataFrame:
    """Dense panel with `doc_text` and `lookback`, placeholders where there is nothing."""
    daily = daily_text(documents, start, end, params)
    joined = panel.join(daily, KEYS, "left")
    return (
        lookback_text(joined, params.lookback_days)
        .withColumn("doc_text", or_placeholder("doc_text"))
        .withColumn("lookback", or_placeholder("lookback"))
    )


def select_plain(
    df: DataFrame,
    output: tuple[dt.date, dt.date],
    *,
    only_document_days: bool = True,
    first_day_all: bool = False,
    skip_empty: bool = True,
) -> DataFrame:
    """Rows to score from the lookback text, as `entity, date, text`."""
    inside = F.col("date").between(F.lit(output[0]), F.lit(output[1]))
    wanted = inside & _has(F.col("doc_text")) if only_document_days else inside
    if first_day_all:
        wanted = wanted | (F.col("date") == F.lit(output[0]))
    if skip_empty:
        wanted = wanted & _has(F.col("lookback"))
    return df.where(wanted).select(*KEYS, F.col("lookback").alias("text"))


def select_prefiltered(
    df: DataFrame,
    output: tuple[dt.date, dt.date],
    params: PrefilterParams | None = PrefilterParams(),
    *,
    use_daily_text: bool = True,
    only_document_days: bool = True,
    first_day_all: bool = False,
    skip_empty: bool = True,
) -> DataFrame:
    """Rows to score up to the output end whose daily text passes the prefilter.

    The cheap conditions come before the prefilter expressions, and all of them before any
    scorer.  Needs `lookback` only when it is used.
    """
    wanted = F.col("date") <= F.lit(output[1])
    if only_document_days:
        wanted = wanted & _has(F.col("doc_text"))
    if skip_empty and "lookback" in df.columns:
        wanted = wanted & _has(F.col("lookback"))
    if params is not None:
        df = with_prefilter(df, "doc_text", params)
        wanted = wanted & F.col("filter_label").isin(*params.allowed)
    if first_day_all:
        wanted = wanted | (F.col("date") == F.lit(output[0]))
    source = "doc_text" if use_daily_text else "lookback"
    return df.where(wanted).select(*KEYS, or_placeholder(source).alias("text"))


def prefilter_counts(df: DataFrame) -> DataFrame:
    """Number of rows per prefilter label."""
    return df.groupBy("filter_label").agg(F.count(F.lit(1)).alias("n"))


def _has(c):
    return c.isNotNull() & (c != "") & (c != fv.NO_DOCUMENT)
