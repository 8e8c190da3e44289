"""Readers of the incoming files.

CSV and single-document JSON are the exchange formats.  Quoted line breaks and the brackets of a
document keep Spark from cutting such a file; `sources.ranges` reads documents and lists by byte ranges
nevertheless.  What is read often should be landed once as Parquet (`land_documents`) and pruned there.
"""

from __future__ import annotations

import csv
import datetime as dt
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import (
    coerce_score,
    normalize_code,
    parse_mixed_date,
    parse_mixed_timestamp,
    parse_yyyymmdd,
)
from watchpanel.operators.panel import distinct_keys, in_range, label_cells
from watchpanel.sources.ranges import json_members, read_csv_ranges
from watchpanel.sources.storage import materialize


def _hadoop_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def first_existing(spark: SparkSession, candidates: Sequence[str]) -> str:
    """First path that exists on the shared file system."""
    for path in candidates:
        if _hadoop_exists(spark, path):
            return path
    raise FileNotFoundError("none of these exist: " + ", ".join(candidates))


def read_csv(spark: SparkSession, paths: str | Sequence[str], *, by_ranges: bool = False) -> DataFrame:
    """CSV with header, quoted line breaks and doubled quotes; every column as text.

    Cells that stand for a missing value are null.  A file is read by one task, or `by_ranges` by as many
    as it has byte ranges.
    """
    if by_ranges:
        df = read_csv_ranges(spark, paths)
    else:
        df = spark.read.csv(paths, header=True, multiLine=True, escape='"', inferSchema=False)
    cells = [(F.col(f"`{name}`"), name) for name in df.columns]
    return df.select(*[F.when(~c.isin(*fv.MISSING_CELLS), c).alias(name) for c, name in cells])


def renamed(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Only the mapped columns, under their new names."""
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items()])


def needed_years(output_start: dt.date, output_end: dt.date, lookback_days: int) -> list[int]:
    first = output_start - dt.timedelta(days=lookback_days)
    return list(range(first.year, output_end.year + 1))


def _document_rows(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("publish_date", parse_mixed_timestamp("publish_date"))
        .withColumn("has_full_text", F.col("has_full_text").try_cast("int"))
        .where(F.col("entity").isNotNull())
        .withColumn("entity", normalize_code("entity"))
    )


def scan_documents(
    spark: SparkSession,
    base: str,
    *,
    output_start: dt.date,
    output_end: dt.date,
    lookback_days: int = 60,
    name: Callable[[int], str] = lambda year: f"announcements_{year}.csv",
    mapping: Mapping[str, str] = fv.DOCUMENT_COLUMNS,
    head: int | None = None,
) -> DataFrame:
    """Documents of the needed years, mapped columns only; rows without an entity dropped.

    One path (file or folder) per year; years outside the period are not opened.  A file is read by
    byte ranges, whatever line breaks its texts hold.  `head` keeps the first rows of each year, for
    trials, and reads no more than it needs.
    """
    years = needed_years(output_start, output_end, lookback_days)
    if head is None:
        paths = [f"{base}/{name(y)}" for y in years]
        return _document_rows(renamed(read_csv(spark, paths, by_ranges=True), mapping))
    parts = [renamed(read_csv(spark, f"{base}/{name(y)}"), mapping).limit(head) for y in years]
    together = parts[0]
    for part in parts[1:]:
        together = together.unionByName(part)
    return _document_rows(together)


def land_documents(documents: DataFrame, path: str) -> None:
    """Store documents as Parquet by year, for pruned and splittable reads."""
    documents.withColumn("year", F.year("publish_date")).write.mode("overwrite").partitionBy(
        "year"
    ).parquet(path)


def scan_landed_documents(
    spark: SparkSession, path: str, *, output_start: dt.date, output_end: dt.date, lookback_days: int = 60
) -> DataFrame:
    """Landed documents of the needed years; other year folders are not listed for reading."""
    years = needed_years(output_start, output_end, lookback_days)
    return spark.read.parquet(path).where(F.col("year").between(years[0], years[-1])).drop("year")


def scan_status_intervals(
    spark: SparkSession,
    candidates: Sequence[str],
    mapping: Mapping[str, str] = fv.STATUS_COLUMNS,
) -> DataFrame:
    """`entity, entry_date, remove_date, kind` from the first path that exists."""
    df = renamed(read_csv(spark, first_existing(spark, candidates)), mapping)
    return (
        df.withColumn("entity", normalize_code("entity"))
        .withColumn("entry_date", parse_yyyymmdd("entry_date"))
        .withColumn("remove_date", parse_yyyymmdd("remove_date"))
    )


def dim_score_rows(
    df: DataFrame,
    start: dt.date | None = None,
    end: dt.date | None = None,
    *,
    clip: bool = True,
    dims: Sequence[str] = fv.DIMS,
) -> DataFrame:
    """Score rows with a code and a date, dims as numbers (0 when unreadable)."""
    rows = df.where(F.col("entity").isNotNull())
    if dict(rows.dtypes)["date"] != "date":
        rows = rows.withColumn("date", parse_mixed_date("date"))
    rows = rows.where(F.col("date").isNotNull())
    if start is not None and end is not None:
        rows = in_range(rows, start, end)
    return rows.select(
        normalize_code("entity").alias("entity"),
        "date",
        *[coerce_score(d, clip=clip).alias(d) for d in dims],
    )


def scan_dim_scores(
    spark: SparkSession,
    path: str,
    start: dt.date | None = None,
    end: dt.date | None = None,
    *,
    clip: bool = True,
    file_format: str = "csv",
    code: str = "stock_code",
) -> DataFrame:
    """Four-dimension scores from CSV or Parquet; on Parquet the range reaches the scan."""
    df = read_csv(spark, path) if file_format == "csv" else spark.read.format(file_format).load(path)
    return dim_score_rows(df.withColumnRenamed(code, "entity"), start, end, clip=clip)


def scan_label_matrix(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """Wide label matrix (first column a date, one column per entity) as long rows.

    Lines are cut into lists of cells, not into columns: a market of thousands of entities is one column
    of the plan.  Cells are dates, numbers or blank, so no line break or comma is inside one.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "[\r\ufeff]", "").alias("value")).where("value <> ''")
    head = lines.first()
    if head is None:
        raise ValueError(f"no header in {path}")
    _, *entities = next(csv.reader([head["value"]]))
    cells = F.transform(F.split("value", ",", -1), lambda c: F.regexp_replace(c, '^"|"$', ""))
    rows = lines.select(cells.alias("cells"))
    dated = rows.select(parse_mixed_date(F.get("cells", F.lit(0))).alias("date"), "cells")
    # headers of further files have no date
    inside = in_range(dated, start, end)
    width = len(entities)
    padded = F.slice(F.concat("cells", F.array_repeat(F.lit("").cast("string"), width)), 2, max(width, 1))
    long = label_cells(inside.select("date", padded.alias("cells")), entities)
    return long.withColumn("entity", normalize_code("entity"))


def truth_rows(labels: DataFrame) -> DataFrame:
    """Label rows as evaluation truth: a blank label is status 1."""
    return labels.select(
        "date",
        "entity",
        "label_in_file",
        F.col("y_label_empty").alias("y_status"),
        F.col("y_label_value").alias("st_label_value"),
    )


def _or_fail(parsed: Column, text: str) -> Column:
    """A parsed value; text that cannot be read is an error, and never a day without entries."""
    return F.coalesce(parsed, F.raise_error(F.concat(F.lit("no part of a document: "), F.substring(text, 1, 100))))


def _days_in_parts(pieces: DataFrame) -> DataFrame:
    """`_day, _first, _items` of the lines of days in several parts, in the order of their lines.

    Only the first line of a day tells it.  The lines stay where they are; one short row for each is put in order.
    """
    order = Window.orderBy(F.length("file"), "file", "block", "line")
    fits = (F.lag("closes", 1, True).over(order) == F.col("opens")) & (F.lead("opens", 1, True).over(order) == F.col("closes"))
    told = pieces.select("file", "block", "line", "opens", "closes", "day", F.size("items").alias("n")).select(
        "file", "block", "line", "opens", "n", fits.alias("fits"),
        F.last(F.when(F.col("opens"), F.col("day")), ignorenulls=True).over(order).alias("_day"),
        F.sum("n").over(order).alias("total"),
    )
    whole = F.col("fits") | F.raise_error(F.lit("a part of a day is missing")).isNotNull()
    before = F.col("total") - F.col("n")
    begun = F.last(F.when(F.col("opens"), before), ignorenulls=True).over(order)
    told = told.select("file", "block", "line", "_day", (before - begun).alias("_first"), "fits").where(whole)
    return pieces.join(told, ["file", "block", "line"]).select("_day", "_first", F.col("items").alias("_items"))


def _written_days(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """`_day, _first, _items` of a document as of `write_document`: a line per day, or per part of a day."""
    key, end = r'^[\s{]*"([^"]*)"\s*:\s*\[', r"\][\s,}]*$"
    value = F.col("value")
    lines = spark.read.text(path).select(
        value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), value.rlike(key).alias("opens"), value.rlike(end).alias("closes"),
    ).where(value.rlike(r"[^\s{},]"))
    whole = F.col("opens") & F.col("closes")
    pair = F.regexp_replace(F.regexp_replace(value, r"^[\s{]+", ""), end, "]")
    parsed = _or_fail(F.from_json(F.concat(F.lit("{"), pair, F.lit("}")), f"map<string,{kind}>"), "value")
    days = lines.where(whole).select(F.explode(parsed).alias("_day", "_items")).select("_day", F.lit(0).cast("bigint").alias("_first"), "_items")
    body = F.regexp_replace(F.regexp_replace(value, key, ""), F.when(F.col("closes"), F.lit(end)).otherwise(F.lit(r"\s*,\s*$")), F.lit(""))
    items = _or_fail(F.from_json(F.concat(F.lit("["), body, F.lit("]")), kind), "value")
    pieces = materialize(
        lines.where(~whole).select("file", "block", "line", "opens", "closes", F.regexp_extract(value, key, 1).alias("day"), items.alias("items"))
    )
    return days if pieces.isEmpty() else days.unionByName(_days_in_parts(pieces))


def _document_days(spark: SparkSession, path: str, kind: str, by_line: bool) -> DataFrame:
    """JSON documents `{day: list}` as `_day, _first, _items`: entries of a day, and how many are before them.

    `by_line` reads the form this package writes (a line per day, or per part of a long day).  Otherwise
    each file is one document in any layout, cut at its top-level keys by byte ranges; a day's list is one
    value.  Text that cannot be read is an error.
    """
    if by_line:
        return _written_days(spark, path, kind)
    days = json_members(spark, path).select(F.concat(F.lit("{"), "member", F.lit("}")).alias("value"))
    parsed = _or_fail(F.from_json("value", f"map<string,{kind}>"), "value")
    return days.select(F.explode(parsed).alias("_day", "_items")).select("_day", F.lit(0).cast("bigint").alias("_first"), "_items")


def scan_daily_watchlist(
    spark: SparkSession, path: str, start: dt.date, end: dt.date, *, by_line: bool = False
) -> DataFrame:
    """Different `date, entity` rows of a `{date: [codes]}` document; unreadable dates skipped."""
    days = _document_days(spark, path, "array<string>", by_line)
    rows = days.select(
        parse_mixed_date("_day").alias("date"), F.explode("_items").alias("_code")
    ).select("date", normalize_code("_code").alias("entity"))
    return distinct_keys(in_range(rows, start, end))


_REASON = "array<struct<stock_code:string,risk_score:bigint,is_st:int,ann_daily:string>>"


def scan_reasoned_watchlist(spark: SparkSession, path: str, *, by_line: bool = False) -> DataFrame:
    """`date, rank, entity, risk_score, is_st, ann_daily` of a reasoned watchlist document."""
    days = _document_days(spark, path, _REASON, by_line)
    rows = days.select(parse_mixed_date("_day").alias("date"), "_first", F.posexplode("_items").alias("_i", "_r"))
    return rows.select(
        "date",
        (F.col("_first") + F.col("_i") + 1).cast("int").alias("rank"),
        F.col("_r.stock_code").alias("entity"),
        "_r.risk_score",
        "_r.is_st",
        "_r.ann_daily",
    )


def scan_watchlist_rows(spark: SparkSession, path: str, start: dt.date, end: dt.date) -> DataFrame:
    """Different `date, entity` rows of the row form: one JSON object per day and list part."""
    schema = T.StructType(
        [
            T.StructField("date", T.DateType()),
            T.StructField("part", T.IntegerType()),
            T.StructField("entities", T.ArrayType(T.StringType())),
        ]
    )
    rows = spark.read.schema(schema).json(path).select("date", F.explode("entities").alias("_code"))
    return distinct_keys(in_range(rows.select("date", normalize_code("_code").alias("entity")), start, end))


def any_positive(dims: Sequence[str] = fv.DIMS) -> Column:
    test = F.lit(False)
    for d in dims:
        test = test | (F.col(d) > 0)
    return test


def peek_nonzero(df: DataFrame, n: int = 20, dims: Sequence[str] = fv.DIMS) -> DataFrame:
    """The first n rows, by key, with any dimension above 0."""
    return df.where(any_positive(dims)).orderBy("entity", "date").limit(n)


def nonzero_counts(df: DataFrame, dims: Sequence[str] = fv.DIMS) -> DataFrame:
    """One row: all rows, and rows with any dimension above 0."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(any_positive(dims)).alias("nonzero_rows")
    )
