"""Writers of results.

The stored form of every result is rows.  The `{day: value}` documents of the exchange format
are written as text with one day per line, in date order over as many files as there are ranges:
the files put one after another are the document, and no task holds more than its own lines.
"""

from __future__ import annotations

import csv
import io
import os
import shutil
from collections.abc import Mapping, Sequence
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.sources.storage import scratch_path


def write_day_objects(days: DataFrame, path: str) -> None:
    """Row form: one JSON object per day and part (`date`, `part`, list or map)."""
    days.write.mode("overwrite").json(path)


def write_document(days: DataFrame, value: Column | str, path: str) -> None:
    """Exchange form: one JSON document `{day: value, ...}`, a line per day, or per part of a day.

    A day in several parts (lists or maps) is one value of the document: its first line opens
    the value, its last one closes it (such a document is read as a whole, not by line).
    """
    item = F.col(value) if isinstance(value, str) else value
    rows = days if "part" in days.columns else days.withColumn("part", F.lit(0))
    extent = rows.groupBy("date").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    bounds = extent.agg(F.min("date").alias("first"), F.max("date").alias("last")).first()
    opens, closes = F.col("part") == F.col("_first"), F.col("part") == F.col("_last")
    pair = F.to_json(F.create_map(F.col("date").cast("string"), item), {"ignoreNullFields": "false"})
    # {"2024-01-01":[ and ]} are 15 and 2 characters, of a map as of a list
    inner = F.substring(pair, F.lit(16), F.length(pair) - 17)
    line = F.concat(
        F.when(opens & (F.col("date") == F.lit(bounds["first"])), F.lit("{")).otherwise(F.lit(" ")),
        F.when(opens, F.substring(pair, 2, 14)).otherwise(F.lit("")),
        inner,
        F.when(~closes, F.lit(",")).otherwise(
            F.concat(
                F.substring(pair, F.length(pair) - 1, F.lit(1)),
                F.when(F.col("date") == F.lit(bounds["last"]), F.lit("}")).otherwise(F.lit(",")),
            )
        ),
    )
    lines = rows.join(extent, "date").orderBy("date", "part").select(line.alias("value"))
    lines.write.mode("overwrite").text(path)


def write_json_rows(df: DataFrame, path: str) -> None:
    """JSON lines, nulls written out."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_metrics(metrics: DataFrame, path: str, run_path: str | None = None) -> None:
    """One-row metrics, and a second copy for the run when asked for."""
    write_json_rows(metrics, path)
    if run_path is not None:
        write_json_rows(metrics, run_path)


def write_csv(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """CSV with header, doubled quotes."""
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.csv(path)


def write_csv_file(df: DataFrame, path: str) -> None:
    """CSV as of `write_csv` in one file of any size: each task puts its rows at their place in the file.

    For a `file:` path in a folder that driver and executors share.  Other file systems cannot be written
    at a place; there one task writes the file, in a folder `path`.
    """
    if urlparse(path).scheme != "file":
        write_csv(df.coalesce(1), path)
        return
    spark = df.sparkSession
    parts, target = scratch_path(spark, "csv-parts"), urlparse(path).path
    df.write.option("escape", '"').csv(parts)
    # a row for each task of the write; the contents are not read
    listed = spark.read.format("binaryFile").load(parts).select("path", "length").orderBy("path").collect()
    header = io.StringIO()
    csv.writer(header, lineterminator="\n").writerow(df.columns)
    places, end = [], len(header.getvalue().encode())
    for part in listed:
        places.append((part["path"].removeprefix("file:"), end))
        end += part["length"]
    os.makedirs(os.path.dirname(target), exist_ok=True)
    with open(target, "wb") as out:
        out.write(header.getvalue().encode())
        out.truncate(end)

    def put(place: tuple[str, int]) -> None:
        with open(place[0], "rb") as rows, open(target, "r+b") as out:
            out.seek(place[1])
            shutil.copyfileobj(rows, out, 1 << 20)

    if places:
        spark.sparkContext.parallelize(places, len(places)).foreach(put)


def write_dim_scores(df: DataFrame, path: str, start, end, file_format: str = "csv") -> None:
    """Four-dimension panel of the output period, by month."""
    rows = (
        df.where(F.col("date").between(F.lit(start), F.lit(end)))
        .select(F.col("entity").alias("stock_code"), "date", *fv.DIMS)
        .withColumn("month", F.date_format("date", "yyyy-MM"))
    )
    writer = rows.write.mode("overwrite").partitionBy("month").option("header", True)
    writer.format(file_format).save(path)


PREDICTION_COLUMNS: Mapping[str, str] = {
    "entity": "stock_code",
    "date": "date",
    "label_in_file": "label_in_file",
    "y_label_empty": "y_label_empty",
    "y_label_value": "y_label_value",
    "predicted_st": "predicted_st",
    "predicted_blacklist": "predicted_blacklist",
    "predicted_label_empty": "predicted_label_empty",
    "predicted_label_value": "predicted_label_value",
    "predicted_label": "predicted_label",
    **{d: d for d in fv.DIMS},
}


def write_predictions(df: DataFrame, path: str) -> None:
    """The 14 columns of the prediction table as CSV."""
    write_csv(df.select(*[F.col(c).alias(n) for c, n in PREDICTION_COLUMNS.items()]), path)
