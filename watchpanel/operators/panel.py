"""Entity-by-day panels: calendar, universe, dense and sparse forms, joins with defaults.

Column names are fixed: `entity`, `date` and value columns.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import clip_unit

KEYS = ["entity", "date"]


def calendar(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """All natural days start..end."""
    return spark.range(1).select(
        F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    )


def universe(*tables: DataFrame) -> DataFrame:
    """Distinct entities of all tables."""
    keys = tables[0].select("entity")
    for table in tables[1:]:
        keys = keys.union(table.select("entity"))
    return keys.where(F.col("entity").isNotNull()).distinct()


def dense_panel(entities: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every entity on every day, generated in place rather than by a product join."""
    return entities.select(
        "entity", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date")
    )


def fill_panel(panel: DataFrame, values: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Left join value columns to the panel; missing ones take their default (None keeps null)."""
    joined = panel.join(values.select(*KEYS, *defaults), KEYS, "left")
    for name, default in defaults.items():
        if default is not None:
            kind = values.schema[name].dataType
            joined = joined.withColumn(
                name, F.coalesce(F.col(name), F.lit(default).cast(kind))
            )
    return joined


def dense_fill(
    entities: DataFrame,
    values: DataFrame,
    defaults: Mapping[str, object],
    start: dt.date,
    end: dt.date,
) -> DataFrame:
    """Dense panel with value columns, like `fill_panel(dense_panel(...), ...)`.

    The values of an entity (one row per day, so at most as many as there are days) travel to
    the entity as one map, and the days are generated beside it.  Only scored days are shuffled,
    never the panel, and the result is already partitioned for windows over an entity.
    """
    row = F.struct(*defaults)
    packed = (
        in_range(values, start, end)
        .groupBy("entity")
        .agg(F.map_from_entries(F.collect_list(F.struct(F.col("date"), row.alias("row")))).alias("_rows"))
    )
    days = (
        entities.select("entity")
        .join(packed, "entity", "left")
        .select("entity", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"), "_rows")
    )
    columns = []
    for name, default in defaults.items():
        value = F.col("_rows")[F.col("date")][name]
        if default is not None:
            value = F.coalesce(value, F.lit(default).cast(values.schema[name].dataType))
        columns.append(value.alias(name))
    return days.select(*KEYS, *columns)


def in_range(df: DataFrame, start: dt.date, end: dt.date, column: str = "date") -> DataFrame:
    return df.where(F.col(column).between(F.lit(start), F.lit(end)))


def latest_per_key(df: DataFrame, order: Column | str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Keep the last row of each key, by an explicit sequence column.

    An aggregate rather than a window: rows of a hot key are reduced before the shuffle.
    """
    values = [c for c in df.columns if c not in keys]
    seq = F.col(order) if isinstance(order, str) else order
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), seq).alias("_last"))
        .select(*keys, "_last.*")
    )


def distinct_keys(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return df.select(*keys).distinct()


def join_text_and_status(text: DataFrame, status: DataFrame) -> DataFrame:
    """Panel with both; days without a status row are 0."""
    joined = text.join(status.select(*KEYS, "y_status"), KEYS, "left")
    return joined.withColumn("y_status", F.coalesce("y_status", F.lit(0)))


def with_labels(df: DataFrame, labels: DataFrame) -> DataFrame:
    """Join labels: blank in the file stays null, a number is kept, not in the file is 0.

    Adds `label_in_file`, `y_label_empty`, `y_label_value`, `y_label_numeric_available`.
    """
    columns = ["label_in_file", "y_label_empty", "y_label_value"]
    joined = df.join(labels.select(*KEYS, *columns), KEYS, "left")
    in_file = F.coalesce("label_in_file", F.lit(0))
    empty = F.coalesce("y_label_empty", F.lit(0))
    value = F.when((in_file == 0) & (empty == 0), F.lit(0.0)).when(
        empty == 0, F.col("y_label_value")
    )
    return (
        joined.withColumn("y_label_value", value)
        .withColumn("label_in_file", in_file)
        .withColumn("y_label_empty", empty)
        .withColumn("y_label_numeric_available", F.col("y_label_value").isNotNull().cast("int"))
    )


def with_truth(df: DataFrame, truth: DataFrame) -> DataFrame:
    """Join truth rows (`y_status`, `st_label_value`); not in the file is status 0, label 0."""
    joined = df.join(truth.select(*KEYS, "label_in_file", "y_status", "st_label_value"), KEYS, "left")
    in_file = F.coalesce("label_in_file", F.lit(0))
    return (
        joined.withColumn(
            "st_label_value", F.when(in_file == 0, F.lit(0.0)).otherwise(F.col("st_label_value"))
        )
        .withColumn("label_in_file", in_file)
        .withColumn("y_status", F.coalesce("y_status", F.lit(0)))
    )


def with_predictions(df: DataFrame, predictions: DataFrame) -> DataFrame:
    """Flag the listed rows; unlisted ones are 0."""
    listed = distinct_keys(predictions).withColumn("predicted_listing", F.lit(1))
    joined = df.join(listed, KEYS, "left")
    return joined.withColumn("predicted_listing", F.coalesce("predicted_listing", F.lit(0)))


def melt_label_matrix(wide: DataFrame) -> DataFrame:
    """Wide matrix (first column a date, one column per entity) to long rows.

    A blank cell means in-status: `y_label_empty` is 1 and the value null.
    """
    date, *entities = wide.columns
    # a row's cells become one list, so the plan does not grow with each entity; codes may contain dots
    cells = F.array(*[F.col(f"`{e}`").cast("string") for e in entities])
    return label_cells(wide.select(F.col(f"`{date}`").alias("date"), cells.alias("cells")), entities)


def label_cells(rows: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Rows (date, cells), a list of texts in the order of `entities`, to long rows as of the label matrix.

    One expansion, whatever the number of entities; cells that lack are blank.
    """
    # one literal, whatever its length
    names = F.split(F.lit("\x1f".join(entities)), "\x1f")
    listed = rows.select("date", F.posexplode(F.slice("cells", 1, max(len(entities), 1))).alias("_place", "_cell"))
    blank = F.col("_cell").isNull() | F.col("_cell").isin(*fv.MISSING_CELLS)
    number = clip_unit(F.when(~blank, F.col("_cell").try_cast("double")))
    return listed.select(
        "date",
        F.get(names, F.col("_place")).alias("entity"),
        F.lit(1).alias("label_in_file"),
        blank.cast("int").alias("y_label_empty"),
        F.when(~F.isnan(number), number).alias("y_label_value"),
    )


def panel_shape(df: DataFrame) -> DataFrame:
    """One row: rows, entities, days, and whether the panel is complete.

    Counts per entity and per day are partial aggregates; no set of keys is collected.
    """
    keys = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    by_entity_ = (
        keys.groupBy("entity")
        .agg(F.sum("n").alias("rows"), F.max("n").alias("most"))
        .agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.count(F.lit(1)).alias("entities"),
            F.coalesce(F.max("most"), F.lit(0)).alias("most"),
        )
        .withColumn("days", F.lit(0).cast("bigint"))
    )
    by_day = (
        keys.groupBy("date")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.count(F.lit(1)).alias("days"))
        .select(
            *[F.lit(0).cast("bigint").alias(c) for c in ("rows", "entities", "most")], "days"
        )
    )
    shape = by_entity_.unionByName(by_day).agg(
        *[F.max(c).alias(c) for c in ("rows", "entities", "days", "most")]
    )
    complete = (F.col("rows") == F.col("entities") * F.col("days")) & (F.col("most") == 1)
    return shape.select("rows", "entities", "days", complete.alias("complete"))


def require_complete_panel(df: DataFrame) -> None:
    """Raise when the panel is empty or some entity lacks a day."""
    shape = panel_shape(df).first()
    if shape["rows"] == 0:
        raise ValueError("the panel is empty")
    if not shape["complete"]:
        raise ValueError(f"not a complete entity x day panel: {shape.asDict()}")


def by_entity() -> "Window":
    """Window over the days of an entity.  A panel holds one row per entity and day."""
    return Window.partitionBy("entity").orderBy("date")
