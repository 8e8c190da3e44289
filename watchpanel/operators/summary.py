"""Distribution summaries and run counters."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpanel.operators.selection import values_at
from watchpanel.sources.storage import materialize

PERCENTILES = (0.5, 0.7, 0.8, 0.9, 0.95, 0.99)


def describe(
    df: DataFrame, column: str, percentiles: Sequence[float] = PERCENTILES, *, nonzero: bool = False
) -> DataFrame:
    """One row: count, mean, std, min, max and exact interpolated percentiles (p50, ...).

    Everything comes from the table of different values with their counts, which is computed once;
    percentiles by selection, so values are not put in order.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    if nonzero:
        values = values.where(F.col("v") > 0)
    histogram = materialize(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    v, n = F.col("v"), F.col("n")
    # single rows
    totals = histogram.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("count"), (F.sum(v * n) / F.sum(n)).alias("mean"),
        F.min(v).alias("min"), F.max(v).alias("max"),
    ).first()
    mean = F.lit(totals["mean"]).cast("double")
    squares = histogram.agg(F.sum(n * (v - mean) * (v - mean))).first()[0]
    count = totals["count"]
    std = math.sqrt(squares / (count - 1)) if count > 1 else None
    places = {q: q * max(count - 1, 0) for q in percentiles}
    at = values_at(histogram, "v", "n", [f(p) for p in places.values() for f in (math.floor, math.ceil)])

    def between(place: float) -> float | None:
        if not at:
            return None
        below = at[math.floor(place)]
        return below + (at[math.ceil(place)] - below) * (place - math.floor(place))

    known = {"mean": totals["mean"], "std": std, "min": totals["min"], "max": totals["max"]}
    known |= {f"p{round(q * 100):d}": between(p) for q, p in places.items()}
    return df.sparkSession.range(1).select(
        F.lit(count).cast("bigint").alias("count"), *[F.lit(x).cast("double").alias(c) for c, x in known.items()]
    )


def run_counters(tasks: DataFrame, panel: DataFrame, output_rows: DataFrame) -> DataFrame:
    """One row: scored points, output points, entities."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")

    entities = panel.select("entity").distinct()
    stacked = (
        counted(tasks, "n_scored_points")
        .unionByName(counted(output_rows, "n_output_points"))
        .unionByName(counted(entities, "n_universe"))
    )
    return stacked.agg(
        *[
            F.max(F.when(F.col("name") == c, F.col("n"))).alias(c)
            for c in ("n_scored_points", "n_output_points", "n_universe")
        ]
    )


def run_metadata(
    spark: SparkSession, settings: Mapping[str, object], tables: Mapping[str, DataFrame]
) -> DataFrame:
    """One row describing a run: the settings, and each one-row table as a struct.

    Every table must have exactly one row, which is read to the driver.
    """
    columns = []
    for name, value in settings.items():
        plain = list(value) if isinstance(value, (tuple, list)) else value
        column = F.array(*[F.lit(v) for v in plain]) if isinstance(plain, list) else F.lit(plain)
        columns.append(column.alias(name))
    for name, table in tables.items():
        found = table.limit(2).collect()
        if len(found) != 1:
            raise ValueError(f"{name} must have exactly one row")
        row = found[0]
        fields = [F.lit(row[f.name]).cast(f.dataType).alias(f.name) for f in table.schema]
        columns.append(F.struct(*fields).alias(name))
    return spark.range(1).select(*columns)


def target_counters(df: DataFrame, target: str = "y_label_value") -> DataFrame:
    """One row: positive, zero and numeric rows of the target."""
    t = F.col(target)
    return df.agg(
        F.count_if(t > 0).alias("positive_rows"),
        F.count_if(t == 0).alias("zero_rows"),
        F.count_if(t.isNotNull()).alias("numeric_rows"),
    )
