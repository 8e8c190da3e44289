"""Reading scores out of free scorer output text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import as_column, strip

_FENCE = "```"
_NUMBER_TYPES = ("BIGINT", "DOUBLE", "FLOAT")


def strip_fences(c: Column | str) -> Column:
    """Body of the first fenced block, or the stripped text when there is none."""
    text = as_column(c)
    parts = F.split(text, _FENCE)
    return F.when(F.size(parts) >= 3, strip(parts[1])).otherwise(strip(text))


def _with_object(df: DataFrame, raw: str) -> DataFrame:
    """Add `_text`, `_json` (widest braces) and `_obj` (its variant, null when not one object).

    The braces are parsed inside a one-element array, so that anything behind the object makes
    it invalid instead of being ignored.
    """
    return (
        df.withColumn("_text", strip(strip_fences(F.coalesce(F.col(raw), F.lit("")))))
        .withColumn("_json", F.regexp_extract("_text", r"(?s)\{.*\}", 0))
        .withColumn("_list", F.try_parse_json(F.concat(F.lit("["), "_json", F.lit("]"))))
        .withColumn(
            "_obj",
            F.when(
                (F.col("_json") != "")
                & F.try_variant_get("_list", "$[1]", "variant").isNull(),
                F.col("_list"),
            ),
        )
    )


def _whole_number(obj: Column, field: str) -> Column:
    """Integer value of a field: missing is 0, numbers are truncated, text must be an integer.

    Null means the field cannot be read as a whole number.
    """
    path = f"$[0].{field}"
    kind = F.schema_of_variant(F.try_variant_get(obj, path, "variant"))
    number = F.try_variant_get(obj, path, "double")
    text = F.try_variant_get(obj, path, "string")
    finite = ~F.isnan(number) & (F.abs(number) < F.lit(float("inf")))
    truncated = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number)).cast("double")
    numeric = kind.isin(*_NUMBER_TYPES, "BOOLEAN") | kind.startswith("DECIMAL")
    return (
        F.when(kind.isNull(), F.lit(0.0))
        .when(numeric & finite, F.when(F.abs(number) < 1e15, truncated).otherwise(number))
        .when(
            (kind == "STRING") & text.rlike(r"^\s*[+-]?\d+\s*$"),
            strip(text).try_cast("double"),
        )
    )


def _clamp(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(100.0)).cast("int")


def with_parsed_score(df: DataFrame, raw: str, field: str = "risk_score") -> DataFrame:
    """Add `risk_score` (0..100), `parse_ok` and `parse_error`.

    Broken JSON still counts when the text holds `"<field>": <integer>`.
    """
    found = F.regexp_extract("_text", rf'"{field}"\s*:\s*(-?\d+)', 1)
    value = F.col("_value")
    by_pattern = F.when(found != "", found.try_cast("double"))
    error = (
        F.when(F.col(raw).isNull(), F.lit("empty_output"))
        .when(F.col("_json") == "", F.lit("no_json_found"))
        .otherwise(F.lit("json_load_failed"))
    )
    return (
        _with_object(df, raw)
        .withColumn(
            "_value",
            F.when(F.col("_obj").isNotNull(), _whole_number(F.col("_obj"), field)),
        )
        .withColumn("_value", F.coalesce(value, by_pattern))
        .withColumn("risk_score", F.coalesce(_clamp(value), F.lit(0)))
        .withColumn("parse_ok", value.isNotNull())
        .withColumn("parse_error", F.when(value.isNull(), error))
        .drop("_text", "_json", "_list", "_obj", "_value")
    )


def with_parsed_dims(df: DataFrame, raw: str, dims: Sequence[str] = fv.DIMS) -> DataFrame:
    """Add one clamped integer per dimension, `parse_ok` and `parse_error`; all fields or none."""
    parsed = _with_object(df, raw)
    for dim in dims:
        parsed = parsed.withColumn(f"_v_{dim}", _whole_number(F.col("_obj"), dim))
    ok = F.col("_obj").isNotNull()
    for dim in dims:
        ok = ok & F.col(f"_v_{dim}").isNotNull()
    parsed = parsed.withColumn("parse_ok", ok)
    error = (
        F.when(F.col(raw).isNull(), F.lit("empty_output"))
        .when(F.col("_json") == "", F.lit("no_json_found"))
        .otherwise(F.lit("json_load_or_parse_failed"))
    )
    parsed = parsed.withColumn("parse_error", F.when(~F.col("parse_ok"), error))
    for dim in dims:
        parsed = parsed.withColumn(
            dim, F.when(F.col("parse_ok"), _clamp(F.col(f"_v_{dim}"))).otherwise(F.lit(0))
        )
    return parsed.drop("_text", "_json", "_list", "_obj", *[f"_v_{d}" for d in dims])
