"""Scalar column expressions: codes, dates, numbers, calendar parts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv

# Characters of the Unicode White_Space property and the four separators U+001C..U+001F;
# trim() on its own removes U+0020 only.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)

DATE_FORMATS = (
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/M/d",
    "yyyy/M/d HH:mm:ss",
    "yyyyMMdd",
    "M/d/yyyy",
)


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Remove white space of any kind at both ends; only the ends are looked at."""
    return F.trim(as_column(c), F.lit(SPACES))


def normalize_code(c: Column | str, *, cut: bool = True, pad: bool = True) -> Column:
    """Entity code: stripped, cut at the first dot, digits padded to six places."""
    code = strip(F.coalesce(as_column(c).cast("string"), F.lit("")))
    if cut:
        code = F.substring_index(code, ".", 1)
    if pad:
        short_digits = code.rlike(r"(?U)^\d{1,5}\z")
        code = F.when(short_digits, F.lpad(code, 6, "0")).otherwise(code)
    return code


def parse_mixed_timestamp(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """First format that fits; null when none does."""
    text = strip(as_column(c).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def parse_mixed_date(c: Column | str, formats: Sequence[str] = DATE_FORMATS) -> Column:
    return F.to_date(parse_mixed_timestamp(c, formats))


def parse_yyyymmdd(c: Column | str) -> Column:
    """Date from a number or text like 20240131 or 20240131.0; null when it is not one."""
    digits = strip(as_column(c).cast("string")).try_cast("double").try_cast("bigint").cast("string")
    return F.to_date(F.try_to_timestamp(digits, F.lit("yyyyMMdd")))


def coerce_score(c: Column | str, *, clip: bool = True) -> Column:
    """Number from anything; unreadable becomes 0; optionally limited to 0..100 as float."""
    number = F.nanvl(F.coalesce(as_column(c).try_cast("double"), F.lit(0.0)), F.lit(0.0))
    if not clip:
        return number
    return F.least(F.greatest(number, F.lit(0.0)), F.lit(100.0)).cast("float")


def clip_unit(c: Column | str) -> Column:
    """Limit to 0..1, keeping null."""
    col = as_column(c)
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(0.0)), F.lit(1.0)))


def row_max(*cols: Column | str) -> Column:
    return F.greatest(*[as_column(c) for c in cols])


def nonzero_count(*cols: Column | str) -> Column:
    terms = [F.when(as_column(c) > 0, F.lit(1)).otherwise(F.lit(0)) for c in cols]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def calendar_parts(date: Column | str) -> dict[str, Column]:
    """Month, quarter, day of year and the month on the unit circle."""
    d = as_column(date)
    angle = F.month(d) * F.lit(2 * math.pi / 12)
    return {
        "month": F.month(d),
        "quarter": F.quarter(d),
        "dayofyear": F.dayofyear(d),
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    }


def int_score(c: Column | str) -> Column:
    """Truncate toward zero to a bigint; missing or non-finite becomes 0.

    Values beyond the 64-bit range become its ends.
    """
    col = as_column(c).cast("double")
    top = 2**63 - 1
    return (
        F.when(col.isNull() | F.isnan(col) | (F.abs(col) == float("inf")), F.lit(0).cast("bigint"))
        .when(col >= 2.0**63, F.lit(top))
        .when(col < -(2.0**63), F.lit(-top - 1))
        .otherwise(col.try_cast("bigint"))
    )


def or_placeholder(c: Column | str, placeholder: str = fv.NO_DOCUMENT) -> Column:
    return F.coalesce(F.nullif(as_column(c), F.lit("")), F.lit(placeholder))


def day_number(date: Column | str) -> Column:
    """Days since 1970-01-01, for range frames and differences."""
    return F.unix_date(as_column(date))
