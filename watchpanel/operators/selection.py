"""Exact selection without a full sort: histograms find the bucket of a cut, and only that is ordered.

A pass counts the rows of each of BUCKETS equal parts of the range of keys; the running count tells in
which part the wanted place lies, and the next pass divides that part.  What goes to the driver is one
count a part, whatever the number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: parts of a range in one pass; at most so many counts go to the driver
BUCKETS = 1 << 14
#: a part with at most so many rows is ordered
ORDERED = 10_000


def smallest(df: DataFrame, key: Column, n: int, ties: Sequence[str], *, buckets: int = BUCKETS, ordered: int = ORDERED) -> DataFrame:
    """The n rows of `df` with the smallest (key, ties); `key` is a 64-bit integer and not null.

    Fewer rows than n are all returned.  Rows with one key are ordered by `ties`, so a key of very many
    rows is cut by those, over the ranges of a sort.
    """
    rows = df.withColumn("_select", key)
    low, high, before = -(1 << 63), 1 << 63, 0
    while True:
        width = max(1, -(-(high - low) // buckets))
        inside = rows.where((F.col("_select") >= F.lit(low)) & (F.col("_select") <= F.lit(high - 1)))
        # the whole range has more numbers than a signed integer counts
        wide = "cast({} as decimal(20,0))"
        part = F.expr(f"({wide.format('_select')} - {wide.format(repr(str(low)))}) div {wide.format(repr(str(width)))}")
        counts = {int(r["part"]): r["n"] for r in inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
        found = None
        for i in sorted(counts):
            if before + counts[i] >= n:
                found = i
                break
            before += counts[i]
        if found is None:
            return rows.drop("_select")  # fewer than n in all
        low, high = low + found * width, min(low + (found + 1) * width, high)
        if counts[found] <= ordered or high - low == 1:
            break
    below = rows.where(F.col("_select") < F.lit(low))
    cut = rows.where((F.col("_select") >= F.lit(low)) & (F.col("_select") <= F.lit(high - 1)))
    return below.unionByName(cut.orderBy("_select", *ties).limit(n - before)).drop("_select")


def values_at(
    histogram: DataFrame, value: str, weight: str, places: Sequence[int], *, buckets: int = BUCKETS, ordered: int = ORDERED
) -> dict[int, float]:
    """Value at each 0-based place of the ordered values, from different values (double) and their counts."""
    found: dict[int, float] = {}
    edge = histogram.agg(F.min(value).alias("low"), F.max(value).alias("high")).first()
    if edge["low"] is None:
        return found
    # ranges still open: lowest and highest value, rows before, the places inside
    todo = [(edge["low"], edge["high"], 0, sorted(set(places)))]
    while todo:
        low, high, before, wanted = todo.pop()
        inside = histogram.where(F.col(value).between(F.lit(low), F.lit(high)))
        if low == high:
            found.update((p, low) for p in wanted)
            continue
        # rounding keeps the order of values, so a part holds neighbours
        part = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit((high - low) / buckets)), F.lit(buckets - 1))
        if not math.isfinite(high - low) or (high - low) / buckets == 0:
            part = (F.col(value) > F.lit(low / 2 + high / 2)).cast("bigint")
        counts = inside.groupBy(part.alias("part")).agg(
            F.sum(weight).alias("n"), F.count(F.lit(1)).alias("different"), F.min(value).alias("low"), F.max(value).alias("high")
        ).orderBy("part").collect()
        few: list[tuple] = []
        for c in counts:
            here = [p for p in wanted if before <= p < before + c["n"]]
            if here:
                if c["different"] <= ordered:
                    few.append((c["low"], c["high"], before, here))
                else:
                    todo.append((c["low"], c["high"], before, here))
            before += c["n"]
        for a, b, start, here in few:
            for r in histogram.where(F.col(value).between(F.lit(a), F.lit(b))).orderBy(value).collect():
                found.update((p, r[value]) for p in here if start <= p < start + r[weight])
                start += r[weight]
    return found
