import datetime as dt
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from watchpanel.operators.memory import cut_stale, decay_memory, forward_fill, memory_days

DAY0 = dt.date(2024, 1, 1)


def searched(values, decay, entry, retain):
    """State of each day: the best level among all stretches that reach it, found by search.

    A stretch begins with a value that may enter.  Its level is the best of its values, each less
    `decay` for every day since; it ends where that is under `retain`, or would be used up overnight.
    """
    d = Fraction(str(decay))
    known = [(i, Fraction(v)) for i, v in enumerate(values) if v]
    best = [Fraction(0)] * len(values)
    for first in (i for i, v in known if v >= entry):
        levels = [
            max(v - d * (day - i) for i, v in known if first <= i <= day) for day in range(first, len(values))
        ]
        ends = [n for n, x in enumerate(levels) if x < retain or (n and levels[n - 1] <= d)]
        for n, x in enumerate(levels[: ends[0] if ends else None]):
            best[first + n] = max(best[first + n], x)
    return [float(x) for x in best]


def frame(spark, series):
    rows = [
        (f"e{e:04d}", DAY0 + dt.timedelta(days=i), v)
        for e, s in enumerate(series) for i, v in enumerate(s)
    ]
    return spark.createDataFrame(rows, "entity string, date date, score double")


def random_series(seed, n, days):
    rng = random.Random(seed)
    return [
        [float(rng.randrange(1, 101)) if rng.random() < 0.25 else rng.choice([None, 0.0]) for _ in range(days)]
        for _ in range(n)
    ]


SETTINGS = [(0, 80, 65), (0.3, 80, 65), (0.5, 80, 80), (5, 80, 65), (30, 60, 20), (0.5, 0, 0), (2, 50, 0), (70, 70, 65), (1, 10, 5)]


@pytest.mark.parametrize("decay,entry,retain", SETTINGS)
def test_dense_and_sparse_equal_search(spark, decay, entry, retain):
    series = random_series(int(decay * 10) + entry, 60, 90)
    df = frame(spark, series)
    got = decay_memory(df, {"score": "m"}, decay=decay, entry=entry, retain=retain)
    by_key = {(r.entity, r.date): r.m for r in got.collect()}
    want = {}
    for e, s in enumerate(series):
        for i, state in enumerate(searched(s, decay, entry, retain)):
            want[(f"e{e:04d}", DAY0 + dt.timedelta(days=i))] = state
    assert by_key == pytest.approx(want, abs=1e-4)
    end = DAY0 + dt.timedelta(days=89)
    alive = memory_days(df, decay=decay, entry=entry, retain=retain, end=end)
    rows = alive.collect()
    assert len(rows) == len({(r.entity, r.date) for r in rows})
    assert {(r.entity, r.date): r.score for r in rows} == pytest.approx(
        {k: v for k, v in want.items() if v > 1e-9}, abs=1e-4
    )


def test_default_thresholds_live_as_long_as_defined(spark):
    """80..100 falling by 0.3 to 65: the closed form must not die a day early or late."""
    series = [[float(v)] + [None] * 130 for v in range(60, 101)]
    got = decay_memory(frame(spark, series), {"score": "m"}, decay=0.3, entry=80, retain=65)
    lived = {r.entity: r.n for r in got.groupBy("entity").agg(F.count_if(F.col("m") > 0).alias("n")).collect()}
    want = {f"e{e:04d}": sum(x > 0 for x in searched(s, 0.3, 80, 65)) for e, s in enumerate(series)}
    assert lived == want


def test_hand_cases(spark):
    series = [
        [79, None, None], [80, 66, None, 70], [65, 80, None, None, 65], [80, 0, 0, 0, 79, 80],
        [None, None, 80], [80] + [None] * 4,
    ]
    series = [[None if v is None else float(v) for v in s] for s in series]
    got = decay_memory(frame(spark, series), {"score": "m"}, decay=5, entry=80, retain=65)
    rows = {}
    for r in got.orderBy("date").collect():
        rows.setdefault(r.entity, []).append(r.m)
    assert rows["e0000"] == [0, 0, 0]
    assert rows["e0001"] == [80, 75, 70, 70]
    assert rows["e0002"] == [0, 80, 75, 70, 65]
    assert rows["e0003"] == [80, 75, 70, 65, 79, 80]
    assert rows["e0004"] == [0, 0, 80]
    assert rows["e0005"] == [80, 75, 70, 65, 0]


def test_warmup(spark):
    df = frame(spark, [[90.0, None, None, None]])
    output = (DAY0 + dt.timedelta(days=2), DAY0 + dt.timedelta(days=3))

    def run(warmup):
        out = decay_memory(
            df, {"score": "m"}, decay=5, entry=80, retain=65, output=output, warmup=warmup
        )
        return [r.m for r in out.orderBy("date").collect()]

    assert run(True) == [0, 0, 80, 75]
    assert run(False) == [0, 0, 0, 0]


def test_fill_and_staleness(spark):
    df = frame(spark, [[None, 7.0, None, None, None]]).withColumn("scored", F.col("score").isNotNull())
    filled = forward_fill(df, ["score"])
    assert [r.score for r in filled.orderBy("date").collect()] == [0, 7, 7, 7, 7]
    cut = cut_stale(filled, ["score"], "scored", 2)
    assert [r.score for r in cut.orderBy("date").collect()] == [0, 7, 7, 7, 0]
    assert cut_stale(filled, ["score"], "scored", None) is filled


def test_partition_count_does_not_matter(spark):
    df = frame(spark, random_series(5, 20, 40))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            rows = memory_days(df, decay=3, entry=60, retain=40, end=DAY0 + dt.timedelta(days=39)).collect()
            results.append(sorted(map(tuple, rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
