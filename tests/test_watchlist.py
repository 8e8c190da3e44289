import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from watchpanel.operators import watchlist as wl
from watchpanel.operators.ordering import with_position, with_running_total
from watchpanel.operators.summary import describe

D = dt.date(2024, 1, 1)


def day(n):
    return D + dt.timedelta(days=n)


def scores(spark, rows):
    return spark.createDataFrame([(e, day(d), float(s), y) for e, d, s, y in rows], "entity string, date date, score double, y_status int")


def test_top_k_ties_and_status(spark):
    df = scores(spark, [("c", 0, 90, 0), ("a", 0, 90, 0), ("b", 0, 90, 0), ("d", 0, 95, 1), ("e", 0, 50, 0)])
    names = lambda k: sorted(r.entity for r in wl.listed_rows(df, 65, top_k=k).collect())
    assert names(None) == ["a", "b", "c"]
    assert names(2) == ["a"]  # d takes a place, then falls out as in-status
    assert names(0) == []
    assert names(100) == names(5000) == ["a", "b", "c"]


def test_large_k_is_exact(spark):
    rng = random.Random(3)
    rows = [(f"e{i:05d}", i % 2, rng.randrange(60, 70), 0) for i in range(6000)]
    got = {(r.date, r.entity) for r in wl.top_per_day(scores(spark, rows), 1500).collect()}
    want = set()
    for d in (0, 1):
        best = sorted((r for r in rows if r[1] == d), key=lambda r: (-r[2], r[0]))[:1500]
        want |= {(day(d), r[0]) for r in best}
    assert got == want


def test_ranks_with_one_hot_day(spark):
    """One day holds nearly all rows and nearly all scores are equal."""
    rng = random.Random(4)
    rows = [(f"e{i:05d}", 0 if i % 50 else 1 + i % 7, 100 if i % 9 else rng.randrange(70, 100), 0) for i in range(20000)]
    got = wl.ranked(scores(spark, rows)).collect()
    want = {}
    for d in {r[1] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[1] == d), key=lambda r: (-r[2], r[0]))):
            want[(day(d), r[0])] = i + 1
    assert {(r.date, r.entity): r["rank"] for r in got} == want


def test_hot_day_is_cut_into_ranges(spark):
    rows = [(f"e{i:05d}", 0, 80, 0) for i in range(8000)]
    df = scores(spark, rows).repartitionByRange(8, "date", F.desc("score"), "entity")
    sizes = [r[0] for r in df.groupBy(F.spark_partition_id()).count().select("count").collect()]
    assert len(sizes) == 8 and max(sizes) < 2500


def test_arrays_cover_empty_days_and_parts(spark):
    df = scores(spark, [(f"e{i}", 1, 90 - i, 0) for i in range(5)])
    lists = wl.daily_arrays(wl.ranked(df), day(0), day(2), part_size=2).orderBy("date", "part").collect()
    assert [(r.date, r.part, r.entities) for r in lists] == [
        (day(0), 0, []), (day(1), 0, ["e0", "e1"]), (day(1), 1, ["e2", "e3"]), (day(1), 2, ["e4"]), (day(2), 0, []),
    ]


def test_rows_outside_the_days_of_a_document_are_an_error(spark):
    ranked = wl.ranked(scores(spark, [("a", 1, 90, 0), ("b", 5, 90, 0)]))
    for rows, last in ((ranked, day(2)), (ranked.withColumn("rank", F.lit(None).cast("int")), day(9))):
        with pytest.raises(Exception, match="not a ranked row"):
            wl.daily_arrays(rows, day(0), last).collect()


def test_positions_and_running_totals(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 5).alias("w"))
    for parts in (None, 1, 7):
        rows = with_position(df, ["k"], "at", parts=parts).collect()
        assert all(r.k == r["at"] for r in rows) and len(rows) == 5000
    total, want = 0, {}
    for r in sorted(df.collect()):
        total += r.w
        want[r.k] = total
    assert {r.k: r.t for r in with_running_total(df, ["k"], "w", "t").collect()} == want


def test_describe_matches_interpolation(spark):
    import numpy as np

    rng = random.Random(6)
    values = [rng.choice([0.0, rng.randrange(100) / 3]) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "s double")
    for nonzero in (False, True):
        kept = np.array([v for v in values if v > 0 or not nonzero])
        r = describe(df, "s", nonzero=nonzero).first()
        assert r["count"] == len(kept) and r["mean"] == pytest.approx(kept.mean())
        assert r["std"] == pytest.approx(kept.std(ddof=1))
        for q in (50, 70, 80, 90, 95, 99):
            assert r[f"p{q}"] == pytest.approx(np.percentile(kept, q))
    empty = describe(df.where("s > 1e9"), "s").first()
    assert empty["count"] == 0 and empty["p50"] is None


def test_label_maps_keep_nulls(spark):
    df = spark.createDataFrame(
        [(D, "a", 0.12345678, 0), (D, "b", 0.5, 1)], "date date, entity string, v double, e int"
    )
    maps = wl.label_maps(wl.label_rows(df, "v", "e")).collect()
    assert maps[0].labels == {"a": 0.123457, "b": None}


def test_trace_window(spark):
    rows = [("a", i, 0, 0) for i in range(90)] + [("b", i, 70 if i == 45 else 0, 0) for i in range(90)]
    df = scores(spark, rows).withColumn("raw_score", F.col("score"))
    out = wl.decay_trace(df, 65).collect()
    assert {r.entity for r in out} == {"b"} and len(out) == 61
    assert [r.date for r in out if r.listed] == [day(45)]
    quiet = wl.decay_trace(df, 65, entity="a")
    assert quiet.count() == 90
