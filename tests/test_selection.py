"""Selection against sorting, with few buckets so that several passes are needed."""

import random

import pytest
from pyspark.sql import functions as F

from watchpanel.operators import model as md
from watchpanel.operators import selection as sl
from watchpanel.operators import summary as sm
from watchpanel.operators.ordering import with_position


@pytest.mark.parametrize("buckets, ordered", [(2, 1), (7, 3), (1 << 14, 10_000)])
def test_smallest(spark, buckets, ordered):
    draw = random.Random(buckets)
    keys = [draw.choice([-(1 << 63), (1 << 63) - 1, 0, -1, 5, draw.getrandbits(64) - (1 << 63), draw.randrange(100)]) for _ in range(120)]
    rows = list(enumerate(keys))
    df = spark.createDataFrame(rows, "i int, k long")
    for n in (1, 50, 119, 120, 500):
        want = sorted((k, i) for i, k in rows)[:n]
        found = sl.smallest(df, F.col("k"), n, ["i"], buckets=buckets, ordered=ordered)
        assert found.columns == ["i", "k"]
        assert sorted((r.k, r.i) for r in found.collect()) == want
    assert sl.smallest(df.limit(0), F.col("k"), 3, ["i"]).collect() == []


@pytest.mark.parametrize("buckets, ordered", [(2, 1), (5, 2), (1 << 14, 10_000)])
def test_values_at(spark, buckets, ordered):
    draw = random.Random(ordered)
    values = [draw.choice([0.0, -1e300, 1e300, 5e-324, 1.5, draw.random(), draw.expovariate(1e-3)]) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    found = sl.values_at(df, "v", "n", [0, 1, 30, 58, 59], buckets=buckets, ordered=ordered)
    assert found == {p: sorted(values)[p] for p in (0, 1, 30, 58, 59)}
    assert sl.values_at(df.limit(0), "v", "n", [0]) == {}


def test_describe_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None,), (4.0,)], "x double")
    row = sm.describe(df, "x").first().asDict()
    assert row["count"] == 1 and row["std"] is None and row["p50"] == row["p99"] == row["mean"] == 4.0
    empty = sm.describe(df.limit(0), "x").first().asDict()
    assert empty["count"] == 0 and empty["mean"] is None and empty["p50"] is None


def test_positions_need_one_shuffle(spark):
    """Positions follow from places in the ranges; rows are not dealt out again by group."""
    df = spark.range(2000).select((F.col("id") % 3).alias("g"), F.col("id").alias("x"))
    placed = with_position(df, [F.desc("x")], "p", group=["g"])
    plan = placed._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "Sort [_ordering_range" not in physical and "RangePartitioning" not in physical
    want = {(i % 3, i): sum(1 for j in range(i + 1, 2000) if j % 3 == i % 3) for i in range(0, 2000, 97)}
    got = {(r.g, r.x): r.p for r in placed.collect()}
    assert len(got) == 2000 and all(got[k] == v for k, v in want.items())


def test_sample_sorts_one_bucket_at_most(spark, monkeypatch):
    """The zero rows that are ordered are those of one bucket."""
    df = spark.range(5000).select(
        F.format_string("%06d", "id").alias("entity"), F.lit("2024-01-01").cast("date").alias("date"),
        F.when(F.col("id") < 100, 1.0).otherwise(0.0).alias("y_label_value"),
    )
    monkeypatch.setattr(md, "materialize", lambda x: x)
    sample = md.balanced_sample(df, 7.0, 42)
    plan = sample._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("GlobalLimit") == 1 and "RepartitionByExpression" not in plan
    assert sample.where("y_label_value = 0").count() == 700 and sample.where("y_label_value > 0").count() == 100
