"""List evaluation from bitmaps against the dense panel."""

import datetime as dt
import random

import pytest

from checks.data import MODEL
from watchpanel.operators import bitmaps as bm
from watchpanel.plans import model_track as mt

FIRST = dt.date(2024, 1, 1)


def frames(spark, seed, n_days, gap=()):
    draw = random.Random(seed)
    days = [d for d in range(n_days) if d not in gap]
    entities = [f"{i:06d}" for i in range(12)]
    at = lambda d: FIRST + dt.timedelta(days=d)
    keys = [(e, at(d)) for e in entities for d in days] * 2
    truth, listed = [], []
    for e in entities[:9] + ["outside"]:
        status = {d for s in [draw.randrange(n_days) for _ in range(3)] for d in range(s, s + 4)}
        for d in range(-3, n_days + 3):
            if draw.random() < 0.7:
                label = None if d in status else draw.choice([0.0, 0.04, 0.05, 0.2, 1.0, 1.5])
                truth.append((e, at(d), 1, int(d in status), label))
            if draw.random() < 0.2:
                listed.append((e, at(d)))
    return (
        spark.createDataFrame(keys, "entity string, date date"),
        spark.createDataFrame(truth, "entity string, date date, label_in_file int, y_status int, st_label_value double"),
        spark.createDataFrame(listed + listed[:5], "entity string, date date"),
        at(0), at(n_days - 1),
    )


@pytest.mark.parametrize("seed, n_days, gap", [(1, 30, ()), (2, 64, ()), (3, 65, (10, 11, 63, 64)), (4, 200, (0, 128, 199))])
def test_against_the_dense_panel(spark, seed, n_days, gap):
    keys, truth, listed, start, end = frames(spark, seed, n_days, gap)
    params = MODEL.__class__(**{**MODEL.__dict__, "horizon_days": 20, "market_n": 40})
    got = mt.evaluate(keys, truth, listed, start=start, end=end, params=params)
    want = mt.evaluate(keys, truth, listed, start=start, end=end, params=params, check_panel=False)
    for a, b in zip(got, want):
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted(map(repr, map(tuple, x.select(sorted(a.columns)).collect()))) for x in (a, b)]
        rounded = [[tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in x.select(sorted(a.columns)).collect()] for x in (a, b)]
        assert sorted(map(repr, rounded[0])) == sorted(map(repr, rounded[1])), rows


def test_incomplete_and_empty_panels_are_refused(spark):
    keys, truth, listed, start, end = frames(spark, 5, 30)
    lacking = keys.where("not (entity = '000003' and date = '2024-01-05')")
    for bad, message in ((lacking, "not a complete"), (keys.limit(0), "empty")):
        with pytest.raises(ValueError, match=message):
            mt.evaluate(bad, truth, listed, start=start, end=end, params=MODEL)


def test_one_shuffle_by_entity(spark):
    keys, truth, listed, start, end = frames(spark, 6, 30)
    maps = bm.day_bitmaps(keys, truth, listed, start, end, min_lead=1, horizon=20)
    plan = maps._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning(entity") == physical.count("Exchange") == 1
    assert "partial_bit_or" in physical
