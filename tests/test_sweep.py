"""The rule grid against a day-by-day loop, and what its plan shuffles."""

import datetime as dt
import random

import pytest

from watchpanel.operators import sweep as sw

FIRST = dt.date(2024, 1, 1)


def day(n):
    return FIRST + dt.timedelta(days=n)


def brute(scores, status, events, grid, first, last, min_lead, horizon, market_n):
    out = {}
    entities = sorted({e for e, _ in scores})
    for g, entry, retain, decay in grid:
        listed = set()
        for e in entities:
            state = 0.0
            for t in range(-10, last + 1):
                v = scores.get((e, t), 0.0)
                state = max(state - decay, 0.0)
                if v > 0 and state > 0:
                    state = max(state, v)
                elif v > 0 and v >= entry:
                    state = v
                if state < retain:
                    state = 0.0
                if state > 0 and (e, t) not in status:
                    listed.add((e, t))
        correct, hits = set(), 0
        for e, t in listed:
            if (e, t + 1) in listed or (e, t + 1) not in events or not first <= t + 1 <= last:
                continue
            start = t
            while (e, start - 1) in listed:
                start -= 1
            if min_lead <= t + 1 - start <= horizon:
                hits += 1
                correct |= {(e, d) for d in range(start, t + 1)}
        size, acc, fpr = [], [], []
        for t in range(first, last + 1):
            n, c = sum(d == t for _, d in listed), sum(d == t for _, d in correct)
            s = sum(d == t for _, d in status)
            size.append(n)
            if n:
                acc.append(c / n)
            if market_n - s - c > 0:
                fpr.append((n - c) / (market_n - s - c))
        total = sum(first <= t <= last for _, t in events)
        out[g] = (
            sum(size) / len(size), sum(acc) / len(acc) if acc else None, sum(fpr) / len(fpr) if fpr else None,
            hits, total, hits / total if total else None,
        )
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_grid_against_a_loop(spark, seed, monkeypatch):
    draw = random.Random(seed)
    monkeypatch.setattr(sw, "MATRIX_CELLS", 100)
    entities = [f"{i:06d}" for i in range(40)]
    scores = {(e, draw.randint(-8, 20)): draw.choice([0.0, 30.0, 50.0, 55.0, 70.0, 80.0, 90.5, 100.0]) for e in entities for _ in range(7)}
    status = {(e, t) for e in entities[:25] for s in [draw.randint(0, 18)] for t in range(s, min(s + 4, 21))}
    events = {(e, t) for e, t in status if (e, t - 1) not in status} | {("x", 3), (entities[30], 25)}
    grid = sw.rule_grid([50, 70, 80], [30, 55, 70], [0.0, 2.5, 10.0])
    frames = [
        spark.createDataFrame([(e, day(t), v) for (e, t), v in scores.items()], "entity string, date date, score double"),
        spark.createDataFrame([(e, day(t)) for e, t in status], "entity string, date date"),
        spark.createDataFrame([(e, day(t)) for e, t in events], "entity string, event_date date"),
    ]
    found = sw.sweep_rules(*frames, grid, output=(day(0), day(20)), min_lead=1, horizon=12, market_n=60).collect()
    want = brute(scores, status, events, grid, 0, 20, 1, 12, 60)
    assert len(found) == len(grid) == len(want)
    for r in found:
        got = (r.avg_list_size, r.acc, r.fpr, r.hit_events, r.total_events, r.recall)
        for a, b in zip(got, want[r.grid_id]):
            assert (a is None and b is None) or a == pytest.approx(b), (r, want[r.grid_id])


def test_no_scores_at_all(spark):
    empty = spark.createDataFrame([], "entity string, date date, score double")
    none = spark.createDataFrame([], "entity string, date date")
    events = spark.createDataFrame([], "entity string, event_date date")
    grid = sw.rule_grid([80], [65], [1.0])
    (row,) = sw.sweep_rules(empty, none, events, grid, output=(day(0), day(4)), min_lead=1, horizon=5, market_n=10).collect()
    assert (row.avg_list_size, row.acc, row.fpr, row.hit_events, row.total_events, row.recall) == (0.0, None, 0.0, 0, 0, None)


def test_shuffled_rows_do_not_grow_with_the_thresholds(spark, monkeypatch):
    """What meets by entity is the scored days; the grid comes after."""
    plans = []
    monkeypatch.setattr(sw, "materialize", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    scores = spark.createDataFrame([("a", day(0), 90.0)], "entity string, date date, score double")
    none = spark.createDataFrame([("a", day(3))], "entity string, date date")
    events = none.withColumnRenamed("date", "event_date")
    for grid in (sw.rule_grid([80], [65], [1.0]), sw.rule_grid(range(50, 100), range(20, 50), [1.0])):
        sw.sweep_rules(scores, none, events, grid, output=(day(0), day(4)), min_lead=1, horizon=5, market_n=10)
    small, large = plans
    assert "Generate" not in large and "Expand" not in large
    assert [line.strip().split(" ")[0] for line in small.splitlines()] == [line.strip().split(" ")[0] for line in large.splitlines()]
