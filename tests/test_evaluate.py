import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from watchpanel.operators import evaluate as ev
from watchpanel.operators import intervals as iv
from watchpanel.operators import panel as pn

D = dt.date(2024, 1, 1)
DAYS = 40


def day(n):
    return D + dt.timedelta(days=n)


def make(spark, seed, entities=40):
    rng = random.Random(seed)
    listed, status = {}, {}
    for e in range(entities):
        name = f"e{e:02d}"
        on, inside = False, False
        listed[name], status[name] = [], []
        for _ in range(DAYS):
            on = rng.random() < (0.8 if on else 0.25)
            inside = rng.random() < (0.7 if inside else 0.12)
            listed[name].append(on)
            status[name].append(inside)
    def frame(table):
        rows = [(e, day(i)) for e, s in table.items() for i, x in enumerate(s) if x]
        return spark.createDataFrame(rows, "entity string, date date")
    return listed, status, frame(listed), frame(status)


def run_rule(listed, status, min_lead, horizon, first, last):
    correct, hits, events = set(), set(), set()
    for e in listed:
        eff = [a and not b for a, b in zip(listed[e], status[e])]
        entry = [i > 0 and status[e][i] and not status[e][i - 1] for i in range(DAYS)]
        events |= {(e, i) for i in range(DAYS) if entry[i] and first <= i <= last}
        i = 0
        while i < DAYS:
            if not eff[i]:
                i += 1
                continue
            s = i
            while i < DAYS and eff[i]:
                i += 1
            if i < DAYS and entry[i] and min_lead <= i - s <= horizon and first <= i <= last:
                correct |= {(e, x) for x in range(s, i)}
                hits.add((e, i))
    return correct, hits, events


@pytest.mark.parametrize("min_lead,horizon,first,last", [(1, 365, 0, 39), (2, 4, 5, 33), (1, 1, 0, 39)])
def test_run_rule(spark, min_lead, horizon, first, last):
    listed, status, l_df, s_df = make(spark, 7)
    correct, hits, events = run_rule(listed, status, min_lead, horizon, first, last)
    effective = l_df.join(s_df, ["entity", "date"], "left_anti")
    got_events = iv.entry_days(s_df, D)
    matches = ev.match_runs(
        effective, got_events, min_lead=min_lead, horizon=horizon, output=(day(first), day(last))
    )
    got = {(r.entity, (r.date - D).days) for r in ev.matched_days(matches).collect()}
    assert got == correct
    assert {(r.entity, (r.event_date - D).days) for r in matches.collect()} == hits
    output = (day(first), day(last))
    daily = ev.daily_metrics(effective, ev.matched_days(matches), s_df, output=output, market_n=100)
    rows = {(r.date - D).days: r for r in daily.collect()}
    assert sorted(rows) == list(range(first, last + 1))
    for i, r in rows.items():
        n = sum(listed[e][i] and not status[e][i] for e in listed)
        c = sum((e, i) in correct for e in listed)
        st = sum(status[e][i] for e in listed)
        assert (r.listed_cnt, r.correct_cnt, r.status_cnt) == (n, c, st)
        assert r.daily_acc == (pytest.approx(c / n) if n else None)
        assert r.daily_fpr == pytest.approx((n - c) / (100 - st - c))
    marked = got_events.where(F.col("event_date").between(*map(F.lit, output))).join(
        matches.select("entity", "event_date", F.lit(1).alias("hit")), ["entity", "event_date"], "left"
    ).withColumn("hit", F.coalesce("hit", F.lit(0)))
    total = ev.overall_metrics(daily, marked, {"market_n": 100}).first()
    assert (total.total_events, total.hit_events) == (len(events), len(hits))
    assert total.recall == pytest.approx(len(hits) / len(events)) and total.market_n == 100


@pytest.mark.parametrize("min_lead,horizon", [(1, 5), (3, 10), (1, 365)])
def test_label_rule(spark, min_lead, horizon):
    listed, status, l_df, s_df = make(spark, 11)
    panel = pn.with_predictions(
        iv.panel_status(pn.dense_panel(pn.universe(l_df, s_df), D, day(DAYS - 1)), s_df), l_df
    )
    label = F.lit(1.0) / (F.dayofmonth("date"))
    rows = ev.label_band_correct(
        iv.entry_events(panel.withColumn("st_label_value", label)), min_lead=min_lead, horizon=horizon
    )
    got = {(r.entity, (r.event_date - D).days): r.hit for r in ev.event_recall(rows, min_lead=min_lead, horizon=horizon).collect()}
    want = {}
    for e in listed:
        for i in range(1, DAYS):
            if status[e][i] and not status[e][i - 1]:
                window = range(max(0, i - horizon), max(0, i - min_lead + 1))
                want[(e, i)] = int(any(listed[e][x] and not status[e][x] for x in window))
    assert got == want
    good = {(r.entity, (r.date - D).days) for r in rows.where("correct = 1").collect()}
    assert good == {
        (e, i) for e in listed for i in range(DAYS)
        if listed[e][i] and not status[e][i] and min_lead <= day(i).day <= horizon
    }
    daily = ev.daily_metrics_from_panel(rows, 5400)
    assert daily.count() == DAYS


def test_nothing_listed_gives_null_accuracy(spark):
    none = spark.createDataFrame([], "entity string, date date")
    daily = ev.daily_metrics(none, none, none, output=(D, day(2)), market_n=10)
    assert [(r.listed_cnt, r.daily_acc, r.daily_fpr) for r in daily.collect()] == [(0, None, 0.0)] * 3
    events = spark.createDataFrame([], "entity string, event_date date, hit int")
    total = ev.overall_metrics(daily, events).first()
    assert total.acc is None and total.recall is None and total.total_events == 0


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 2.0)], "t double, p double")
    r = ev.regression_metrics(df, "t", "p").first()
    assert r.mae == 1.5 and r.rmse == pytest.approx((2.5) ** 0.5)
