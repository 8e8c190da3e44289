import datetime as dt
import random

from pyspark.sql import functions as F

from watchpanel.operators import intervals as iv
from watchpanel.operators import panel as pn

D = dt.date(2024, 1, 1)


def day(n):
    return None if n is None else D + dt.timedelta(days=n)


def frame(spark, rows):
    data = [(e, i, day(a), day(b)) for i, (e, a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "entity string, seq int, entry_date date, remove_date date")


def merge_loop(rows):
    """Row by row in order of entry day and input order."""
    out = []
    by_entity = {}
    for i, (e, a, b) in enumerate(rows):
        if a is not None:
            by_entity.setdefault(e, []).append((a, i, 10**6 if b is None else b))
    for e, items in by_entity.items():
        current = None
        for a, i, b in sorted(items):
            if current is None or a > current:
                out.append([e, a, b, i])
                current = b
            elif b > current:
                current = out[-1][2] = b
    return sorted((e, a, b, i) for e, a, b, i in out)


def got_merge(spark, rows):
    out = iv.merge_intervals(frame(spark, rows), "seq").collect()

    def number(d):
        return 10**6 if d == iv.OPEN_END else (d - D).days

    return sorted((r.entity, number(r.entry_date), number(r.remove_date), r.seq) for r in out)


def test_merge_hand_cases(spark):
    rows = [
        ("touch", 0, 5), ("touch", 5, 9), ("inside", 0, 9), ("inside", 2, 4), ("longer", 0, 5),
        ("longer", 3, 12), ("open", 0, None), ("open", 50, 60), ("apart", 0, 1), ("apart", 2, 3),
        ("same", 4, 6), ("same", 4, 9), ("null", None, 5), ("null", 7, 8),
    ]
    assert got_merge(spark, rows) == merge_loop(rows)
    assert ("touch", 0, 9, 0) in got_merge(spark, rows) and ("same", 4, 9, 10) in got_merge(spark, rows)


def test_merge_random_with_backward_intervals(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        a = rng.randrange(60)
        b = None if rng.random() < 0.03 else a + rng.randrange(-4, 9)
        rows.append((f"e{rng.randrange(60)}", a, b))
    assert got_merge(spark, rows) == merge_loop(rows)


def test_status_days_random(spark):
    rng = random.Random(2)
    rows = [
        (f"e{rng.randrange(30)}", a := rng.randrange(-20, 50), None if rng.random() < 0.05 else a + rng.randrange(0, 15))
        for _ in range(200)
    ]
    df = frame(spark, rows)
    start, end = day(0), day(30)

    def as_set(out):
        listed = [(r.entity, (r.date - D).days) for r in out.collect()]
        assert len(listed) == len(set(listed))
        return set(listed)

    anyway, latest = set(), set()
    for e in {r[0] for r in rows}:
        mine = [(a, i, 10**6 if b is None else b) for i, (x, a, b) in enumerate(rows) if x == e]
        for t in range(31):
            if any(a <= t <= b for a, _, b in mine):
                anyway.add((e, t))
            entered = sorted(m for m in mine if m[0] <= t)
            if entered and t <= entered[-1][2]:
                latest.add((e, t))
    assert as_set(iv.status_days_any(df, start, end)) == anyway
    assert as_set(iv.status_days_as_of(df, start, end, "seq")) == latest


def test_entry_events_and_runs(spark):
    days = [0, 1, 2, 5, 6, 9]
    df = spark.createDataFrame([("a", day(n)) for n in days] + [("b", day(3))], "entity string, date date")
    runs = {(r.entity, (r.start_date - D).days, (r.end_date - D).days) for r in iv.day_runs(df).collect()}
    assert runs == {("a", 0, 2), ("a", 5, 6), ("a", 9, 9), ("b", 3, 3)}
    events = {(r.entity, (r.event_date - D).days) for r in iv.entry_days(df, D).collect()}
    assert events == {("a", 5), ("a", 9), ("b", 3)}  # in-status on the first panel day is no event
    panel = iv.panel_status(pn.dense_panel(pn.universe(df), D, day(10)), df)
    dense = iv.entry_events(panel).where("entry_event = 1").collect()
    assert {(r.entity, (r.date - D).days) for r in dense} == events


def test_flag_intervals_use_rows_not_days(spark):
    df = spark.createDataFrame(
        [("a", day(0), 1), ("a", day(5), 1), ("a", day(6), 0), ("a", day(7), 1)], "entity string, date date, f int"
    )
    got = {((r.entry_date - D).days, (r.remove_date - D).days) for r in iv.flag_intervals(df, "f").collect()}
    assert got == {(0, 5), (7, 7)}


def test_urgency_labels(spark):
    status = spark.createDataFrame([("a", day(4)), ("a", day(5))], "entity string, date date")
    panel = iv.panel_status(
        pn.dense_panel(spark.createDataFrame([("a",)], "entity string"), D, day(7)), status
    )
    entries = spark.createDataFrame([("a", day(4)), ("a", day(9))], "entity string, entry_date date")
    got = [r.label for r in iv.urgency_labels(panel, entries).orderBy("date").collect()]
    assert got == [1 / 4, 1 / 3, 1 / 2, 1.0, None, None, 1 / 3, 1 / 2]
    none = entries.where(F.col("entry_date") < F.lit(D))
    assert iv.urgency_labels(panel, none).orderBy("date").first().label == 0.0
