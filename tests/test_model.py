import datetime as dt
import threading
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks.data import MODEL
from watchpanel import fixed_values as fv
from watchpanel.operators import features as ft
from watchpanel.operators import model as md
from watchpanel.operators import panel as pn
from watchpanel.plans import model_track as mt

D = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def inputs(spark):
    """Urgency grows with the first dimension; status and unlabelled entities included."""
    rows = spark.range(30 * 30).select(
        F.format_string("%06d", F.floor(F.col("id") / 30)).alias("entity"),
        F.date_add(F.lit(D), (F.col("id") % 30).cast("int")).alias("date"),
        F.pmod(F.xxhash64("id"), F.lit(100)).cast("double").alias("a"),
        F.pmod(F.xxhash64("id", F.lit(1)), F.lit(100)).cast("double").alias("b"),
    )
    scores = rows.select("entity", "date", F.col("a").alias(fv.DIMS[0]), F.col("b").alias(fv.DIMS[1]),
                         *[F.lit(0.0).alias(d) for d in fv.DIMS[2:]])
    labels = rows.where("entity < '000025'").select(
        "entity", "date", F.lit(1).alias("label_in_file"), (F.col("b") > 95).cast("int").alias("y_label_empty"),
        F.when(F.col("b") <= 95, F.when(F.col("a") > 40, F.col("a") / 100).otherwise(F.lit(0.0))).alias("y_label_value"),
    )
    return scores, labels


def test_sample_has_exact_size_and_is_repeatable(spark, inputs):
    scores, labels = inputs
    df = pn.with_labels(scores, labels).where("y_label_numeric_available = 1")
    positive, zero = df.where("y_label_value > 0").count(), df.where("y_label_value = 0").count()
    for ratio in (0.25, 0.5, 50.0):
        s = md.balanced_sample(df, ratio, 1)
        assert s.where("y_label_value > 0").count() == positive
        assert s.where("y_label_value = 0").count() == min(zero, max(int(positive * ratio), 1))
    keys = lambda seed: {(r.entity, r.date) for r in md.balanced_sample(df, 0.3, seed).collect()}
    assert keys(1) == keys(1) and keys(1) != keys(2)


def test_time_split_falls_back(spark, inputs):
    scores, labels = inputs
    df = pn.with_labels(scores, labels).where("y_label_numeric_available = 1")
    early, late = md.time_split(df, dt.date(2024, 1, 20), 1)
    assert early.agg(F.max("date")).first()[0] < dt.date(2024, 1, 20) <= late.agg(F.min("date")).first()[0]
    early, late = md.time_split(df, dt.date(2030, 1, 1), 1)
    n, m = early.count(), late.count()
    assert n + m == df.count() and 0.75 < n / (n + m) < 0.85


def test_training_beats_the_mean_and_repeats(spark, inputs):
    scores, labels = inputs
    params = replace(MODEL, max_iter=6, step_size=0.4, zero_ratio=1.0)
    first, second = mt.run(scores, labels, params), mt.run(scores, labels, params)
    metrics = first.metrics.first()
    assert metrics.validation_mae < 0.15 and metrics.sampled_rows > 0
    def values(r):
        return {(x.entity, x.date): x.predicted_label_value for x in r.predicted.collect()}
    assert values(first) == values(second)
    rows = first.predictions
    assert rows.where("predicted_label_value < 0 or predicted_label_value > 1").count() == 0
    # rows outside the training period lose their label columns, listing flags stay
    late = rows.where(F.col("date") > F.lit(params.train_end))
    assert late.where("label_in_file is not null or y_label_empty is not null").count() == 0
    assert late.where("predicted_blacklist is null").count() == 0
    assert rows.where("y_label_empty = 1 and predicted_blacklist = 1").count() == 0


def test_both_fits_run_side_by_side(spark, inputs, monkeypatch):
    """Neither fit waits for the other, and each has its own rows."""
    scores, labels = inputs
    frame = mt.feature_frame(scores, labels, MODEL)
    params = replace(MODEL, max_iter=2)
    both, fit, rows = threading.Barrier(2), md.fit_regressor, []

    def met(df, *args):
        both.wait(60)
        rows.append(df.count())
        return fit(df, *args)

    monkeypatch.setattr(md, "fit_regressor", met)
    model, metrics = md.train(frame, ft.feature_columns(), params)
    counted = metrics.first()
    assert max(rows) == counted.sampled_rows > min(rows) and counted.validation_mae <= counted.validation_rmse
    labelled = frame.where("y_label_numeric_available = 1")
    alone = fit(md.balanced_sample(labelled, params.zero_ratio, params.seed), ft.feature_columns(), params)
    total = lambda m: md.predict(m, frame).agg(F.sum("predicted_label_value")).first()[0]
    assert total(model) == pytest.approx(total(alone))


def test_feature_frame(spark, inputs):
    scores, _ = inputs
    rows = ft.with_features(scores).where("entity = '000007'").orderBy("date").collect()
    assert {r.entity_id for r in rows} == {7} and len(rows) == 30
    mean = sum(r.financial_risk for r in rows) / 30
    assert all(r.financial_risk_month_mean == pytest.approx(mean) for r in rows)
    so_far = ft.month_means(scores, as_of=True).where("entity = '000007'").orderBy("date").first()
    assert so_far.financial_risk_month_mean == pytest.approx(rows[0].financial_risk)
    r = rows[3]
    assert r.risk_max == max(r.financial_risk, r.normative_risk) and r.quarter == 1 and r.dayofyear == 4


def test_save_and_load(spark, inputs, tmp_path):
    scores, labels = inputs
    frame = mt.feature_frame(scores, labels, MODEL)
    model = md.fit_regressor(
        frame.where("y_label_numeric_available = 1"), ft.feature_columns(), replace(MODEL, max_iter=2)
    )
    md.save_model(model, str(tmp_path), 0.02, ft.feature_columns())
    loaded, threshold, names = md.load_model(str(tmp_path))
    assert threshold == 0.02 and names == ft.feature_columns()
    total = lambda m: md.predict(m, frame).agg(F.sum("predicted_label_value")).first()[0]
    assert total(model) == pytest.approx(total(loaded))


def test_incomplete_panels_are_refused(spark):
    rows = [("a", D), ("a", D + dt.timedelta(days=1)), ("b", D)]
    df = spark.createDataFrame(rows, "entity string, date date")
    with pytest.raises(ValueError, match="complete"):
        pn.require_complete_panel(df)
    with pytest.raises(ValueError, match="empty"):
        pn.require_complete_panel(df.limit(0))
    pn.require_complete_panel(df.where("entity = 'a'"))


def test_joins_with_defaults(spark, inputs):
    scores, labels = inputs
    rows = pn.with_labels(scores, labels)
    outside = rows.where("label_in_file = 0").select("y_label_empty", "y_label_value").distinct().collect()
    assert [tuple(r) for r in outside] == [(0, 0.0)]
    blank = rows.where("y_label_empty = 1").select("y_label_value", "y_label_numeric_available").distinct().collect()
    assert [tuple(r) for r in blank] == [(None, 0)]
