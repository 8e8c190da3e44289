"""Drawn settings, successive halving, ensembles of the first trees."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from checks.data import MODEL
from tests.test_model import inputs  # noqa: F401
from watchpanel.operators import model as md
from watchpanel.operators import search as sr
from watchpanel.operators.features import feature_columns
from watchpanel.operators.sweep import SEARCH_RANGES
from watchpanel.plans import model_track as mt
from watchpanel.sources.storage import materialize


def test_draws_are_seeded_and_inside_their_ranges():
    trials = sr.draw_trials(200, 7)
    assert trials == sr.draw_trials(200, 7) and trials != sr.draw_trials(200, 8)
    for name, (low, high, scale) in SEARCH_RANGES.items():
        values = [t[name] for t in trials]
        assert low <= min(values) and max(values) <= high and len(set(values)) > 2
        middle = (low * high) ** 0.5 if scale == "log" else (low + high) / 2
        assert 70 <= sum(v < middle for v in values) + (scale == "whole") * 30 <= 160
    assert all(isinstance(t["max_iter"], int) and isinstance(t["max_depth"], int) for t in trials)


def test_halving_sizes():
    assert sr.halving_sizes(9, 3, 1 / 3) == [9, 3, 1]
    assert sr.halving_sizes(10, 3, 1 / 3) == [10, 4, 2]
    assert sr.halving_sizes(1, 3, 1 / 3) == [1, 1, 1]


def test_objective():
    assert sr.objective({"acc": 0.75, "fpr": 0.25}) == 0.5
    assert sr.objective({"acc": None, "fpr": None}) == -1.0


@pytest.fixture(scope="module")
def prepared(spark, inputs):  # noqa: F811
    scores, labels = inputs
    frame = materialize(mt.feature_frame(scores, labels, MODEL))
    truth = scores.select("entity", "date", F.lit(0).alias("y_status"), (F.col(scores.columns[2]) / 100).alias("st_label_value"))
    return frame, truth


def test_first_trees_are_the_smaller_ensemble(spark, prepared):
    frame, _ = prepared
    rows = frame.where("y_label_numeric_available = 1")
    params = replace(MODEL, max_iter=7, step_size=0.3, max_depth=3)
    model = md.fit_regressor(rows, feature_columns(), params)
    small = md.fit_regressor(rows, feature_columns(), replace(params, max_iter=3))
    staged = sr.staged_predictions(model, frame, [3, 7])
    for n, fitted in ((3, small), (7, model)):
        want = md.predict(fitted, frame).select("entity", "date", F.lit(n).alias("trees"), "predicted_label_value")
        got = staged.where(F.col("trees") == n)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    with pytest.raises(ValueError):
        sr.first_trees(model, 8)


def test_search_keeps_the_best_and_reports_failures(spark, prepared):
    frame, truth = prepared
    trials = [{"zero_ratio": 1.0, "label_threshold": t, "max_iter": 6, "step_size": 0.5, "max_depth": 2} for t in (0.9, 0.2, 0.1, 0.05)]

    def fit(df, features, params):
        if params.label_threshold == 0.1:
            raise RuntimeError("cannot be trained")
        return md.fit_regressor(df, features, params)

    found = sr.search_settings(frame, truth, MODEL, trials, rungs=(0.5, 1.0), keep=0.5, stages=(0.5, 1.0), concurrent=2, fit=fit)
    rows = [r.asDict() for r in found.results.collect()]
    first = {r["trial"]: r["objective"] for r in rows if r["rung"] == 0}
    assert set(first) == {0, 1, 2, 3} and first[2] is None
    assert [r["failure"] for r in rows if r["trial"] == 2] == ["RuntimeError"]
    chosen = sorted((t for t in first if first[t] is not None), key=lambda t: (-first[t], t))[:2]
    assert {r["trial"] for r in rows if r["rung"] == 1} == set(chosen)
    assert {(r["rung"], r["trees"]) for r in rows} == {(0, 3), (1, 3), (1, 6)}
    # the first trees of the full fit score as the fit of the first rung did
    again = {r["trial"]: r["objective"] for r in rows if r["rung"] == 1 and r["trees"] == 3}
    assert all(again[t] == pytest.approx(first[t]) for t in chosen)
    (best,) = found.best.collect()
    assert best.objective == max(r["objective"] for r in rows if r["rung"] == 1)
    assert best.max_iter == 6.0


def test_trials_run_in_pools_of_their_own(spark, prepared):
    frame, truth = prepared
    seen = {}

    def fit(df, features, params):
        seen[params.label_threshold] = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
        return md.fit_regressor(df, features, params)

    trials = [{"label_threshold": t, "max_iter": 1, "max_depth": 1} for t in (0.1, 0.2)]
    sr.search_settings(frame, truth, MODEL, trials, rungs=(1.0,), concurrent=2, fit=fit)
    assert seen == {0.1: "trial-0", 0.2: "trial-1"}
    assert spark.sparkContext.getLocalProperty("spark.scheduler.pool") is None
