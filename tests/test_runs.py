"""Runs are visible whole or not at all."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from checks.data import MODEL
from tests.test_model import inputs  # noqa: F401
from watchpanel.plans import model_track as mt
from watchpanel.sources import runs


def write(spark, run, name):
    spark.range(3).write.parquet(run.path(name))


def test_a_run_is_visible_after_its_manifest_only(spark, tmp_path):
    base = f"file://{tmp_path}/runs"
    assert runs.committed_runs(spark, base) == []
    first = runs.RunWriter(spark, base)
    write(spark, first, "a")
    assert runs.committed_runs(spark, base) == []
    with pytest.raises(FileNotFoundError):
        runs.open_run(spark, base)
    first.commit({"n": 3, "day": dt.date(2024, 1, 2)})
    second = runs.RunWriter(spark, base)
    write(spark, second, "a")
    found = runs.open_run(spark, base)
    assert found.run == first.run and found.facts == {"n": 3, "day": "2024-01-02"}
    assert spark.read.parquet(found.paths["a"]).count() == 3
    second.commit()
    assert runs.committed_runs(spark, base) == [first.run, second.run]
    assert runs.open_run(spark, base).run == second.run
    assert runs.open_run(spark, base, first.run).run == first.run
    with pytest.raises(FileNotFoundError):
        runs.open_run(spark, base, "other")


def test_missing_outputs_and_second_commits_are_refused(spark, tmp_path):
    run = runs.RunWriter(spark, f"file://{tmp_path}")
    run.path("a")
    with pytest.raises(FileNotFoundError):
        run.commit()
    with pytest.raises(ValueError):
        run.path("a")
    other = runs.RunWriter(spark, f"file://{tmp_path}")
    write(spark, other, "a")
    other.commit()
    with pytest.raises(FileExistsError):
        other.commit()


def test_unfinished_runs_go_when_they_are_old(spark, tmp_path):
    base = f"file://{tmp_path}"
    old = runs.RunWriter(spark, base, run="20200101T000000000000-aaaa")
    write(spark, old, "a")
    done = runs.RunWriter(spark, base, run="20200101T000000000000-bbbb")
    write(spark, done, "a")
    done.commit()
    new = runs.RunWriter(spark, base)
    write(spark, new, "a")
    assert runs.drop_unfinished(spark, base, dt.timedelta(days=1)) == [old.run]
    assert sorted(p.name for p in tmp_path.iterdir() if p.is_dir()) == sorted([done.run, new.run])


def test_a_killed_training_run_leaves_nothing_visible(spark, inputs, tmp_path, monkeypatch):  # noqa: F811
    scores, labels = inputs
    base = f"file://{tmp_path}/runs"

    def killed(*args, **kwargs):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(mt, "label_maps", killed)
        with pytest.raises(KeyboardInterrupt):
            mt.write_run(scores, labels, MODEL, base)
    assert runs.committed_runs(spark, base) == [] and any((tmp_path / "runs").iterdir())


def test_the_model_scores_each_row_once(spark, inputs, tmp_path, monkeypatch):  # noqa: F811
    """Lists, intervals and labels are read from the written table, not predicted again."""
    scores, labels = inputs
    seen = []
    real = mt.predict
    monkeypatch.setattr(mt, "predict", lambda *a, **k: seen.append(1) or real(*a, **k))
    base = f"file://{tmp_path}/runs"
    run = mt.write_run(scores, labels, MODEL, base)
    found = runs.open_run(spark, base, run)
    table = spark.read.parquet(found.paths["table"])
    assert len(seen) == 1 and found.facts["rows"] == table.count()
    assert found.facts["blacklist_daily_rows"] == table.where("predicted and predicted_blacklist = 1").count()
    assert spark.read.json(found.paths["metadata"]).count() == 1
    assert set(found.paths) == {
        "table", "predictions", "history_daily", "predicted_daily", "blacklist_daily", "history_intervals",
        "predicted_intervals", "predicted_labels", "model", "metadata",
    }
    listed = spark.read.text(found.paths["blacklist_daily"]).agg(F.count(F.lit(1))).first()[0]
    assert listed == (MODEL.predict_end - MODEL.predict_start).days + 1
