"""Shape of the physical plans: what is shuffled, pruned and pushed down."""

import re

import pytest

import __spark_entry__ as entry
from checks import data
from checks.registry import QUERIES

SF = "/root/testdata/sf0.001"
TRAINED = {
    "train_urgency_model", "predict_urgency", "prediction_table_csv", "saved_model", "model_setting_sweep",
    "model_setting_search", "training_run_outputs",
}
#: Python workers put files together that are cut inside records, and run scorers that are no expression
PYTHON = {
    "scan_documents_by_year", "scan_documents_pruned_years", "scan_documents_one_file", "daily_watchlist_document",
    "reasoned_watchlist_one_file", "batch_text_scoring_in_python",
}
#: read small results while they are built
GRIDS = {"rule_grid_sweep", "rule_grid_within_budget"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def static(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    yield spark
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_no_product_joins_and_python_only_in_scorers(static):
    """Even with no table small enough to broadcast."""
    for name in sorted(set(QUERIES) - TRAINED):
        plan = plan_of(QUERIES[name](static, SF))
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan, name
        uses_python = "Python" in plan or "InPandas" in plan
        assert uses_python == (name in PYTHON), name


def test_document_limit_is_pruned_before_the_shuffle(static):
    plan = plan_of(QUERIES["daily_text"](static, SF))
    assert plan.count("WindowGroupLimit") == 2
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1
    shuffled = re.search(r"Exchange hashpartitioning\((.*?)\)", plan).group(1)
    assert shuffled.startswith("entity") and "date" in shuffled


def test_texts_are_not_shuffled(static):
    """What crosses the shuffle are composed lines, not document texts."""
    plan = plan_of(QUERIES["daily_text"](static, SF))
    below = plan[plan.index("Exchange hashpartitioning"):]
    limit = below[: below.index("Project")]
    assert "content" not in limit


def test_rank_limit_for_top_k(static):
    assert "WindowGroupLimit" in plan_of(QUERIES["top_k_before_status"](static, SF))


def test_memory_needs_one_sort_and_sparse_shuffles(static):
    from watchpanel.operators.memory import decay_memory

    scores = data.daily_scores(static, SF)
    plan = plan_of(decay_memory(scores, {"score": "m"}, decay=5, entry=80, retain=65))
    assert len(re.findall(r"Exchange ", plan)) == 2  # the daily maximum, then the entity
    assert len(re.findall(r" Sort \[|\- Sort \[", plan)) == 1


def test_dense_panel_is_not_shuffled(static):
    """Days are generated after the last shuffle; the windows over an entity add none."""
    plan = plan_of(QUERIES["decay_memory_two_thresholds"](static, SF))
    above = plan[: plan.index("Generate explode")]
    assert "Exchange" not in above and "Window" in above


def test_filters_and_columns_reach_the_scan(static):
    plan = plan_of(QUERIES["status_runs"](static, SF))
    assert "EqualTo(event_type,signup), GreaterThan(value,100.0)]" in plan
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES["max_score_per_entity_day"](static, SF))).group(1)
    assert "props" not in schema and "event_id" not in schema


def test_prefilter_runs_before_the_scorer(static):
    plan = plan_of(QUERIES["batch_text_scoring_in_python"](static, SF))
    # operators are printed from the last to the first
    assert "regexp_extract_all" in plan[plan.index("MapInPandas"):]
    assert "regexp_extract_all" not in plan[: plan.index("MapInPandas")]


def test_entry_contract(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "rank", "entity", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    # the training-data operators are registered beside these queries, never among them
    assert all(not re.match(r"op\d+_", n) for n in QUERIES)
