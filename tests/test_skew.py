"""One key with a third of all rows: same results, reduced before the shuffle."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from watchpanel.operators import documents as dc
from watchpanel.operators import intervals as iv
from watchpanel.operators import panel as pn
from watchpanel.operators.watchlist import ranked
from watchpanel.params import TextParams
from watchpanel.plans.rule_track import daily_max

N = 60_000
D = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    """A third of the rows on one entity, nearly all of those on one day."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(N).repartition(8).select(
        i,
        F.when(hot, F.lit("hot")).otherwise(F.format_string("e%04d", i % 997)).alias("entity"),
        F.date_add(F.lit(D), F.when(hot & (i % 10 != 0), F.lit(7)).otherwise((i % 30).cast("int"))).alias("date"),
    )


def test_daily_max(rows):
    dims = ("financial_risk", "normative_risk", "illegal_risk", "other_risk")
    scores = rows.select("entity", "date", *[(F.pmod(F.xxhash64("id", F.lit(d)), F.lit(100))).cast("double").alias(d) for d in dims])
    out = daily_max(scores)
    assert "partial_max" in out._jdf.queryExecution().executedPlan().toString()
    hot = out.where("entity = 'hot' and date = '2024-01-08'").first().score
    assert hot == 99.0 and out.count() == rows.select("entity", "date").distinct().count()


def test_merge_of_a_hot_entity_holds_one_row_per_day(rows):
    df = rows.select(
        "entity", F.col("id").alias("seq"), F.col("date").alias("entry_date"),
        F.date_add("date", F.pmod("id", F.lit(3)).cast("int")).alias("remove_date"),
    )
    merged = iv.merge_intervals(df, "seq")
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(remove_date" in plan
    assert merged.where("entity = 'hot'").count() >= 1
    # whole cover is kept
    days = iv.status_days_any(df, D, D + dt.timedelta(days=40))
    want = df.select("entity", F.explode(F.sequence("entry_date", "remove_date")).alias("date")).distinct()
    assert days.exceptAll(want).count() == 0 and want.exceptAll(days).count() == 0


def test_latest_per_key(rows):
    out = pn.latest_per_key(rows.withColumn("v", F.col("id") * 2), "id")
    want = rows.groupBy("entity", "date").agg(F.max("id").alias("id"))
    assert out.select("entity", "date", "id").exceptAll(want).count() == 0


def test_first_documents_of_a_hot_day(rows):
    docs = rows.select(
        "id", "entity", F.col("date").cast("timestamp").alias("publish_date"), F.lit("类").alias("category_name"),
        F.format_string("t%d", F.col("id")).alias("title"), F.lit("正文").alias("content"),
    )
    out = dc.daily_text(docs, D, D + dt.timedelta(days=40), TextParams())
    hot = out.where("entity = 'hot' and date = '2024-01-08'").first().doc_text
    first = [r.id for r in rows.where("entity = 'hot' and date = '2024-01-08'").orderBy("id").limit(3).collect()]
    assert hot == "；".join(f"类：t{i}；正文要点：正文" for i in first)
    assert out.count() == rows.select("entity", "date").distinct().count()


def test_ranks_of_a_hot_day(rows):
    listed = rows.select(F.format_string("x%06d", "id").alias("entity"), "date", F.lit(80.0).alias("score"))
    out = ranked(listed)
    top = out.groupBy("date").agg(F.max("rank").alias("n"), F.count_distinct("rank").alias("m"))
    sizes = {r.date: r["count"] for r in listed.groupBy("date").count().collect()}
    assert {r.date: (r.n, r.m) for r in top.collect()} == {d: (n, n) for d, n in sizes.items()}


def test_all_documents_without_limits(rows):
    docs = rows.where("id < 3000").select(
        "id", "entity", F.col("date").cast("timestamp").alias("publish_date"), F.lit("类").alias("category_name"),
        F.format_string("t%d", F.col("id")).alias("title"), F.lit("正文" * 400).alias("content"),
    )
    off = TextParams(
        max_docs_per_day=None, max_sentences=None, key_max_chars=None, title_max_chars=None, document_max_chars=None
    )
    out = dc.daily_text(docs, D, D + dt.timedelta(days=40), off)
    lines = out.select(F.explode(F.split("doc_text", "；类：")).alias("line"))
    assert lines.count() == 3000
    assert lines.where(F.col("line").endswith("正文" * 400)).count() == 3000
