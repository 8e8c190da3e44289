"""Panels, intervals, memory, watchlists, evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.data import (
    END,
    OUTPUT,
    RULES,
    START,
    dim_scores,
    daily_scores,
    long_intervals,
    score_rows,
    sql,
    sql_code,
    status_intervals,
    table,
)
from checks.registry import query
from watchpanel import fixed_values as fv
from watchpanel.operators import evaluate as ev
from watchpanel.operators import intervals as iv
from watchpanel.operators import panel as pn
from watchpanel.operators import summary as sm
from watchpanel.operators import sweep as sw
from watchpanel.operators import watchlist as wl
from watchpanel.operators.memory import cut_stale, decay_memory, forward_fill, memory_days
from watchpanel.plans.rule_track import run_from_scores
from watchpanel.functions.columns import row_max

KEYS = pn.KEYS


def r6(name, alias=None):
    return F.round(F.col(name).cast("double"), 6).alias(alias or name)


def panel_of(spark, sf):
    return pn.dense_panel(pn.universe(score_rows(spark, sf)), START, END)


def status_of(spark, sf):
    return iv.status_days_any(status_intervals(spark, sf), START, END).join(
        pn.universe(score_rows(spark, sf)), "entity", "left_semi"
    )


def status_panel(spark, sf):
    return iv.panel_status(panel_of(spark, sf), status_of(spark, sf))


def dense_scores(spark, sf):
    return pn.dense_fill(
        pn.universe(score_rows(spark, sf)), daily_scores(spark, sf), {"score": 0.0}, START, END
    )


def memory_panel(spark, sf):
    return decay_memory(
        dense_scores(spark, sf), {"score": "memory"},
        decay=RULES.decay, entry=RULES.entry, retain=RULES.retain, output=OUTPUT,
    )


def alive_days(spark, sf):
    return memory_days(
        daily_scores(spark, sf), decay=RULES.decay, entry=RULES.entry, retain=RULES.retain, end=END
    )


def listed(spark, sf):
    return wl.listed_rows(
        alive_days(spark, sf), RULES.retain, status_days=status_of(spark, sf), output=OUTPUT
    )


def result(spark, sf):
    return run_from_scores(score_rows(spark, sf), status_intervals(spark, sf), RULES)


# --- the flagship: scores and intervals to ranked daily watchlists ----------
LISTED_SQL = sql(
    """select date, cast(row_number() over (partition by date order by score desc, entity) as bigint) as rank,
       entity, round(score, 6) as score from listed""",
    "listed",
)


@query("watchlist_from_scores", LISTED_SQL)
def watchlist_from_scores(spark, sf):
    return result(spark, sf).watchlist().select("date", "rank", "entity", r6("score"))


@query("max_score_per_entity_day", sql("select entity, date, round(score, 6) as score from daily", "daily"))
def max_score(spark, sf):
    return daily_scores(spark, sf).select(*KEYS, r6("score"))


@query(
    "row_max_and_nonzero_count",
    sql(
        "select entity, date, round(greatest(" + ", ".join(fv.DIMS) + "), 6) as risk_max, "
        + " + ".join(f"(case when {d} > 0 then 1 else 0 end)" for d in fv.DIMS)
        + " as nonzero from dims",
        "dims",
    ),
)
def row_stats(spark, sf):
    from watchpanel.functions.columns import nonzero_count

    df = dim_scores(spark, sf).withColumn("risk_max", row_max(*fv.DIMS))
    return df.select(*KEYS, r6("risk_max"), nonzero_count(*fv.DIMS).alias("nonzero"))


# --- panel ------------------------------------------------------------------
@query("calendar_days", sql("select date, (select count(*) from events where cast(ts as date) = cal.date) as n from cal", "cal"))
def calendar_days(spark, sf):
    per_day = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    return pn.calendar(spark, START, END).join(per_day, "date", "left").select(
        "date", F.coalesce("n", F.lit(0)).alias("n")
    )


@query(
    "entity_universe",
    sql(f"select distinct {sql_code('o_custkey')} as entity from orders union select distinct {sql_code('user_id')} from events"),
)
def entity_universe(spark, sf):
    return pn.universe(long_intervals(spark, sf), score_rows(spark, sf))


@query("dense_panel", sql("select entity, date from panel", "panel"))
def dense_panel(spark, sf):
    return panel_of(spark, sf)


@query("reindex_with_fill", sql("select entity, date, round(v, 6) as score from dense", "dense"))
def reindex(spark, sf):
    return dense_scores(spark, sf).select(*KEYS, r6("score"))


@query("reindex_by_join", sql("select entity, date, round(v, 6) as score from dense", "dense"))
def reindex_join(spark, sf):
    return pn.fill_panel(panel_of(spark, sf), daily_scores(spark, sf), {"score": 0.0}).select(*KEYS, r6("score"))


@query(
    "distinct_entity_days",
    sql("select distinct entity, date from score_rows", "score_rows"),
)
def distinct_days(spark, sf):
    return pn.distinct_keys(score_rows(spark, sf))


@query(
    "panel_shape",
    sql(
        """select count(*) as rows, count(distinct entity) as entities, count(distinct date) as days,
           count(*) = count(distinct entity) * count(distinct date) as complete from dims""",
        "dims",
    ),
)
def panel_shape(spark, sf):
    return pn.panel_shape(dim_scores(spark, sf))


@query(
    "latest_per_key",
    sql(
        f"""select entity, date, arg_max(event_type, event_id) as event_type from
        (select {sql_code('user_id')} as entity, cast(ts as date) as date, event_type, event_id from events)
        group by 1, 2"""
    ),
)
def latest(spark, sf):
    from watchpanel.functions.columns import normalize_code

    rows = table(spark, sf, "events").select(
        normalize_code("user_id").alias("entity"), F.to_date("ts").alias("date"), "event_type", "event_id"
    )
    return pn.latest_per_key(rows, "event_id").select(*KEYS, "event_type")


# --- intervals --------------------------------------------------------------
@query("merge_intervals", sql("select entity, entry_date, remove_date, seq, kind from long_merged", "long_merged"))
def merge(spark, sf):
    return iv.merge_intervals(long_intervals(spark, sf), "seq")


# The whole period of the orders, as counts per entity
LONG_START, LONG_END = dt.date(1995, 1, 1), dt.date(2001, 8, 1)
_LONG_CAL = {
    "long_cal": """select cast(unnest(generate_series(date '1995-01-01', date '2001-08-01', interval 1 day)) as date) as date"""
}
_PER_ENTITY = "select entity, count(*) as days, min(date) as first_day, max(date) as last_day from ({}) group by 1"


def _per_entity(days):
    return days.groupBy("entity").agg(
        F.count(F.lit(1)).alias("days"), F.min("date").alias("first_day"), F.max("date").alias("last_day")
    )


@query(
    "status_days_any_cover",
    sql(
        _PER_ENTITY.format(
            """select distinct l.entity, c.date from long_intervals l join long_cal c
               on c.date between l.entry_date and coalesce(l.remove_date, date '2099-12-31')"""
        ),
        "long_intervals", extra=_LONG_CAL,
    ),
)
def any_cover(spark, sf):
    return _per_entity(iv.status_days_any(long_intervals(spark, sf), LONG_START, LONG_END))


@query(
    "status_days_as_of",
    sql(
        _PER_ENTITY.format(
            """select c.date, e.entity from (select distinct entity from long_intervals) e cross join long_cal c
               asof join (
                 select entity, entry_date, arg_max(coalesce(remove_date, date '2099-12-31'), seq) as until
                 from long_intervals group by 1, 2) l
               on l.entity = e.entity and l.entry_date <= c.date
               where c.date <= l.until"""
        ),
        "long_intervals", extra=_LONG_CAL,
    ),
)
def as_of(spark, sf):
    return _per_entity(iv.status_days_as_of(long_intervals(spark, sf), LONG_START, LONG_END, "seq"))


@query("panel_status", sql("select entity, date, y_status from status_panel", "status_panel"))
def panel_status(spark, sf):
    return status_panel(spark, sf)


@query("entry_events", sql("select entity, date from entries", "entries"))
def entry_events(spark, sf):
    return iv.entry_events(status_panel(spark, sf)).where("entry_event = 1").select(*KEYS)


@query("entry_events_sparse", sql("select entity, date as event_date from entries", "entries"))
def entry_events_sparse(spark, sf):
    return iv.entry_days(status_of(spark, sf), START)


_RUNS = """select entity, min(date) as {a}, max(date) as {b} from (
  select entity, date, date - cast(row_number() over (partition by entity order by date) as int) as g from {src})
  group by entity, g"""


@query(
    "status_runs",
    sql(_RUNS.format(a="start_date", b="end_date", src="status_panel where y_status = 1"), "status_panel"),
)
def status_runs(spark, sf):
    return iv.day_runs(status_of(spark, sf))


@query(
    "flag_intervals",
    sql(
        """select entity, min(date) as entry_date, max(date) as remove_date from (
             select entity, date, flag, row_number() over (partition by entity order by date)
               - row_number() over (partition by entity, flag order by date) as g
             from (select entity, date, case when score >= 20 then 1 else 0 end as flag from daily))
           where flag = 1 group by entity, g""",
        "daily",
    ),
)
def flag_intervals(spark, sf):
    flagged = daily_scores(spark, sf).withColumn("flag", (F.col("score") >= 20).cast("int"))
    return iv.flag_intervals(flagged, "flag")


@query(
    "urgency_labels",
    sql("select entity, date, y_status, round(label, 6) as label from urgency", "urgency"),
)
def urgency(spark, sf):
    return iv.urgency_labels(status_panel(spark, sf), status_intervals(spark, sf)).select(
        *KEYS, "y_status", r6("label")
    )


# --- memory -----------------------------------------------------------------
@query("decay_memory_two_thresholds", sql("select entity, date, round(v, 6) as score, round(s, 6) as memory from mem", "mem"))
def memory(spark, sf):
    return memory_panel(spark, sf).select(*KEYS, r6("score"), r6("memory"))


@query("decay_memory_alive_days", sql("select entity, date, round(score, 6) as score from alive", "alive"))
def alive(spark, sf):
    return alive_days(spark, sf).select(*KEYS, r6("score"))


def _dim_memory_sql() -> str:
    extra = {}
    for d in fv.DIMS:
        extra[f"x_{d}"] = (
            f"select p.entity, p.date, coalesce(d.{d}, 0) as v from panel p left join dims d using (entity, date)"
        )
        extra[f"m_{d}"] = f"""
          select entity, date, case when v >= 40 then v else 0.0 end as s from x_{d} where date = date '2024-01-01'
          union all
          select d.entity, d.date, case when x.s1 < 40 then 0.0 else x.s1 end as s
          from m_{d} m join x_{d} d on d.entity = m.entity and d.date = m.date + 1,
            lateral (select greatest(m.s - 3, 0.0) as s0) a,
            lateral (select case when d.v > 0 and a.s0 > 0 then greatest(a.s0, d.v)
                                 when d.v > 0 and d.v >= 40 then d.v else a.s0 end as s1) x"""
    cols = ", ".join(f"round(m_{d}.s, 6) as {d}" for d in fv.DIMS)
    joins = " ".join(f"join m_{d} using (entity, date)" for d in fv.DIMS)
    return sql(
        f"select p.entity, p.date, {cols} from panel p {joins} where p.date >= date '2024-01-11'",
        "panel", "dims", extra=extra,
    )


@query("decay_memory_four_dims", _dim_memory_sql())
def memory_dims(spark, sf):
    output = (dt.date(2024, 1, 11), END)
    filled = pn.dense_fill(
        pn.universe(score_rows(spark, sf)), dim_scores(spark, sf), {d: None for d in fv.DIMS}, START, END
    )
    decayed = decay_memory(
        filled, {d: f"{d}_state" for d in fv.DIMS}, decay=3.0, entry=40.0, output=output
    )
    return pn.in_range(decayed, *output).select(*KEYS, *[r6(f"{d}_state", d) for d in fv.DIMS])


@query(
    "forward_fill_with_staleness",
    sql(
        """select p.entity, p.date, round(case when x.seen is null or p.date - x.seen > 4 then 0
             else coalesce(x.score, 0) end, 6) as score
           from panel p left join lateral (
             select d.date as seen, d.score from daily d
             where d.entity = p.entity and d.date <= p.date order by d.date desc limit 1) x on true""",
        "panel", "daily",
    ),
)
def fill(spark, sf):
    rows = pn.dense_fill(
        pn.universe(score_rows(spark, sf)), daily_scores(spark, sf), {"score": None}, START, END
    )
    rows = rows.withColumn("scored", F.col("score").isNotNull())
    return cut_stale(forward_fill(rows, ["score"]), ["score"], "scored", 4).select(*KEYS, r6("score"))


# --- watchlists -------------------------------------------------------------
@query("eligible_by_threshold", sql("select entity, date, round(score, 6) as score from daily where score >= 65", "daily"))
def eligible(spark, sf):
    return wl.eligible(daily_scores(spark, sf), 65).select(*KEYS, r6("score"))


@query(
    "top_k_before_status",
    sql(
        """select t.entity, t.date, round(t.score, 6) as score from (
             select *, row_number() over (partition by date order by score desc, entity) as k from alive) t
           join status_panel p using (entity, date) where t.k <= 7 and p.y_status = 0""",
        "alive", "status_panel",
    ),
)
def top_k(spark, sf):
    rows = wl.listed_rows(
        alive_days(spark, sf), RULES.retain, top_k=7, status_days=status_of(spark, sf), output=OUTPUT
    )
    return rows.select(*KEYS, r6("score"))


@query("listed_not_in_status", sql("select entity, date, round(score, 6) as score from listed", "listed"))
def not_in_status(spark, sf):
    return listed(spark, sf).select(*KEYS, r6("score"))


@query(
    "daily_watchlist_arrays",
    sql(
        """select c.date, count(l.entity) as n,
             coalesce(string_agg(l.entity, ',' order by l.score desc, l.entity), '') as entities
           from cal c left join listed l using (date) group by 1""",
        "cal", "listed",
    ),
)
def arrays(spark, sf):
    lists = wl.daily_arrays(wl.ranked(listed(spark, sf)), START, END)
    return lists.select(
        "date", F.size("entities").cast("bigint").alias("n"), F.array_join("entities", ",").alias("entities")
    )


@query(
    "flagged_entities_per_day",
    sql(
        """select date, cast(row_number() over (partition by date order by entity) as bigint) as rank, entity
           from status_panel where y_status = 1""",
        "status_panel",
    ),
)
def flagged(spark, sf):
    return wl.flagged_days(status_panel(spark, sf), "y_status").select("date", "rank", "entity")


@query(
    "daily_label_map",
    sql(
        """select date, count(*) as n, string_agg(entity || '=' || coalesce(cast(cast(round(label * 1000000) as bigint) as varchar), 'null'), ','
             order by entity) as labels from urgency group by 1""",
        "urgency",
    ),
)
def label_map(spark, sf):
    labels = iv.urgency_labels(status_panel(spark, sf), status_intervals(spark, sf)).withColumn(
        "empty", (F.col("y_status") == 1).cast("int")
    )
    maps = wl.label_maps(wl.label_rows(labels, "label", "empty"))
    entries = F.array_sort(F.map_entries("labels"))
    text = F.transform(
        entries,
        lambda e: F.concat(
            e["key"], F.lit("="),
            F.coalesce(F.round(e["value"] * 1000000).cast("bigint").cast("string"), F.lit("null")),
        ),
    )
    return maps.select("date", F.size("labels").cast("bigint").alias("n"), F.array_join(text, ",").alias("labels"))


@query(
    "highest_decayed_entity",
    sql("select entity, round(max(s), 6) as score from mem group by 1 order by 2 desc, 1 limit 1", "mem"),
)
def highest(spark, sf):
    df = memory_panel(spark, sf).select(*KEYS, F.round("memory", 6).alias("score"))
    return wl.highest_entity(df)


@query(
    "decay_trace",
    sql(
        """select entity, date, round(v, 6) as raw_score, round(s, 6) as score, s >= 65 as listed
           from mem join (select entity, min(date) as a, max(date) as b from mem where v > 0 or s > 0 group by 1) using (entity)
           where entity = (select entity from mem group by 1 order by round(max(s), 6) desc, 1 limit 1)
             and date between a - 3 and b + 3""",
        "mem",
    ),
)
def trace(spark, sf):
    df = memory_panel(spark, sf).select(
        *KEYS, F.round("score", 6).alias("raw_score"), F.round("memory", 6).alias("score")
    )
    return wl.decay_trace(df, RULES.retain, margin=3)


# --- evaluation -------------------------------------------------------------
@query(
    "run_to_event_matches",
    sql(
        """select entity, start_date, max(date) as end_date, event_date,
             cast(event_date - start_date as int) as lead_days from correct group by 1, 2, 4""",
        "correct",
    ),
)
def run_matches(spark, sf):
    return result(spark, sf).evaluation.matches


@query("correct_listing_days", sql("select entity, date from correct", "correct"))
def correct_days(spark, sf):
    return ev.matched_days(result(spark, sf).evaluation.matches)


@query(
    "daily_metrics",
    sql(
        """select date, listed_cnt, correct_cnt, status_cnt, round(daily_acc, 6) as daily_acc,
             round(daily_fpr, 6) as daily_fpr from day_metrics""",
        "day_metrics",
    ),
)
def daily_metrics(spark, sf):
    return result(spark, sf).evaluation.daily.select(
        "date", "listed_cnt", "correct_cnt", "status_cnt", r6("daily_acc"), r6("daily_fpr")
    )


OVERALL_SQL = sql(
    """select round(avg(daily_acc), 6) as acc, round(avg(daily_fpr), 6) as fpr,
         round(avg(listed_cnt), 6) as avg_list_size,
         (select count(*) from entries) as total_events,
         (select count(*) from (select distinct entity, event_date from correct)) as hit_events,
         round((select count(*) from (select distinct entity, event_date from correct)) / (select count(*) from entries), 6) as recall
       from day_metrics""",
    "day_metrics",
)


@query("overall_metrics", OVERALL_SQL)
def overall(spark, sf):
    m = result(spark, sf).evaluation.metrics
    return m.select(
        r6("acc"), r6("fpr"), r6("avg_list_size"), "total_events", "hit_events", r6("recall")
    )


def label_panel(spark, sf):
    """Panel with status, urgency label and the listing flag."""
    labels = iv.urgency_labels(status_panel(spark, sf), status_intervals(spark, sf))
    truth = labels.select(
        *KEYS, F.lit(1).alias("label_in_file"), "y_status", F.col("label").alias("st_label_value")
    )
    joined = pn.with_truth(panel_of(spark, sf), truth)
    return iv.entry_events(pn.with_predictions(joined, alive_days(spark, sf)))


_BAND = {
    "band": """
      select u.entity, u.date, u.y_status,
        case when a.entity is not null and u.y_status = 0 then 1 else 0 end as effective,
        case when a.entity is not null and u.y_status = 0
          and coalesce(cast(u.label as real) between cast(1.0 / 20 as real) and cast(1.0 as real), false) then 1 else 0 end as correct
      from urgency u left join alive a using (entity, date)""",
}


@query(
    "label_band_correct",
    sql("select entity, date, y_status, effective, correct from band", "urgency", "alive", extra=_BAND),
)
def band(spark, sf):
    rows = ev.label_band_correct(label_panel(spark, sf), min_lead=1, horizon=20)
    return rows.select(*KEYS, "y_status", "effective", "correct")


@query(
    "event_recall_window",
    sql(
        """select e.entity, e.date as event_date, max(case when b.entity is not null then 1 else 0 end) as hit
           from entries e left join band b on b.entity = e.entity and b.effective = 1
             and b.date between e.date - 20 and e.date - 1 group by 1, 2""",
        "urgency", "alive", "entries", extra=_BAND,
    ),
)
def recall(spark, sf):
    rows = ev.label_band_correct(label_panel(spark, sf), min_lead=1, horizon=20)
    return ev.event_recall(rows, min_lead=1, horizon=20)


@query(
    "regression_errors",
    sql(
        """select round(avg(abs(label - score / 100)), 6) as mae, round(sqrt(avg(power(label - score / 100, 2))), 6) as rmse
           from (select u.label, d.v as score from urgency u join dense d using (entity, date) where label is not null)""",
        "urgency", "dense",
    ),
)
def regression(spark, sf):
    rows = iv.urgency_labels(status_panel(spark, sf), status_intervals(spark, sf)).join(
        dense_scores(spark, sf), KEYS
    )
    rows = rows.where(F.col("label").isNotNull()).withColumn("guess", F.col("score") / 100)
    m = ev.regression_metrics(rows, "label", "guess")
    return m.select(r6("mae"), r6("rmse"))


# --- summaries and sweeps ---------------------------------------------------
def _describe_sql(where: str) -> str:
    quantiles = ", ".join(
        f"round(quantile_cont(v, {q}), 6) as p{round(q * 100)}" for q in sm.PERCENTILES
    )
    return sql(
        f"""select count(v) as count, round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std,
          round(min(v), 6) as min, round(max(v), 6) as max, {quantiles} from dense {where}""",
        "dense",
    )


def _rounded(df):
    return df.select("count", *[r6(c) for c in df.columns if c != "count"])


@query("score_distribution", _describe_sql(""))
def distribution(spark, sf):
    return _rounded(sm.describe(dense_scores(spark, sf), "score"))


@query("score_distribution_nonzero", _describe_sql("where v > 0"))
def distribution_nonzero(spark, sf):
    return _rounded(sm.describe(dense_scores(spark, sf), "score", nonzero=True))


@query(
    "run_metadata_json",
    sql(
        """select 65.0 as retain, (select count(*) from daily) as n_scored_points, (select count(*) from users) as n_universe,
             (select count(*) from entries) as total_events""",
        "daily", "users", "entries",
    ),
)
def run_metadata(spark, sf):
    """Settings, counters and metrics of a run as one JSON object, written and read back."""
    from watchpanel.sources import writers as wr
    from watchpanel.sources.storage import scratch_path

    run = result(spark, sf)
    counts = sm.run_counters(daily_scores(spark, sf), score_rows(spark, sf), run.listed)
    meta = sm.run_metadata(
        spark,
        {"retain": RULES.retain, "entry": RULES.entry, "allowed_labels": RULES.prefilter.allowed},
        {"counts": counts, "metrics": run.evaluation.metrics},
    )
    path = scratch_path(spark, "meta")
    wr.write_json_rows(meta, path)
    return spark.read.json(path).select(
        "retain", "counts.n_scored_points", "counts.n_universe", "metrics.total_events"
    )


@query(
    "run_counters",
    sql(
        """select (select count(*) from daily) as n_scored_points, (select count(*) from listed) as n_output_points,
           (select count(*) from users) as n_universe""",
        "daily", "listed", "users",
    ),
)
def counters(spark, sf):
    return sm.run_counters(daily_scores(spark, sf), score_rows(spark, sf), listed(spark, sf))


GRID = sw.rule_grid([70, 80, 90], [55, 65], [2.0, 5.0])


def _grid_sql() -> str:
    points = ", ".join(f"({i}, {e}, {r}, {d})" for i, e, r, d in GRID)
    extra = {
        "grid": f"select * from (values {points}) as t(grid_id, entry, retain, decay)",
        "gmem": """
          select g.grid_id, g.entry, g.retain, g.decay, entity, date,
            cast(case when v >= g.entry then v else 0.0 end as double) as s
          from dense cross join grid g where date = date '2024-01-01'
          union all
          select m.grid_id, m.entry, m.retain, m.decay, d.entity, d.date,
            case when x.s1 < m.retain then 0.0 else x.s1 end as s
          from gmem m join dense d on d.entity = m.entity and d.date = m.date + 1,
            lateral (select greatest(m.s - m.decay, 0.0) as s0) a,
            lateral (select case when d.v > 0 and a.s0 > 0 then greatest(a.s0, d.v)
                                 when d.v > 0 and d.v >= m.entry then d.v else a.s0 end as s1) x""",
        "glisted": """select grid_id, entity, date from gmem join status_panel p using (entity, date)
                      where s >= retain and p.y_status = 0""",
        "gruns": """select grid_id, entity, min(date) as start_date, max(date) as end_date from (
            select *, date - cast(row_number() over (partition by grid_id, entity order by date) as int) as g from glisted)
            group by grid_id, entity, g""",
        "ghits": """select r.* from gruns r join entries e on e.entity = r.entity and e.date = r.end_date + 1
                    where e.date - r.start_date between 1 and 20""",
        "gdays": """
          select g.grid_id, c.date,
            (select count(*) from glisted l where l.grid_id = g.grid_id and l.date = c.date) as listed_cnt,
            (select count(*) from ghits h where h.grid_id = g.grid_id and c.date between h.start_date and h.end_date) as correct_cnt,
            (select count(*) from status_panel s where s.date = c.date and y_status = 1) as status_cnt
          from grid g cross join cal c""",
    }
    return sql(
        """select grid_id, cast(g.entry as double) as entry, cast(g.retain as double) as retain, cast(g.decay as double) as decay,
             round(avg(listed_cnt), 6) as avg_list_size,
             round(avg(case when listed_cnt > 0 then correct_cnt / listed_cnt end), 6) as acc,
             round(avg((listed_cnt - correct_cnt) / (5400 - status_cnt - correct_cnt)), 6) as fpr,
             any_value((select count(*) from ghits h where h.grid_id = g.grid_id)) as hit_events,
             any_value((select count(*) from entries)) as total_events,
             round(any_value((select count(*) from ghits h where h.grid_id = g.grid_id) / (select count(*) from entries)), 6) as recall
           from grid g join gdays using (grid_id) group by 1, 2, 3, 4""",
        "dense", "status_panel", "entries", "cal", extra=extra,
    )


def _grid_results(spark, sf):
    status = status_of(spark, sf)
    return sw.sweep_rules(
        daily_scores(spark, sf), status, iv.entry_days(status, START), GRID,
        output=OUTPUT, min_lead=1, horizon=20, market_n=5400,
    )


@query(
    "rule_grid_within_budget",
    "select grid_id, avg_list_size, recall from (" + _grid_sql() + ") where avg_list_size <= 8",
)
def grid_budget(spark, sf):
    """Settings whose mean list stays within the budget, best recall first."""
    rows = sw.best_within_budget(_grid_results(spark, sf), 8)
    return rows.select("grid_id", r6("avg_list_size"), r6("recall"))


@query("rule_grid_sweep", _grid_sql())
def grid_sweep(spark, sf):
    return _grid_results(spark, sf).select(
        "grid_id", "entry", "retain", "decay", r6("avg_list_size"), r6("acc"), r6("fpr"),
        "hit_events", "total_events", r6("recall"),
    )
