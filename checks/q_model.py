"""Labels, features, training, listing and evaluation of the model track."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.data import END, MODEL, START, dim_scores, score_rows, sql, status_intervals
from checks.q_rules import dense_scores, label_panel, panel_of, r6, status_panel
from checks.registry import query
from watchpanel import fixed_values as fv
from watchpanel.operators import features as ft
from watchpanel.operators import intervals as iv
from watchpanel.operators import model as md
from watchpanel.operators import panel as pn
from watchpanel.operators import search as sr
from watchpanel.operators import summary as sm
from watchpanel.operators import sweep as sw
from watchpanel.operators import watchlist as wl
from watchpanel.plans import model_track as mt
from watchpanel.sources import writers as wr
from watchpanel.sources.storage import materialize, scratch_path

KEYS = pn.KEYS


def filled_dims(spark, sf):
    return pn.dense_fill(
        pn.universe(score_rows(spark, sf)), dim_scores(spark, sf), {d: 0.0 for d in fv.DIMS}, START, END
    )


def labels(spark, sf):
    """Urgency labels as the rows of a label file; entities without any interval are not in it."""
    known = status_intervals(spark, sf).select("entity").distinct()
    rows = iv.urgency_labels(status_panel(spark, sf), status_intervals(spark, sf)).join(known, "entity", "left_semi")
    return rows.select(
        *KEYS, F.lit(1).alias("label_in_file"), F.col("y_status").alias("y_label_empty"),
        F.col("label").alias("y_label_value"),
    )


def labelled(spark, sf):
    return pn.with_labels(filled_dims(spark, sf), pn.in_range(labels(spark, sf), START, MODEL.train_end))


_FILE = {
    "label_file": """select entity, date, y_status as y_label_empty, label as y_label_value from urgency
                     where entity in (select entity from intervals)""",
    "labelled": """
      select p.entity, p.date, case when f.entity is null then 0 else 1 end as label_in_file,
        coalesce(f.y_label_empty, 0) as y_label_empty,
        case when f.entity is null then 0.0 else f.y_label_value end as y_label_value
      from panel p left join (select * from label_file where date <= date '2024-01-20') f using (entity, date)""",
}


@query(
    "join_labels",
    sql(
        """select entity, date, label_in_file, y_label_empty, round(y_label_value, 6) as y_label_value,
             case when y_label_value is null then 0 else 1 end as y_label_numeric_available from labelled""",
        "panel", "urgency", extra=_FILE,
    ),
)
def join_labels(spark, sf):
    return labelled(spark, sf).select(
        *KEYS, "label_in_file", "y_label_empty", r6("y_label_value"), "y_label_numeric_available"
    )


@query(
    "join_truth_and_predictions",
    sql(
        """select p.entity, p.date, case when f.entity is null then 0 else 1 end as label_in_file,
             coalesce(f.y_label_empty, 0) as y_status, round(case when f.entity is null then 0 else f.y_label_value end, 6) as st_label_value,
             case when a.entity is null then 0 else 1 end as predicted_listing
           from panel p left join label_file f using (entity, date) left join alive a using (entity, date)""",
        "panel", "urgency", "alive", extra=_FILE,
    ),
)
def join_truth(spark, sf):
    from checks.q_rules import alive_days
    from watchpanel.sources.readers import truth_rows

    df = pn.with_predictions(
        pn.with_truth(panel_of(spark, sf), truth_rows(labels(spark, sf))), alive_days(spark, sf)
    )
    return df.select(*KEYS, "label_in_file", "y_status", r6("st_label_value"), "predicted_listing")


@query(
    "entity_ordinals",
    sql("select entity, cast(row_number() over (order by entity) - 1 as bigint) as entity_id from users", "users"),
)
def ordinals(spark, sf):
    return ft.entity_ordinals(score_rows(spark, sf))


_MONTH = ", ".join(
    f"round(avg(coalesce({d}, 0)) over (partition by p.entity, date_trunc('month', p.date)), 6) as {d}_month_mean" for d in fv.DIMS
)


@query(
    "month_means",
    sql(f"select p.entity, p.date, {_MONTH} from panel p left join dims d using (entity, date)", "panel", "dims"),
)
def month_means(spark, sf):
    df = ft.month_means(filled_dims(spark, sf))
    return df.select(*KEYS, *[r6(f"{d}_month_mean") for d in fv.DIMS])


@query(
    "feature_frame",
    sql(
        "select p.entity, p.date, " + ", ".join(f"round(coalesce({d}, 0), 6) as {d}" for d in fv.DIMS) + ", "
        + "round(greatest(" + ", ".join(f"coalesce({d}, 0)" for d in fv.DIMS) + "), 6) as risk_max, cast("
        + " + ".join(f"(case when {d} > 0 then 1 else 0 end)" for d in fv.DIMS) + " as int) as risk_nonzero_count, "
        + _MONTH
        + """, month(p.date) as month, quarter(p.date) as quarter, dayofyear(p.date) as dayofyear,
           round(sin(2 * pi() * month(p.date) / 12), 6) as month_sin, round(cos(2 * pi() * month(p.date) / 12), 6) as month_cos,
           cast(dense_rank() over (order by p.entity) - 1 as bigint) as entity_id
           from panel p left join dims d using (entity, date)""",
        "panel", "dims",
    ),
)
def features(spark, sf):
    df = ft.with_features(filled_dims(spark, sf))
    whole = ("risk_nonzero_count", "entity_id", "month", "quarter", "dayofyear")
    return df.select(*KEYS, *[c if c in whole else r6(c) for c in ft.feature_columns()])


@query(
    "target_counters",
    sql(
        """select count(*) filter (y_label_value > 0) as positive_rows, count(*) filter (y_label_value = 0) as zero_rows,
             count(y_label_value) as numeric_rows from labelled""",
        "panel", "urgency", extra=_FILE,
    ),
)
def target_counters(spark, sf):
    return sm.target_counters(labelled(spark, sf))


def training_rows(spark, sf):
    rows = pn.in_range(labelled(spark, sf), MODEL.train_start, MODEL.train_end)
    return rows.where("y_label_numeric_available = 1")


@query(
    "time_split",
    sql(
        """select case when date < date '2024-01-15' then 'train' else 'valid' end as side, count(*) as n,
             round(sum(y_label_value), 6) as total from labelled
           where date <= date '2024-01-20' and y_label_value is not null group by 1""",
        "panel", "urgency", extra=_FILE,
    ),
)
def time_split(spark, sf):
    early, late = md.time_split(training_rows(spark, sf), MODEL.validation_start, MODEL.seed)
    both = early.withColumn("side", F.lit("train")).unionByName(late.withColumn("side", F.lit("valid")))
    return both.groupBy("side").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("y_label_value"), 6).alias("total")
    )


@query(
    "balanced_sample",
    sql(
        """select positive, least(zero, greatest(cast(floor(positive * 0.5) as bigint), 1)) as zeros from (
             select count(*) filter (y_label_value > 0) as positive, count(*) filter (y_label_value = 0) as zero
             from labelled where date <= date '2024-01-20')""",
        "panel", "urgency", extra=_FILE,
    ),
)
def balanced(spark, sf):
    """Exact size of the training sample."""
    sample = md.balanced_sample(training_rows(spark, sf), 0.5, MODEL.seed)
    return sample.agg(
        F.count_if(F.col("y_label_value") > 0).alias("positive"), F.count_if(F.col("y_label_value") == 0).alias("zeros")
    )


@query(
    "model_listing_flags",
    sql(
        """select l.entity, l.date, 0 as predicted_label_empty, l.y_label_empty as predicted_st,
             case when l.y_label_empty = 0 and cast(d.v / 100 as real) >= cast(0.3 as real) then 1 else 0 end as predicted_blacklist
           from labelled l join dense d using (entity, date)""",
        "panel", "urgency", "dense", extra=_FILE,
    ),
)
def flags(spark, sf):
    df = labelled(spark, sf).join(dense_scores(spark, sf), KEYS)
    df = df.withColumn("predicted_label_value", (F.col("score") / 100).cast("float"))
    return wl.model_flags(df, 0.3).select(*KEYS, "predicted_label_empty", "predicted_st", "predicted_blacklist")


@query(
    "prediction_only_rows",
    sql(
        """select entity, date, case when date <= date '2024-01-20' then label_in_file end as label_in_file,
             case when date <= date '2024-01-20' then y_label_empty end as y_label_empty,
             round(case when date <= date '2024-01-20' then y_label_value end, 6) as y_label_value
           from labelled""",
        "panel", "urgency", extra=_FILE,
    ),
)
def prediction_only(spark, sf):
    df = mt.mark_prediction_only(labelled(spark, sf), MODEL)
    return df.select(*KEYS, "label_in_file", "y_label_empty", r6("y_label_value"))


_RUNS: dict[tuple, mt.ModelResult] = {}


def _trained(spark, sf, params=MODEL):
    """A training run with the default settings; the queries about it share one for each session and folder."""
    key = (spark.sparkContext.applicationId, sf, params)
    if key not in _RUNS:
        run = mt.run(filled_dims(spark, sf), labels(spark, sf), params)
        rows = materialize(run.predictions)
        _RUNS[key] = replace(
            run, predictions=rows, history=pn.in_range(rows, params.train_start, params.train_end),
            predicted=pn.in_range(rows, params.predict_start, params.predict_end),
        )
    return _RUNS[key]


_COUNTS_SQL = """select positive + least(zero, greatest(cast(floor(positive * 5.53767) as bigint), 1)) as sampled_rows,
             positive as positive_rows, zero as zero_rows, positive + zero as numeric_rows{more} from (
             select count(*) filter (y_label_value > 0) as positive, count(*) filter (y_label_value = 0) as zero
             from labelled where date <= date '2024-01-20')"""


@query(
    "train_urgency_model",
    sql(
        _COUNTS_SQL.format(more=", true as errors_in_range, true as better_than_the_mean"), "panel", "urgency", extra=_FILE,
    ),
)
def train_model(spark, sf):
    """Row counts of a training run, and its errors against those of the mean as prediction."""
    run = _trained(spark, sf)
    sample = md.balanced_sample(training_rows(spark, sf), MODEL.zero_ratio, MODEL.seed)
    known = sample.select(*KEYS, "y_label_value").join(run.predictions.select(*KEYS, "predicted_label_value"), KEYS)
    value, guess = F.col("y_label_value"), F.col("predicted_label_value")
    fitted = known.agg((F.avg((value - guess) ** 2) < F.var_pop(value)).alias("better_than_the_mean"))
    mae, rmse = F.col("validation_mae"), F.col("validation_rmse")
    return run.metrics.crossJoin(fitted).select(  # one row each
        *[F.col(c).cast("bigint").alias(c) for c in ("sampled_rows", "positive_rows", "zero_rows", "numeric_rows")],
        ((mae > 0) & (mae <= rmse) & (rmse < 1)).alias("errors_in_range"), "better_than_the_mean",
    )


@query("training_row_counts", sql(_COUNTS_SQL.format(more=""), "panel", "urgency", extra=_FILE))
def training_counts(spark, sf):
    """Row counts that a training run reports, taken without a fit."""
    return md.sample_counts(training_rows(spark, sf), MODEL)


@query(
    "predict_urgency",
    sql(
        """select entity, date, 0 as predicted_st, true as in_range, true as flag_follows
           from panel where date > date '2024-01-20'""",
        "panel",
    ),
)
def predict(spark, sf):
    """Predictions of the prediction period: inside 0..1, and the flag of each as its threshold says."""
    value, flag = F.col("predicted_label_value"), F.col("predicted_blacklist")
    reached = (value >= F.lit(MODEL.label_threshold).cast("float")) & (F.col("predicted_st") == 0)
    return _trained(spark, sf).predicted.select(
        *KEYS, "predicted_st", value.between(0, 1).alias("in_range"), (flag == reached.cast("int")).alias("flag_follows")
    )


@query(
    "prediction_table_csv",
    sql(
        """select l.entity as stock_code, l.date, case when l.date <= date '2024-01-20' then label_in_file end as label_in_file,
             case when l.date <= date '2024-01-20' then y_label_empty end as y_label_empty,
             round(case when l.date <= date '2024-01-20' then y_label_value end, 6) as y_label_value,
             y_label_empty as predicted_st, 0 as predicted_label_empty, true as labels_agree, """
        + ", ".join(f"round(coalesce({d}, 0), 6) as {d}" for d in fv.DIMS)
        + " from labelled l left join dims d using (entity, date)",
        "panel", "urgency", "dims", extra=_FILE,
    ),
)
def prediction_csv(spark, sf):
    """The table written and read back; the model's columns agree with each other and with the rows written."""
    path = scratch_path(spark, "predictions")
    rows = _trained(spark, sf).predictions
    wr.write_predictions(rows, path)
    back = spark.read.csv(path, header=True, enforceSchema=True, schema=", ".join(
        f"`{n}` {'string' if n == 'stock_code' else 'date' if n == 'date' else 'double'}" for n in wr.PREDICTION_COLUMNS.values()
    ))
    own = rows.select(F.col("entity").alias("stock_code"), "date", F.col("predicted_label_value").alias("_v"), F.col("predicted_blacklist").alias("_b"))
    same = (
        (F.col("predicted_label_value") == F.col("predicted_label")) & (F.col("predicted_label").cast("float") == F.col("_v"))
        & (F.col("predicted_blacklist") == F.col("_b"))
    )
    whole = ("label_in_file", "y_label_empty", "predicted_st", "predicted_label_empty")
    return back.join(own, ["stock_code", "date"]).select(
        "stock_code", "date", *[F.col(c).cast("int").alias(c) for c in whole], r6("y_label_value"), same.alias("labels_agree"),
        *[r6(d) for d in fv.DIMS],
    )


@query(
    "saved_model",
    sql("select entity, date, true as same_value, true as same_threshold from panel", "panel"),
)
def saved_model(spark, sf):
    """A model written, read back and applied: the predictions of the fresh one."""
    path = scratch_path(spark, "model")
    run = _trained(spark, sf)
    md.save_model(run.model, path, MODEL.label_threshold, ft.feature_columns())
    loaded, threshold, names = md.load_model(path)
    frame = mt.feature_frame(filled_dims(spark, sf), labels(spark, sf), MODEL)
    scored = md.predict(loaded, frame).select(*KEYS, F.col("predicted_label_value").alias("_again"))
    kept = F.lit(threshold == MODEL.label_threshold and names == ft.feature_columns())
    return run.predictions.join(scored, KEYS).select(
        *KEYS, (F.col("_again") == F.col("predicted_label_value")).alias("same_value"), kept.alias("same_threshold")
    )


_EVAL = {
    "ev": """
      select u.entity, u.date, u.y_status, case when a.entity is not null and u.y_status = 0 then 1 else 0 end as effective,
        case when a.entity is not null and u.y_status = 0
          and coalesce(cast(u.label as real) between cast(1.0 / 20 as real) and cast(1.0 as real), false) then 1 else 0 end as correct
      from urgency u left join alive a using (entity, date)""",
    "ev_days": """select date, sum(effective) as listed_cnt, sum(correct) as correct_cnt, sum(y_status) as status_cnt from ev group by 1""",
    "ev_hits": """select e.entity, e.date, max(case when b.entity is not null then 1 else 0 end) as hit
      from entries e left join ev b on b.entity = e.entity and b.effective = 1 and b.date between e.date - 20 and e.date - 1 group by 1, 2""",
}


@query(
    "stored_watchlist_evaluation",
    sql(
        """select round(avg(case when listed_cnt > 0 then correct_cnt / listed_cnt end), 6) as acc,
             round(avg((listed_cnt - correct_cnt) / (5400 - status_cnt - correct_cnt)), 6) as fpr,
             round(avg(listed_cnt), 6) as avg_list_size, (select count(*) from ev_hits) as total_events,
             (select cast(sum(hit) as bigint) from ev_hits) as hit_events, round((select avg(hit) from ev_hits), 6) as recall
           from ev_days""",
        "urgency", "alive", "entries", extra=_EVAL,
    ),
)
def stored_evaluation(spark, sf):
    """A watchlist written as exchange document, read back, evaluated against labels."""
    from checks.q_rules import alive_days
    from watchpanel.sources import readers as rd

    path = scratch_path(spark, "evaluated")
    alive = pn.in_range(alive_days(spark, sf), START, END)
    wr.write_document(wl.daily_arrays(wl.ranked(alive), START, END), "entities", path)
    listed = rd.scan_daily_watchlist(spark, path, START, END, by_line=True)
    truth = rd.truth_rows(labels(spark, sf))
    params = replace(MODEL, market_n=5400, horizon_days=20)
    _, overall = mt.evaluate(panel_of(spark, sf), truth, listed, start=START, end=END, params=params)
    return overall.select(r6("acc"), r6("fpr"), r6("avg_list_size"), "total_events", "hit_events", r6("recall"))


THRESHOLDS = (0.1, 0.2, 0.4, 0.6, 0.8)
_TH = ", ".join(f"({t})" for t in THRESHOLDS)


@query(
    "threshold_sweep",
    sql(
        """select threshold, round(avg(listed_cnt), 6) as avg_list_size,
             round(avg(case when listed_cnt > 0 then correct_cnt / listed_cnt end), 6) as acc,
             round(avg((listed_cnt - correct_cnt) / (5400 - status_cnt - correct_cnt)), 6) as fpr,
             round(coalesce(avg(case when listed_cnt > 0 then correct_cnt / listed_cnt end), 0)
               - avg((listed_cnt - correct_cnt) / (5400 - status_cnt - correct_cnt)), 6) as objective
           from (select t.threshold, u.date,
               count(*) filter (u.y_status = 0 and cast(d.v / 100 as real) >= cast(t.threshold as real)) as listed_cnt,
               count(*) filter (u.y_status = 0 and cast(d.v / 100 as real) >= cast(t.threshold as real)
                 and coalesce(cast(u.label as real) between cast(1.0 / 20 as real) and cast(1.0 as real), false)) as correct_cnt,
               count(*) filter (u.y_status = 1) as status_cnt
             from urgency u join dense d using (entity, date) cross join th t group by 1, 2) group by 1""",
        "urgency", "dense", extra={"th": f"select cast(t as double) as threshold from (values {_TH}) as x(t)"},
    ),
)
def threshold_sweep(spark, sf):
    rows = label_panel(spark, sf).join(dense_scores(spark, sf), KEYS).withColumn(
        "predicted_label_value", F.col("score") / 100
    )
    df = sw.sweep_thresholds(rows, THRESHOLDS, min_lead=1, horizon=20, market_n=5400)
    return df.select("threshold", r6("avg_list_size"), r6("acc"), r6("fpr"), r6("objective"))


SWEPT = (0.01, 0.02, 0.05, 0.1, 0.2)
_SWEPT = ", ".join(f"({t})" for t in SWEPT)


@query(
    "model_setting_sweep",
    f"""select trial, cast(t as double) as threshold, case trial when 0 then 2.0 else 6.0 end as zero_ratio, 96 as max_iter,
          true as objective_follows, true as lists_shrink, true as rates_in_range
        from (values (0), (1)) x(trial) cross join (values {_SWEPT}) y(t)""",
)
def model_sweep(spark, sf):
    """Two training settings, five thresholds each: what holds for any model."""
    from pyspark.sql import Window

    truth = materialize(label_panel(spark, sf).select(*KEYS, "y_status", "st_label_value"))
    frame = materialize(mt.feature_frame(filled_dims(spark, sf), labels(spark, sf), MODEL))

    def fit_and_score(params):
        scored = mt.predicted_from(frame, params)
        return pn.in_range(truth, params.predict_start, params.predict_end).join(scored, KEYS)

    rows = sw.sweep_models(fit_and_score, MODEL, [{"zero_ratio": 2.0}, {"zero_ratio": 6.0}], SWEPT)
    acc, fpr = F.col("acc"), F.col("fpr")
    before = F.lag("avg_list_size").over(Window.partitionBy("trial").orderBy("threshold"))
    follows = F.abs(F.col("objective") - (F.coalesce(acc, F.lit(0.0)) - fpr)) < 1e-9
    return rows.select(
        "trial", "threshold", "zero_ratio", "max_iter", follows.alias("objective_follows"),
        F.coalesce(F.col("avg_list_size") <= before, F.lit(True)).alias("lists_shrink"),
        (F.coalesce(acc.between(0, 1), F.lit(True)) & fpr.between(0, 1)).alias("rates_in_range"),
    )


TRIALS = sr.draw_trials(9, seed=42)
_DRAWN = ", ".join(
    f"({i}, {t['zero_ratio']!r}, {t['label_threshold']!r}, {t['max_iter']}, {t['step_size']!r}, {t['max_depth']})" for i, t in enumerate(TRIALS)
)


def _search(spark, sf):
    truth = label_panel(spark, sf).select(*KEYS, "y_status", "st_label_value")
    frame = materialize(mt.feature_frame(filled_dims(spark, sf), labels(spark, sf), MODEL))
    return sr.search_settings(frame, truth, MODEL, TRIALS)


@query(
    "model_setting_search",
    f"""with t(trial, zero_ratio, label_threshold, max_iter, step_size, max_depth) as (values {_DRAWN})
        select trial, 0 as rung, cast(ceil(max_iter / 9) as int) as trees, round(zero_ratio, 9) as zero_ratio,
          round(label_threshold, 9) as label_threshold, cast(max_iter as double) as max_iter, round(step_size, 9) as step_size,
          cast(max_depth as double) as max_depth,
          zero_ratio between 2 and 10 and label_threshold between 0.001 and 0.05 and max_iter between 80 and 250
            and step_size between 0.01 and 0.2 and max_depth between 4 and 6 as in_range,
          9 as in_first, 3 as in_second, 1 as in_last, 4 as stages, true as best_go_on, true as best_is_best from t""",
)
def model_search(spark, sf):
    """Nine drawn settings, halved twice: the draws, the rungs, and the best by accuracy less false-positive rate."""
    from pyspark.sql import Window

    found = _search(spark, sf)
    rows = found.results
    (best,) = found.best.collect()
    last = rows.where("rung = 2")
    sizes = rows.agg(*[F.count_distinct(F.when(F.col("rung") == r, F.col("trial"))).cast("int").alias(f"r{r}") for r in range(3)]).first()
    went_on = rows.where("rung = 1").select("trial").distinct().withColumn("on", F.lit(1))
    place = F.row_number().over(Window.partitionBy("rung").orderBy(F.desc("objective"), "trial"))
    first = rows.where("rung = 0").withColumn("_place", place).join(went_on, "trial", "left")
    top = last.agg(F.max("objective"), F.count(F.lit(1))).first()
    return first.select(
        "trial", "rung", "trees", *[F.round(c, 9).alias(c) for c in ("zero_ratio", "label_threshold")], "max_iter",
        F.round("step_size", 9).alias("step_size"), "max_depth",
        (F.col("zero_ratio").between(2, 10) & F.col("label_threshold").between(0.001, 0.05) & F.col("max_iter").between(80, 250)
         & F.col("step_size").between(0.01, 0.2) & F.col("max_depth").between(4, 6)).alias("in_range"),
        *[F.lit(sizes[f"r{r}"]).alias(n) for r, n in enumerate(("in_first", "in_second", "in_last"))],
        F.lit(top[1]).cast("int").alias("stages"), (F.col("on").isNotNull() == (F.col("_place") <= 3)).alias("best_go_on"),
        F.lit(best.objective == top[0]).alias("best_is_best"),
    )


_RUN_SQL = {
    "history": "select * from labelled where date <= date '2024-01-20' and y_label_empty = 1",
    "islands": """select entity, min(date) as first, max(date) as last from (
        select *, date - cast(row_number() over (partition by entity order by date) as int) as g from history)
        group by entity, g""",
}


@query(
    "training_run_outputs",
    sql(
        """select 'history_daily' as output, entity, date, null::date as until, null::bigint as n from history
           union all select 'history_intervals', entity, first, last, null from islands
           union all select 'predicted_labels', null, date, null, count(*) from panel where date > date '2024-01-20' group by date
           union all select 'table', null, null, null, count(*) from panel
           union all select 'predictions', null, null, null, count(*) from panel
           union all select 'rows', null, null, null, count(*) from panel
           union all select 'prediction_only_rows', null, null, null, count(*) from panel where date > date '2024-01-20'
           union all select 'history_daily_rows', null, null, null, count(*) from history
           union all select x.name, null, null, null, 0 from (values ('predicted_daily_rows'), ('predicted_intervals'),
             ('blacklist_differs'), ('labels_differ'), ('reloaded_differs'), ('unfinished_visible')) x(name)""",
        "panel", "urgency", extra=_FILE | _RUN_SQL,
    ),
)
def run_outputs(spark, sf):
    """All outputs of a training run, read back through its manifest and held against its table."""
    from watchpanel.sources import readers as rd
    from watchpanel.sources import runs

    base = scratch_path(spark, "runs")
    # a run that stops before its manifest is no run
    md_path = runs.RunWriter(spark, base).path("table")
    panel_of(spark, sf).write.parquet(md_path)
    unfinished = len(runs.committed_runs(spark, base))
    mt.write_run(filled_dims(spark, sf), labels(spark, sf), MODEL, base)
    found = runs.open_run(spark, base)
    table = spark.read.parquet(found.paths["table"])

    def rows(name, df, entity="entity", date="date", until=None, n=None):
        kinds = ((entity, "string", "entity"), (date, "date", "date"), (until, "date", "until"), (n, "bigint", "n"))
        values = [(F.lit(None) if c is None else F.col(c) if isinstance(c, str) else c).cast(k).alias(o) for c, k, o in kinds]
        return df.select(F.lit(name).alias("output"), *values)

    def number(name, df):
        return rows(name, df.agg(F.count(F.lit(1)).alias("n")), None, None, n="n")

    def facts(*names):
        one = spark.range(1)
        return [rows(name, one, None, None, n=F.lit(found.facts[name])) for name in names]

    period = (MODEL.predict_start, MODEL.predict_end)
    listed = rd.scan_daily_watchlist(spark, found.paths["blacklist_daily"], *period, by_line=True)
    flagged = table.where("predicted and predicted_blacklist = 1").select(*KEYS)
    label_doc = spark.read.schema("date date, part int, labels map<string,double>").json(found.paths["predicted_labels"])
    labels_read = label_doc.select("date", F.explode("labels").alias("entity", "label"))
    label_table = table.where("predicted").select("date", "entity", F.round(F.col("predicted_label").cast("double"), 6).alias("label"))
    model, _, _ = md.load_model(found.paths["model"])
    frame = mt.feature_frame(filled_dims(spark, sf), labels(spark, sf), MODEL)
    again = md.predict(model, frame).select(*KEYS, "predicted_label_value")
    out = [
        rows("history_daily", rd.scan_daily_watchlist(spark, found.paths["history_daily"], START, MODEL.train_end, by_line=True)),
        rows("history_intervals", spark.read.json(found.paths["history_intervals"]), "entity", F.to_date("entry_date"), F.to_date("remove_date")),
        rows("predicted_labels", labels_read.groupBy("date").count(), None, "date", n="count"),
        number("table", table),
        number("predictions", spark.read.csv(found.paths["predictions"], header=True)),
        *facts("rows", "prediction_only_rows", "history_daily_rows", "predicted_daily_rows"),
        number("predicted_intervals", spark.read.schema("entity string").json(found.paths["predicted_intervals"])),
        number("blacklist_differs", listed.exceptAll(flagged).unionAll(flagged.exceptAll(listed))),
        number("labels_differ", labels_read.select("date", "entity", "label").exceptAll(label_table)),
        number("reloaded_differs", again.exceptAll(table.select(*KEYS, "predicted_label_value"))),
        rows("unfinished_visible", spark.range(1), None, None, n=F.lit(unfinished)),
    ]
    together = out[0]
    for part in out[1:]:
        together = together.unionByName(part)
    return together
