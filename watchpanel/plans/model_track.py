"""Model track: four-dimension scores and labels to a trained urgency model, lists, evaluation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.operators.bitmaps import evaluate_list
from watchpanel.operators.documents import daily_text, select_prefiltered
from watchpanel.operators.evaluate import (
    daily_metrics_from_panel,
    event_recall,
    label_band_correct,
    overall_metrics,
)
from watchpanel.operators.features import feature_columns, with_features
from watchpanel.operators.intervals import entry_events, flag_intervals
from watchpanel.operators.memory import decay_memory
from watchpanel.operators.model import balanced_sample, fit_regressor, predict, save_model, train
from watchpanel.operators.panel import (
    KEYS,
    distinct_keys,
    in_range,
    universe,
    with_labels,
    with_predictions,
    with_truth,
)
from watchpanel.operators.scoring import Scorer, place_results_dense, score_texts, scoring_results
from watchpanel.operators.ordering import with_position
from watchpanel.operators.watchlist import daily_arrays, label_maps, label_rows, model_flags
from watchpanel.params import MODEL_PREFILTER, ModelParams, PrefilterParams, TextParams
from watchpanel.sources.runs import RunWriter
from watchpanel.sources.storage import materialize
from watchpanel.sources.writers import PREDICTION_COLUMNS, write_day_objects, write_document, write_json_rows, write_predictions


@dataclass(frozen=True)
class ModelResult:
    model: PipelineModel
    metrics: DataFrame
    predictions: DataFrame
    history: DataFrame
    predicted: DataFrame


def feature_frame(scores: DataFrame, labels: DataFrame, params: ModelParams) -> DataFrame:
    """Scores of the period with targets and features."""
    start = min(params.train_start, params.predict_start)
    end = max(params.train_end, params.predict_end)
    known = in_range(labels, params.train_start, params.train_end)
    return with_features(with_labels(in_range(scores, start, end), known))


def mark_prediction_only(df: DataFrame, params: ModelParams) -> DataFrame:
    """Null the label columns of rows outside the training period."""
    day = F.col("date")
    predict_days = day.between(F.lit(params.predict_start), F.lit(params.predict_end))
    train_days = day.between(F.lit(params.train_start), F.lit(params.train_end))
    only = predict_days & ~train_days
    columns = ("label_in_file", "y_label_empty", "y_label_value", "y_label_numeric_available")
    return df.withColumns({c: F.when(~only, F.col(c)) for c in columns})


def run(scores: DataFrame, labels: DataFrame, params: ModelParams) -> ModelResult:
    """Train on the training period and flag every row of both periods."""
    # read for counting, splitting, sampling, training and scoring: computed once
    frame = materialize(feature_frame(scores, labels, params))
    features = feature_columns()
    training = in_range(frame, params.train_start, params.train_end)
    model, metrics = train(training, features, params)
    flagged = model_flags(predict(model, frame), params.label_threshold)
    rows = mark_prediction_only(flagged, params)
    return ModelResult(
        model,
        metrics,
        rows,
        in_range(rows, params.train_start, params.train_end),
        in_range(rows, params.predict_start, params.predict_end),
    )


def predicted_from(frame: DataFrame, params: ModelParams) -> DataFrame:
    """`entity, date, predicted_label_value` of the prediction period, from a stored feature frame and one fit."""
    labelled = in_range(frame, params.train_start, params.train_end).where("y_label_numeric_available = 1")
    model = fit_regressor(balanced_sample(labelled, params.zero_ratio, params.seed), feature_columns(), params)
    ahead = in_range(frame, params.predict_start, params.predict_end)
    return predict(model, ahead).select(*KEYS, "predicted_label_value")


#: lists of a run: name, flag, period
RUN_LISTS = (
    ("history_daily", "predicted_st", "history"),
    ("predicted_daily", "predicted_st", "predicted"),
    ("blacklist_daily", "predicted_blacklist", "predicted"),
)


def _flag_lists(rows: DataFrame) -> DataFrame:
    """`list, date, rank, entity` of all lists of a run, by one order over all of them."""
    names = F.array_compact(
        F.array(*[F.when((F.col(flag) == 1) & F.col(period), F.lit(name)) for name, flag, period in RUN_LISTS])
    )
    named = rows.select(*KEYS, F.explode(names).alias("list"))
    placed = with_position(named, ["entity"], "rank", group=["list", "date"])
    return materialize(placed.withColumn("rank", F.col("rank") + 1))


def write_run(scores: DataFrame, labels: DataFrame, params: ModelParams, base: str) -> str:
    """Train, flag and write every output of the run under `base`; returns the id of the committed run.

    The model scores each row once, while the table of flagged rows is written; what the metadata tell
    about the rows is observed in that pass, and lists, intervals and labels are read from the table.
    Outputs: `table` (Parquet), `predictions` (CSV), `history_daily`, `predicted_daily`, `blacklist_daily`
    (exchange documents over the days of their period), `history_intervals`, `predicted_intervals`,
    `predicted_labels`, `model`, `metadata`.  They become visible together (`sources.runs`).
    """
    spark = scores.sparkSession
    out = RunWriter(spark, base)
    frame = materialize(feature_frame(scores, labels, params))
    features = feature_columns()
    model, metrics = train(in_range(frame, params.train_start, params.train_end), features, params)
    history = F.col("date").between(F.lit(params.train_start), F.lit(params.train_end))
    predicted = F.col("date").between(F.lit(params.predict_start), F.lit(params.predict_end))
    flagged = mark_prediction_only(model_flags(predict(model, frame), params.label_threshold), params)
    rows = flagged.select(*PREDICTION_COLUMNS, history.alias("history"), predicted.alias("predicted"))
    seen = Observation()

    def days(period: str) -> list:
        day = F.when(F.col(period), F.col("date"))
        return [F.min(day).alias(f"{period}_first"), F.max(day).alias(f"{period}_last")]

    observed = rows.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("predicted") & ~F.col("history")).alias("prediction_only_rows"),
        F.count_if(F.col("label_in_file") == 1).alias("rows_in_label_file"),
        *[F.count_if((F.col(flag) == 1) & F.col(period)).alias(f"{name}_rows") for name, flag, period in RUN_LISTS],
        *days("history"),
        *days("predicted"),
    )
    path = out.path("table")
    observed.write.parquet(path)
    facts = dict(seen.get)
    table = spark.read.schema(rows.schema).parquet(path)

    write_predictions(table, out.path("predictions"))
    lists = _flag_lists(table)
    for name, _, period in RUN_LISTS:
        first, last = facts[f"{period}_first"], facts[f"{period}_last"]
        folder = out.path(name)
        if first is None:
            write_day_objects(lists.limit(0).select("date", F.lit(0).alias("part"), F.array("entity").alias("entities")), folder)
        else:
            write_document(daily_arrays(lists.where(F.col("list") == name), first, last), "entities", folder)
    for period in ("history", "predicted"):
        write_json_rows(flag_intervals(table.where(period), "predicted_st"), out.path(f"{period}_intervals"))
    named = label_rows(table.where("predicted"), "predicted_label", "predicted_label_empty")
    write_day_objects(label_maps(named), out.path("predicted_labels"))
    save_model(model, out.path("model"), params.label_threshold, features)
    settings = {
        "target": "label value (regression only)",
        **{c: getattr(params, c) for c in ("train_start", "train_end", "predict_start", "predict_end", "validation_start")},
        **{c: getattr(params, c) for c in ("max_iter", "step_size", "max_depth", "zero_ratio", "label_threshold", "seed")},
        "features": features,
    }
    described = metrics.select("*", *[F.lit(v).alias(k) for k, v in facts.items()])
    write_json_rows(
        described.select("*", *[(F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)).alias(k) for k, v in settings.items()]),
        out.path("metadata"),
    )
    return out.commit({**facts, **settings})


def evaluation_panel(scores: DataFrame, truth: DataFrame, listed: DataFrame) -> DataFrame:
    """Distinct scored keys with truth and listing flags."""
    return with_predictions(with_truth(distinct_keys(scores), truth), listed)


def evaluate(
    scores: DataFrame,
    truth: DataFrame,
    listed: DataFrame,
    *,
    start: dt.date,
    end: dt.date,
    params: ModelParams,
    check_panel: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Daily and overall metrics of listed rows by the label rule.

    A complete panel is evaluated from bitmaps of days, without building it.  With `check_panel` False
    entities may lack days: then the rows themselves are laid side by side.
    """
    rule = {"min_lead": params.min_lead_days, "horizon": params.horizon_days}
    if check_panel:
        daily, events = evaluate_list(scores, truth, listed, start, end, market_n=params.market_n, **rule)
        return daily, overall_metrics(daily, events, {"market_n": params.market_n})
    # read for the daily counts and for the events
    panel = materialize(
        evaluation_panel(in_range(scores, start, end), in_range(truth, start, end), in_range(listed, start, end))
    )
    rows = label_band_correct(entry_events(panel), **rule)
    daily = daily_metrics_from_panel(rows, params.market_n)
    return daily, overall_metrics(daily, event_recall(rows, **rule), {"market_n": params.market_n})


def score_dims(
    documents: DataFrame,
    make_scorer: Callable[[], Scorer],
    *,
    output: tuple[dt.date, dt.date],
    intervals: DataFrame | None = None,
    text: TextParams = TextParams(),
    prefilter: PrefilterParams = MODEL_PREFILTER,
    decay: float = 0.5,
    threshold: float = 80.0,
    scorer_parts: int | None = None,
) -> DataFrame:
    """Documents to the decayed four-dimension score panel of the output period.

    The memory warms up over the lookback days.  Entities of `intervals` without documents belong
    to the panel too.
    """
    first = output[0] - dt.timedelta(days=text.lookback_days)
    daily = daily_text(documents, first, output[1], text)
    tasks = select_prefiltered(daily, output, prefilter)
    # every text is scored once
    results = materialize(
        scoring_results(score_texts(tasks, make_scorer, parts=scorer_parts), fv.DIMS)
    )
    known = universe(documents) if intervals is None else universe(documents, intervals)
    placed = place_results_dense(known, results, fv.DIMS, first, output[1])
    decayed = decay_memory(
        placed,
        {d: f"{d}_state" for d in fv.DIMS},
        decay=decay,
        entry=threshold,
        output=output,
    )
    return in_range(decayed, *output).select(
        *KEYS, *[F.col(f"{d}_state").cast("float").alias(d) for d in fv.DIMS]
    )
