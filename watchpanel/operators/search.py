"""Search of training settings: seeded draws, successive halving, concurrent trials.

A trial is a set of values drawn from the search ranges.  All trials train with a share of their trees
first; the better part goes on with more of them, until the last ones train in full.  Trials of a rung
run as concurrent jobs in a fair pool each.  One ensemble answers for every smaller number of trees, as
its first trees are that smaller ensemble, so numbers of trees need no fit of their own.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpanel.operators.features import feature_columns
from watchpanel.operators.model import balanced_sample, fit_regressor, predict
from watchpanel.operators.panel import KEYS, in_range
from watchpanel.operators.sweep import SEARCH_RANGES, sweep_thresholds
from watchpanel.params import ModelParams
from watchpanel.sources.storage import materialize

#: shares of a trial's trees, a rung each, and the part of the trials that goes on
RUNGS = (1 / 9, 1 / 3, 1.0)
KEEP = 1 / 3


def draw_trials(n: int, seed: int, ranges: Mapping[str, tuple] = SEARCH_RANGES) -> list[dict[str, float]]:
    """n settings: uniform, log-uniform or whole numbers, the same for one seed on any machine."""
    draw = random.Random(seed)
    trials = []
    for _ in range(n):
        trial: dict[str, float] = {}
        for name, (low, high, scale) in ranges.items():
            if scale == "whole":
                trial[name] = draw.randint(low, high)
            elif scale == "log":
                trial[name] = math.exp(draw.uniform(math.log(low), math.log(high)))
            else:
                trial[name] = draw.uniform(low, high)
        trials.append(trial)
    return trials


def first_trees(model: PipelineModel, n: int) -> PipelineModel:
    """The ensemble of the first n trees of a fitted model."""
    *before, trees = model.stages
    if not 1 <= n <= trees.getNumTrees:
        raise ValueError(f"{n} of {trees.getNumTrees} trees")
    spark = SparkSession.active()
    kinds = spark._jvm.org.apache.spark.ml.regression
    gateway = spark.sparkContext._gateway
    some = gateway.new_array(kinds.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(spark._jvm.double, n)
    own = trees._java_obj.trees()
    for i in range(n):
        some[i], weights[i] = own[i], float(trees.treeWeights[i])
    part = GBTRegressionModel(kinds.GBTRegressionModel(f"{trees.uid}_{n}", some, weights))
    part.setFeaturesCol(trees.getFeaturesCol()).setPredictionCol(trees.getPredictionCol())
    return PipelineModel([*before, part])


def staged_predictions(model: PipelineModel, df: DataFrame, stages: Sequence[int]) -> DataFrame:
    """`entity, date, trees, predicted_label_value` for each number of trees, from one fit."""
    # the features are put together once
    rows = PipelineModel(model.stages[:-1]).transform(df).select(*KEYS, "features")
    made = None
    for n in stages:
        part = PipelineModel(first_trees(model, n).stages[-1:])
        scored = predict(part, rows).select(*KEYS, F.lit(n).alias("trees"), "predicted_label_value")
        made = scored if made is None else made.unionByName(scored)
    return made


@dataclass(frozen=True)
class Search:
    """`results`: a row for each trial, rung and number of trees; `best`: the best row of the last rung."""

    results: DataFrame
    best: DataFrame


def objective(metrics: Mapping[str, float | None]) -> float:
    """Accuracy less false-positive rate; nothing listed counts as 0, no rate as 1."""
    acc, fpr = metrics["acc"], metrics["fpr"]
    return (0.0 if acc is None else acc) - (1.0 if fpr is None else fpr)


def evaluate_setting(scored: DataFrame, truth: DataFrame, params: ModelParams) -> dict[str, float | None]:
    """Accuracy, false-positive rate and list size of one setting over the evaluation days."""
    rows = truth.join(scored, KEYS)
    return sweep_thresholds(
        rows, [params.label_threshold], min_lead=params.min_lead_days, horizon=params.horizon_days, market_n=params.market_n
    ).select("acc", "fpr", "avg_list_size").first().asDict()


def halving_sizes(n: int, rungs: int, keep: float) -> list[int]:
    """Number of trials in each rung; at least one goes on."""
    sizes = [n]
    for _ in range(rungs - 1):
        sizes.append(max(1, math.ceil(sizes[-1] * keep)))
    return sizes


def search_settings(
    frame: DataFrame,
    truth: DataFrame,
    base: ModelParams,
    trials: Sequence[Mapping[str, float]],
    *,
    rungs: Sequence[float] = RUNGS,
    keep: float = KEEP,
    stages: Sequence[float] = (0.25, 0.5, 0.75, 1.0),
    concurrent: int = 4,
    fit: Callable = fit_regressor,
) -> Search:
    """Successive halving over the trials by accuracy less false-positive rate.

    `frame` holds the features of the training and the prediction period, and is read by every trial, so
    hand over a stored one; `truth` holds `entity, date, y_status, st_label_value` of the prediction
    period.  In the last rung the objective is also taken at shares `stages` of the trees.  A trial that
    fails, as far settings may, has no objective and goes no further.  Results are a few rows a trial.
    """
    spark = frame.sparkSession
    labelled = in_range(frame, base.train_start, base.train_end).where("y_label_numeric_available = 1")
    target = materialize(in_range(truth, base.predict_start, base.predict_end))
    ahead = in_range(frame, base.predict_start, base.predict_end)
    rows: list[tuple] = []

    def run(job: tuple[int, int, bool]) -> list[tuple]:
        i, rung, last = job
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"trial-{i}")
        params = replace(base, **trials[i])
        trees = max(1, math.ceil(params.max_iter * rungs[rung]))
        wanted = sorted({max(1, math.ceil(trees * s)) for s in stages} | {trees}) if last else [trees]
        try:
            model = fit(balanced_sample(labelled, params.zero_ratio, params.seed), feature_columns(), replace(params, max_iter=trees))
            scored = staged_predictions(model, ahead, wanted)
            found = [(n, evaluate_setting(scored.where(F.col("trees") == n).drop("trees"), target, params)) for n in wanted]
        except Exception as error:  # a setting that cannot be trained is a result of the search
            return [(i, rung, trees, None, None, None, None, type(error).__name__)]
        return [(i, rung, n, m["acc"], m["fpr"], m["avg_list_size"], objective(m), None) for n, m in found]

    left = list(range(len(trials)))
    sizes = halving_sizes(len(trials), len(rungs), keep)
    with ThreadPoolExecutor(max_workers=max(1, concurrent)) as pool:
        for rung, size in enumerate(sizes):
            order = {i: r for r, i in enumerate(left)}
            left = left[:size]
            jobs = [(i, rung, rung == len(rungs) - 1) for i in left]
            # properties are copied for each job, as the pool's name is one of them
            running = [pool.submit(inheritable_thread_target(spark)(partial(run, job))) for job in jobs]
            done = [r.result() for r in running]
            rows += [r for part in done for r in part]
            score = {part[-1][0]: part[-1][6] for part in done}
            left = sorted((i for i in left if score[i] is not None), key=lambda i: (-score[i], order[i]))
            if not left:
                break
    names = list(trials[0]) if trials else []
    schema = (
        "trial int, rung int, trees int, acc double, fpr double, avg_list_size double, objective double, failure string"
    )
    results = spark.createDataFrame(rows, schema)
    settings = spark.createDataFrame(
        [(i, *[float(t[n]) for n in names]) for i, t in enumerate(trials)], "trial int" + "".join(f", {n} double" for n in names)
    )
    joined = results.join(settings, "trial")
    top = results.agg(F.max("rung")).first()[0]
    best = joined.where((F.col("rung") == F.lit(top)) & F.col("objective").isNotNull()).orderBy(
        F.desc("objective"), "trees", "trial"
    ).limit(1)
    return Search(joined, best)
