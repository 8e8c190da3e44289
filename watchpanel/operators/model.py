"""Training and applying the urgency regression with Spark ML."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpanel.functions.columns import clip_unit
from watchpanel.operators.evaluate import regression_metrics
from watchpanel.operators.panel import KEYS
from watchpanel.operators.selection import smallest
from watchpanel.params import ModelParams
from watchpanel.sources.storage import materialize

TARGET = "y_label_value"


def _spread(seed: int):
    """A fixed pseudo-random number per row key."""
    return F.xxhash64(F.col("entity"), F.col("date"), F.lit(seed))


def time_split(
    df: DataFrame, validation_start: dt.date, seed: int, target: str = TARGET
) -> tuple[DataFrame, DataFrame]:
    """Rows before and from the validation start.

    When one side has fewer than two different targets, a fixed random 80 : 20 split instead.
    """
    late = F.col("date") >= F.lit(validation_start)
    # one row of four numbers
    spread = df.agg(
        *[
            f(F.when(side, F.col(target))).alias(name)
            for name, f, side in (
                ("a", F.min, ~late), ("b", F.max, ~late), ("c", F.min, late), ("d", F.max, late)
            )
        ]
    ).first()
    if None not in spread and spread["a"] != spread["b"] and spread["c"] != spread["d"]:
        return df.where(~late), df.where(late)
    chosen = F.pmod(_spread(seed), F.lit(1000)) < 800
    return df.where(chosen), df.where(~chosen)


def balanced_sample(df: DataFrame, zero_ratio: float, seed: int, target: str = TARGET) -> DataFrame:
    """All rows with a positive target and exactly the wanted number of zero rows.

    Zeros have a fixed random number each, and those with the smallest ones are taken: histograms find
    the cut, so zero rows are neither sorted nor gathered.
    """
    counts = df.agg(
        F.count_if(F.col(target) > 0).alias("positive"), F.count_if(F.col(target) == 0).alias("zero")
    ).first()
    wanted = min(counts["zero"], max(int(counts["positive"] * zero_ratio), 1))
    positive = df.where(F.col(target) > 0)
    zero = df.where(F.col(target) == 0)
    if wanted < counts["zero"]:
        zero = smallest(zero, _spread(seed), wanted, KEYS)
    # read many times by the trainer: computed once, kept in shared storage
    return materialize(positive.unionByName(zero))


def fit_regressor(
    df: DataFrame, features: Sequence[str], params: ModelParams, target: str = TARGET
) -> PipelineModel:
    """Boosted trees with squared loss on the assembled features."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="features")
    trees = GBTRegressor(
        labelCol=target,
        featuresCol="features",
        predictionCol="_prediction",
        lossType="squared",
        stepSize=params.step_size,
        maxIter=params.max_iter,
        maxDepth=params.max_depth,
        seed=params.seed,
    )
    return Pipeline(stages=[assembler, trees]).fit(df)


def predict(model: PipelineModel, df: DataFrame, out: str = "predicted_label_value") -> DataFrame:
    """Predictions limited to 0..1, as float."""
    scored = model.transform(df)
    value = clip_unit(F.col("_prediction")).cast("float")
    return scored.withColumn(out, value).drop("features", "_prediction")


def sample_counts(df: DataFrame, params: ModelParams, target: str = TARGET) -> DataFrame:
    """One row: rows of the training sample, positive, zero and all rows of labelled rows, without a fit."""
    positive, zero = F.col("positive_rows"), F.col("zero_rows")
    wanted = F.greatest(F.floor(positive * F.lit(params.zero_ratio)), F.lit(1))
    return df.agg(
        F.count_if(F.col(target) > 0).alias("positive_rows"), F.count_if(F.col(target) == 0).alias("zero_rows"),
        F.count(F.lit(1)).alias("numeric_rows"),
    ).select((positive + F.least(zero, wanted)).alias("sampled_rows"), "positive_rows", "zero_rows", "numeric_rows")


def train(
    df: DataFrame, features: Sequence[str], params: ModelParams
) -> tuple[PipelineModel, DataFrame]:
    """Fit a validation model and the final model on labelled rows.

    Returns the final model and one row of validation errors and row counts.  The fits need nothing of
    each other and run side by side: a level of a tree is a short job, and while one fit waits for its
    driver or its last task, the other has the cores.
    """
    labelled = df.where(F.col("y_label_numeric_available") == 1)
    early, late = time_split(labelled, params.validation_start, params.seed)

    def fitted(rows: DataFrame) -> tuple[DataFrame, PipelineModel]:
        sample = balanced_sample(rows, params.zero_ratio, params.seed)
        return sample, fit_regressor(sample, features, params)

    with ThreadPoolExecutor(max_workers=2) as pool:
        running = [pool.submit(inheritable_thread_target(df.sparkSession)(fitted), rows) for rows in (early, labelled)]
        (_, check), (sample, final) = [r.result() for r in running]
    errors = regression_metrics(predict(check, late, "_predicted"), TARGET, "_predicted")
    counts = labelled.agg(
        F.count_if(F.col(TARGET) > 0).alias("positive_rows"),
        F.count_if(F.col(TARGET) == 0).alias("zero_rows"),
        F.count(F.lit(1)).alias("numeric_rows"),
    ).first()
    metrics = errors.select(
        F.col("mae").alias("validation_mae"),
        F.col("rmse").alias("validation_rmse"),
        F.lit(sample.count()).alias("sampled_rows"),
        *[F.lit(counts[c]).alias(c) for c in ("positive_rows", "zero_rows", "numeric_rows")],
    )
    return final, metrics


def save_model(model: PipelineModel, path: str, threshold: float, features: Sequence[str]) -> None:
    """Write the model, and beside it the threshold and the feature names as JSON."""
    model.write().overwrite().save(f"{path}/model")
    settings = SparkSession.active().range(1).select(
        F.lit(threshold).alias("label_threshold"),
        F.array(*[F.lit(f) for f in features]).alias("features"),
    )
    settings.write.mode("overwrite").json(f"{path}/settings")


def load_model(path: str) -> tuple[PipelineModel, float, list[str]]:
    settings = SparkSession.active().read.json(f"{path}/settings").first()
    return PipelineModel.load(f"{path}/model"), settings["label_threshold"], settings["features"]
