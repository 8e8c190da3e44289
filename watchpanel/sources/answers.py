"""Answers of scorers, stored under the hash of their text.

A text is scored once, whoever asks for it and however often a run begins anew.  Answers are appended in
slices, each one commit, so that a run that stops keeps what it has; of several answers to one text the
last good one counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpanel.functions.outputs import with_parsed_score
from watchpanel.operators.scoring import Scorer, score_texts
from watchpanel.sources.storage import materialize

SCHEMA = "text_hash string, raw_output string, good boolean, written timestamp, run string"


def text_hash(text: Column | str) -> Column:
    """What a text is stored under; null and empty texts are one."""
    c = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.coalesce(c, F.lit("")), 256)


def parsed_good(answers: DataFrame) -> DataFrame:
    """Add `good`: a score can be read from `raw_output`."""
    return with_parsed_score(answers, "raw_output").withColumn("good", F.col("parse_ok")).drop("risk_score", "parse_ok", "parse_error")


@dataclass(frozen=True)
class AnswerStore:
    """Answers under `path`, for one scorer and its instructions: others get a folder of their own."""

    spark: SparkSession
    path: str
    good: Callable[[DataFrame], DataFrame] = parsed_good
    #: commits of one run; a run that stops loses one of them at most
    slices: int = 8

    def rows(self) -> DataFrame:
        """All answers ever written."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(folder):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(self.path)

    def answers(self) -> DataFrame:
        """`text_hash, raw_output, good`: the last good answer to each text, else the last one."""
        last = F.struct("good", "written", "run")
        return self.rows().groupBy("text_hash").agg(F.max_by(F.struct("raw_output", "good"), last).alias("a")).select("text_hash", "a.*")

    def missing(self, texts: DataFrame, text: str = "text") -> DataFrame:
        """`text_hash, text` of the different texts without a good answer."""
        asked = texts.select(text_hash(text).alias("text_hash"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        different = asked.groupBy("text_hash").agg(F.first("text").alias("text"))
        return different.join(self.answers().where("good").select("text_hash"), "text_hash", "left_anti")

    def score(self, df: DataFrame, make_scorer: Callable[[], Scorer], *, text: str = "text", parts: int | None = None) -> DataFrame:
        """`df` with `raw_output`: stored answers, and new ones for the texts that have none."""
        todo = materialize(self.missing(df, text))
        run = uuid.uuid4().hex
        for i in range(self.slices):
            slice_ = todo.where(F.pmod(F.xxhash64("text_hash"), F.lit(self.slices)) == i)
            if slice_.isEmpty():
                continue
            scored = self.good(score_texts(slice_, make_scorer, parts=parts).drop("text"))
            rows = scored.select("text_hash", "raw_output", "good", F.current_timestamp().alias("written"), F.lit(run).alias("run"))
            rows.write.mode("append").parquet(self.path)
        found = self.answers().select(F.col("text_hash").alias("_hash"), "raw_output")
        return df.withColumn("_hash", text_hash(text)).join(found, "_hash", "left").drop("_hash")
