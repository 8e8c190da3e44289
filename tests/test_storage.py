"""Stored rows and what is left beside them."""

import time

from pyspark.sql import functions as F

from watchpanel.llm.components import components
from watchpanel.sources.storage import ROWS_PER_PART, by_rows, materialize


def shuffle_blocks(spark) -> set[str]:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllBlocks()
    names = (blocks.apply(i).name() for i in range(blocks.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_shuffle_files_go_when_the_rows_are_stored(spark):
    before = shuffle_blocks(spark)
    rows = spark.range(1000).withColumn("k", F.col("id") % 7)
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    stored = materialize(rows.join(sums.hint("merge"), "k").repartition(5, "id"))
    # files are deleted in the background
    for _ in range(100):
        left = shuffle_blocks(spark) - before
        if not left:
            break
        time.sleep(0.1)
    assert left == set()
    # what is not stored keeps its files, and the stored rows stay
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    want = {(i, i % 7, sum(range(i % 7, 1000, 7))) for i in range(1000)}
    for _ in range(2):
        assert {(r.id, r.k, r.s) for r in stored.collect()} == want
    assert stored.columns == ["k", "id", "s"] and stored.rdd.getNumPartitions() == 5


def test_repeated_names_and_empty_tables_are_stored(spark):
    pair = spark.range(3).toDF("a").crossJoin(spark.range(1).toDF("a"))
    assert materialize(pair).columns == ["a", "a"] and materialize(pair).count() == 3
    assert materialize(spark.range(0).groupBy("id").count()).isEmpty()


def test_few_rows_take_few_partitions(spark):
    rows = materialize(spark.range(0, 1000, 1, 50))
    assert by_rows(rows).rdd.getNumPartitions() == 1
    assert by_rows(rows, ROWS_PER_PART + 1).rdd.getNumPartitions() == 2
    # never more than there are
    assert by_rows(rows, 1000 * ROWS_PER_PART).rdd.getNumPartitions() == 50
    assert by_rows(rows).agg(F.sum("id")).first()[0] == 499500
    assert by_rows(rows.where("id < 0")).count() == 0


def test_components_of_few_links_take_few_tasks(spark):
    """Tasks follow the links, not the number of shuffle partitions."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        # a chain and a star
        links = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 20)]
        spark.sparkContext.setJobGroup("few-links", "")
        found = components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert {(r.node, r.component) for r in found} == {(i, 0) for i in range(21)} | {(i, 100) for i in range(100, 120)}
    tracker = spark.sparkContext.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("few-links") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numTasks for i in map(tracker.getStageInfo, stages) if i and i.numCompletedTasks)
    assert 0 < tasks < 800
