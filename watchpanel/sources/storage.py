"""Shared storage for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession

#: with it Spark deletes the shuffle files of a plan at the end of its action
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: rows of a partition of `by_rows`: keys and numbers, a few MB
ROWS_PER_PART = 1 << 16
#: trials of a search compute in threads of their own, with one session
_setting = threading.Lock()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder of the session for checkpoints; a local one is made only for local masters."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="watchpanel-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, so that partition numbers stay what they are.

    The shuffle files of the plan are deleted when the rows are stored.  Otherwise they stay until the
    driver collects its garbage, and the rounds of a loop fill the disks.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    with _setting:
        before = spark.conf.get(CLEANUP, "false")
        spark.conf.set(CLEANUP, "true")
        try:
            # a plan takes the setting when it is made
            once = df.select("*")
        finally:
            spark.conf.set(CLEANUP, before)
    return once.checkpoint(eager=True)


def by_rows(stored: DataFrame, rows: int | None = None) -> DataFrame:
    """Stored rows in as many partitions as their number asks for, and no more than they have.

    Later steps run a task for each partition of what they read, however little it holds; in a loop these
    are most of the tasks.  `rows` is the number of rows, where it is known.
    """
    n = stored.count() if rows is None else rows
    return stored.coalesce(parts_for(n))


def parts_for(rows: int) -> int:
    return max(1, -(-rows // ROWS_PER_PART))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder name in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
