"""Connected components of a graph given by its links, without collecting any group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.sources.storage import materialize

#: links of a partition, a few tens of MB.  Up to so many are contracted in one task without any shuffle: each
#: shuffle is a job of its own, with a thread of the driver that stays for a minute, and rounds are many
LINKS_PER_PART = 1 << 19


def _stars(links: DataFrame, larger: bool, parts: int) -> DataFrame:
    """One contraction: links of a node are moved to the smallest node among its neighbours.

    `larger`: neighbours above the node move, seen from both ends; otherwise the node and its
    neighbours below it move.  The steps have no more than `parts` partitions.
    """
    if larger:
        both = links.unionByName(links.select(F.col("high").alias("low"), F.col("low").alias("high")))
        near = both.select(F.col("low").alias("node"), F.col("high").alias("other"))
        least = near.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"))
        moved = near.where("other > node").join(least, "node").select(
            F.col("other").alias("high"), F.col("least").alias("low")
        )
    else:
        least = links.groupBy("high").agg(F.min("low").alias("least"))
        moved = (
            links.join(least, "high")
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .unionByName(least.select("high", F.col("least").alias("low")))
        )
    return moved.where("low < high").select("low", "high").coalesce(parts).distinct().coalesce(parts)


def _stars_in_one(links: DataFrame) -> DataFrame:
    """Both contractions of links in one partition, without a shuffle: windows instead of joins."""

    def pairs(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], names: tuple[str, str]) -> DataFrame:
        each = F.array(*[F.struct(*[F.col(c).alias(name) for c, name in zip(pair, names)]) for pair in (first, second)])
        return rows.select(F.explode(each).alias("pair")).select("pair.*")

    near = pairs(links, ("low", "high"), ("high", "low"), ("node", "other"))
    least = F.least(F.min("other").over(Window.partitionBy("node")), "node")
    larger = near.withColumn("low", least).where("other > node").select("low", F.col("other").alias("high")).distinct()
    below = larger.withColumn("least", F.min("low").over(Window.partitionBy("high")))
    return pairs(below, ("least", "low"), ("least", "high"), ("low", "high")).where("low < high").distinct()


def _parts(links: int) -> int:
    return max(1, -(-links // LINKS_PER_PART))


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached, for each node that has a link.

    Alternating large-star and small-star steps move links towards the smallest node of each
    component until nothing changes; the number of rounds grows with the logarithm of the longest
    chain.  A round of many links is two joins on nodes, so a node with very many links is split like any
    skewed key; a round of few links is one task.  Null nodes and links from a node to itself are ignored.
    """
    now = materialize(
        links.select(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    mark, parts = None, None
    while True:
        # the partitions of a stored table are not known to be one
        seen = (now if parts is None else now.coalesce(parts)).agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)")).alias("h")
        ).first()
        if (seen.n, seen.h) == mark or not seen.n:
            break
        mark = (seen.n, seen.h)
        # a few links take a few tasks, whatever the number of shuffle partitions
        parts = _parts(seen.n)
        now = now.coalesce(parts)
        if parts == 1:
            now = materialize(_stars_in_one(now))
        else:
            now = materialize(_stars(_stars(now, larger=True, parts=parts), larger=False, parts=parts))
    parts = _parts(seen.n)
    now = now.coalesce(parts)
    top = now.select(F.col("low").alias("node")).distinct().coalesce(parts)
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        top.select("node", F.col("node").alias("component"))
    )
