"""Sharding by a hierarchical weighted hash tree: region, rack, shard.

At each level a document draws a number for every child from a hash of its key and the child's
name, and descends to the child with the largest ln(u) / weight (u uniform in 0..1), which takes
each child in proportion to its weight.  A child whose weight grows only takes documents, one whose
weight shrinks only gives them away, and nothing moves between children whose weights stay: movement
is confined to subtrees whose weights change.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchpanel.sources.storage import materialize

#: shards in a rack and racks in a region, as shards are numbered
RACK_SHARDS, REGION_RACKS = 2, 2
#: rows numbered by one task on average
SLOT_ROWS = 20_000

#: region -> rack -> shard -> weight
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def even_tree(shards: int) -> Tree:
    """Shards 0.. of weight 1 in racks of two and regions of two racks.

    One more shard after a multiple of four is a region of its own, so that rows move into it only.
    In between it joins a rack or region, whose other shards then take rows too: give such a shard
    a region of its own instead (`with_shard`).
    """
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for s in range(shards):
        rack = s // RACK_SHARDS
        region = rack // REGION_RACKS
        tree.setdefault(f"region{region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def with_shard(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard in a region of its own: it alone takes rows."""
    return {**tree, f"own{shard}": {f"own{shard}": {shard: weight}}}


def _draw(key: Column, node: str, weight: float) -> Column:
    # 53 bits of the hash, in the open interval 0..1
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11).cast("double")
    return F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))


def _choice(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """What belongs to the child with the largest draw; of equal draws the first child."""
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, name, weight) for name, weight, _ in children]
    best = F.greatest(*draws)
    out = children[-1][2]
    for draw, (_, _, value) in reversed(list(zip(draws[:-1], children[:-1]))):
        out = F.when(draw == best, value).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a key: a function of the key and the tree alone.  A null key is a key like others."""
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"shard/{s}", w, F.lit(s)) for s, w in shards.items() if w > 0]
            if leaves:
                inner.append((f"rack/{rack}", sum(w for _, w, _ in leaves), _choice(key, leaves)))
        if inner:
            regions.append((f"region/{region}", sum(w for _, w, _ in inner), _choice(key, inner)))
    if not regions:
        raise ValueError("the tree has no shard with a weight")
    return _choice(key, regions)


def with_slots(rows: DataFrame, shard: str, spread: Column, order: list[str], slot_rows: int = SLOT_ROWS) -> DataFrame:
    """`rows` with `slot`: gapless numbers from 0 within each shard.

    A shard is cut into cells by the hash `spread`; rows are numbered inside a cell, after the rows
    of the cells before it.  The table of cells has a row for each `slot_rows` rows.
    """
    n = rows.count()
    cells = max(1, round(n / slot_rows))
    celled = materialize(rows.withColumn("_cell", F.pmod(spread, F.lit(cells))))
    sizes = celled.groupBy(shard, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(shard).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(shard, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(shard, "_cell").orderBy(*order)
    return (
        celled.withColumn("_place", F.row_number().over(inside) - 1)
        .join(starts, [shard, "_cell"])
        .withColumn("slot", (F.col("_start") + F.col("_place")).cast("bigint"))
        .drop("_cell", "_place", "_start")
    )


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, shard, slot, grown_shard) of every row.

    `size` is the UTF-8 bytes of the text plus 1; a null text has size 1 and no checksum.  Rows
    that share a key (repeated rows, or null keys) share a shard; their slots differ.
    `grown_shard` is the shard under the tree `grown`, null without one.  Other columns are left out.
    """
    body = F.col(text)
    small = docs.select(
        F.col(key).alias("_id"),
        (F.coalesce(F.octet_length(body), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    placed = small.withColumn("shard", shard_of(F.col("_id"), tree)).withColumn(
        "grown_shard", shard_of(F.col("_id"), grown) if grown else F.lit(None).cast("int")
    )
    numbered = with_slots(
        placed, "shard", F.xxhash64(F.lit("cell"), "_id", "text_crc32"), ["_id", "text_crc32"]
    )
    return numbered.select(F.col("_id").alias(key), "size", "text_crc32", "shard", "slot", "grown_shard")
