"""Prefix trie of conversations by burst tries.

A turn is reduced to a digest of role and text (and the text's length) where it is read; a conversation
is its list of digests, and equal conversations are one sequence with a number of members.  All sequences
start in one container under the root.  A container with too many sequences bursts: its members share
some turns, which become a path of trie heads, and the next turn's id says which new container each
member goes to.  A burst always parts its members, however long a shared beginning is, as the shared
turns are skipped at once.  The containers that remain are sorted, and one sweep over the sorted
sequences makes their nodes, holding the path of the current sequence only.  What subtrees add up to
under the heads is summed from the containers' top nodes, each of which knows the bursts above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel.sources.storage import materialize

#: a container with more sequences bursts
CONTAINER_SEQUENCES = 1000
#: a conversation's key is repeated so often where members of one container meet its summary
SALTS = 32
#: conversation ids of one node that are joined before they are digested in order
CHUNK_IDS = 512

_EMPTY = hashlib.sha256(b"").hexdigest()
_TURN = "struct<id:binary,n:int>"


def turn_lists(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) of the conversations: per turn in order its digest and the code points of its text.

    Null turns come first, null roles and texts are empty, turns of one number are ordered by digest.
    Rows without conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    # the role's length keeps ("ab", "c") and ("a", "bc") apart
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.struct(F.col("turn").alias("turn"), F.struct(digest.alias("id"), F.length(text).alias("n")).alias("what")).alias("at"),
    )
    lists = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return lists.select("conv_id", F.col("at.what").alias("turns"))


def rebuilt(lists: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, turns): the first h turns of the group's first conversation, then the own ones after h.

    The group's first conversation is c - c % `group`, h is crc32 of the decimal c modulo `most`.
    """
    c, base = F.col("conv_id"), F.col("conv_id") - F.col("conv_id") % group
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    heads = lists.where(c % group == 0).select(c.alias("base"), F.slice("turns", 1, most).alias("head"))
    whole = lists.select("conv_id", "turns", base.alias("base"), h.alias("h")).join(heads, "base", "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.coalesce(F.slice("head", 1, F.col("h")), F.array().cast(f"array<{_TURN}>"))
    return whole.select("conv_id", F.concat(first, own).alias("turns"))


def _digest(turns: Column) -> Column:
    """Digest of a list of turn ids, which have one length each."""
    joined = F.concat_ws("", F.transform(turns, lambda t: F.hex(t["id"])))
    return F.unhex(F.substring(F.sha2(joined.cast("binary"), 256), 1, 32))


def _shared(a: Column, b: Column) -> Column:
    """Number of turns that two lists begin with in common."""
    length = F.least(F.size(a), F.size(b))
    places = F.filter(
        F.sequence(F.lit(0), F.greatest(length - 1, F.lit(0))),
        lambda i: (i < length) & (F.get(a, i)["id"] != F.get(b, i)["id"]),
    )
    return F.coalesce(F.get(places, F.lit(0)), length)


def _burst(open_: DataFrame, limit: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(members of containers that stay, heads of those that burst, members of the new containers)."""
    sizes = open_.groupBy("key").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("least"),
        F.min("turns").alias("low"), F.max("turns").alias("high"), F.first("depth").alias("depth"),
        F.first("above").alias("above"), F.first("heads").alias("heads"),
    )
    large = materialize(sizes.where(F.col("size") > limit))
    if large.isEmpty():
        return open_, None, None
    heads = large.withColumn("reach", _shared(F.col("low"), F.col("high"))).select(
        "key", "n_convs", "least", "depth", "above", "heads", "reach",
        # the shared path, and the length of its turns
        F.transform(F.slice("low", 1, F.col("reach")), lambda t: t["n"].cast("bigint")).alias("lengths"),
    )
    # a large container is met in SALTS parts
    salt = F.pmod(F.xxhash64("digest"), F.lit(SALTS)).cast("int")
    few = heads.select(
        F.col("key"), F.col("reach"), F.col("least").alias("_least"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    )
    met = materialize(open_.withColumn("_salt", salt).join(few, ["key", "_salt"], "left").drop("_salt"))
    stay = met.where("reach is null").drop("reach", "_least")
    down = met.where("reach is not null and size(turns) > reach").select(
        _digest(F.slice("turns", 1, F.col("reach") + 1)).alias("key"), (F.col("reach") + 1).alias("depth"),
        F.col("_least").alias("above"), F.concat("heads", F.array("key")).alias("heads"),
        "digest", "turns", "n", "conv_id", F.col("key").alias("parent"),
    )
    ended = met.where("reach is not null and size(turns) = reach").select(
        F.col("key").alias("of"), F.col("digest").alias("ended")
    )
    children = down.groupBy("parent").agg(F.count_distinct("key").alias("n_children")).withColumnRenamed("parent", "of")
    heads = heads.join(children, F.col("key") == F.col("of"), "left").drop("of").join(ended, F.col("key") == F.col("of"), "left").drop("of")
    return stay, materialize(heads), down.drop("parent")


class _Sweep:
    """Nodes of sorted sequences of one container after another; holds one path."""

    def __init__(self):
        self.key = None
        self.path: list[list] = []
        self.rows: list[tuple] = []

    def _close(self, depth: int) -> None:
        """Finish the nodes below `depth`, deepest first; a node's parent lies before it on the path."""
        while self.path and self.path[-1][0] > depth:
            at, _, n, least, children, leaves, saved, size, ended, waiting = self.path.pop()
            saved += (n - 1) * size
            leaves = leaves if children else 1
            # the children waited for the smallest member of this node
            self.rows += [(c[0], c[1], least, *c[2:]) for c in waiting]
            row = (least, at, n, children, leaves, saved, ended)
            if self.path:
                up = self.path[-1]
                up[2] += n
                up[3] = min(up[3], least)
                up[4] += 1
                up[5] += leaves
                up[6] += saved
                up[9].append((*row, None))
            else:
                self.rows.append((row[0], row[1], self.above, *row[2:], self.heads))

    def add(self, key, depth, above, heads, ids, sizes, digest, n, conv) -> None:
        if key != self.key:
            self.finish()
            self.key, self.above, self.heads = key, above, heads
            self.ids: list = ids[:depth]
            shared = depth
        else:
            shared = depth
            stop = min(len(ids), len(self.ids))
            while shared < stop and ids[shared] == self.ids[shared]:
                shared += 1
        self._close(shared)
        for d in range(self.path[-1][0] + 1 if self.path else depth, len(ids) + 1):
            # the members of a node are counted where they end
            self.path.append([d, None, 0, conv, 0, 0, 0, sizes[d - 1] if d else 0, None, []])
        top = self.path[-1]
        top[2] += n
        top[3] = min(top[3], conv)
        top[8] = digest
        self.ids = ids

    def finish(self) -> None:
        self._close(-1)
        self.key = None

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


_NODES = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ended binary, heads array<binary>"
)
_NODE_TYPES = [pa.int64()] * 7 + [pa.binary(), pa.list_(pa.binary())]
_NODE_FIELDS = [x for f, t in zip(_NODES.split(", "), _NODE_TYPES) for x in (f.split()[0], t)]


def _batch(rows: list[tuple], *fields) -> pa.RecordBatch:
    """Rows as a batch; `fields` are names and types in turn."""
    names, types = fields[::2], fields[1::2]
    columns = list(zip(*rows)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = _Sweep()
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(batch.num_columns)]):
            sweep.add(*row)
            if len(sweep.rows) >= 10_000:
                yield _batch(sweep.take(), *_NODE_FIELDS)
    sweep.finish()
    yield _batch(sweep.take(), *_NODE_FIELDS)


def _head_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of the paths of bursts: all have the members of the last one."""
    for batch in batches:
        rows = []
        for b in batch.to_pylist():
            saved = b["saved"]
            for d in range(b["reach"], b["depth"] - 1, -1):
                saved += (b["n_convs"] - 1) * (b["lengths"][d - 1] if d else 0)
                last = d == b["reach"]
                rows.append((
                    b["least"], d, b["above"] if d == b["depth"] else b["least"], b["n_convs"],
                    b["n_children"] if last else 1, b["n_leaves"], saved, b["ended"] if last else None, None,
                ))
        yield _batch(rows, *_NODE_FIELDS)


def member_digests(members: DataFrame, node: str, member: str, out: str) -> DataFrame:
    """(node, out): SHA-256 of the node's members in ascending order, decimal and comma-joined.

    A node may have any number of members: ranges of the order join CHUNK_IDS of them at a time, and the
    digest reads these chunks as they come.
    """

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush(rows):
            if held:
                rows.append((at, held[0], ",".join(map(str, held))))

        for batch in batches:
            rows: list[tuple] = []
            for n, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != at or len(held) >= CHUNK_IDS:
                    flush(rows)
                    at, held = n, []
                held.append(m)
            yield _batch(rows, "node", pa.binary(), "first", pa.int64(), "ids", pa.string())
        rows = []
        flush(rows)
        yield _batch(rows, "node", pa.binary(), "first", pa.int64(), "ids", pa.string())

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            rows = []
            for n, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if n != at:
                    if state is not None:
                        rows.append((at, state.hexdigest()))
                    at, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _batch(rows, "node", pa.binary(), "sha", pa.string())
        yield _batch([(at, state.hexdigest())] if state is not None else [], "node", pa.binary(), "sha", pa.string())

    rows = members.select(F.col(node).alias("node"), F.col(member).alias("member"))
    ranged = rows.repartitionByRange("node", "member").sortWithinPartitions("node", "member")
    joined = ranged.mapInArrow(chunks, "node binary, first long, ids string")
    ordered = joined.repartition("node").sortWithinPartitions("node", "first").select("node", "ids")
    return ordered.mapInArrow(digests, "node binary, sha string").toDF(node, out)


def trie(sequences: DataFrame, *, container_sequences: int = CONTAINER_SEQUENCES) -> DataFrame:
    """Nodes of the trie of (conv_id, turns); `turns` is a list of (id, n), n its length.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) per
    distinct beginning of a sequence, the empty one included: the smallest member and its parent's, members,
    children, childless nodes below (itself, if it has none), the sum of (members - 1) x length over the
    subtree, and the digest of the members that end there.  Conversation ids are distinct and not null; a
    sequence may be empty; an empty table gives an empty one.  A sequence is one row, so a task holds the
    ids of one conversation's turns, but no texts; containers, groups of equal sequences and nodes of any
    size are split.
    """
    named = materialize(sequences.select("conv_id", "turns", _digest(F.col("turns")).alias("digest")))
    same = named.groupBy("digest").agg(F.first("turns").alias("turns"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"))
    open_ = materialize(
        same.select(
            F.lit(b"").alias("key"), F.lit(0).alias("depth"), F.lit(None).cast("bigint").alias("above"),
            F.array().cast("array<binary>").alias("heads"), "digest", "turns", "n", "conv_id",
        )
    )
    staying, bursts = [], []
    while True:
        stay, heads, down = _burst(open_, container_sequences)
        staying.append(stay)
        if heads is None:
            break
        bursts.append(heads)
        open_ = materialize(down)
    members = reduce(DataFrame.unionByName, staying)
    # a container's sequences come to one task, in order; containers are small, so any task has many
    dealt = members.repartition("key").withColumn("ids", F.col("turns.id")).sortWithinPartitions("key", "ids")
    nodes = dealt.select("key", "depth", "above", "heads", "ids", F.col("turns.n").alias("sizes"), "digest", "n", "conv_id")
    nodes = materialize(nodes.mapInArrow(_swept, _NODES))
    if bursts:
        heads = materialize(reduce(DataFrame.unionByName, bursts))
        tops = nodes.where("heads is not null").select(F.explode("heads").alias("of"), "n_leaves", F.col("saved_tokens").alias("saved"))
        # a burst's own path counts for the bursts above it
        path = F.aggregate(
            F.slice("lengths", F.greatest("depth", F.lit(1)), F.greatest(F.col("reach") - F.greatest("depth", F.lit(1)) + 1, F.lit(0))),
            F.lit(0).cast("bigint"), lambda a, x: a + x,
        )
        paths = heads.select(F.explode("heads").alias("of"), F.lit(0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * path).alias("saved"))
        sums = tops.unionByName(paths).groupBy("of").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved"))
        known = heads.drop("heads").join(sums, F.col("key") == F.col("of")).drop("of")
        nodes = nodes.unionByName(materialize(known.mapInArrow(_head_paths, _NODES)))
    ends = member_digests(named, "digest", "conv_id", "ends_sha256").withColumnRenamed("digest", "ended")
    nodes = nodes.drop("heads")
    # most nodes have no end: they do not meet under one null key
    without = nodes.where("ended is null").withColumn("ends_sha256", F.lit(_EMPTY))
    return nodes.where("ended is not null").join(ends, "ended").unionByName(without).drop("ended")


def conversation_trie(turns: DataFrame, *, container_sequences: int = CONTAINER_SEQUENCES) -> DataFrame:
    """The trie of rebuilt conversations of (conv_id, turn, role, text); other columns are left out."""
    return trie(rebuilt(turn_lists(turns)), container_sequences=container_sequences)
