"""Burst tries against plain loops: bursts of several rounds, groups of copies, odd rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from watchpanel.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, group=100, most=6):
    """Nodes from rows (conv_id, turn, role, text)."""
    original = {}
    for c, turn, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def order(t):
        return t[0], t[1], hashlib.sha256(f"{len(t[2])}:{t[2]}{t[3]}".encode()).hexdigest()[:32]

    turns = {c: [t[2:] for t in sorted(ts, key=order)] for c, ts in original.items()}
    made = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % most
        made[c] = tuple(turns.get(c - c % group, [])[:h] + own[h:])
    nodes = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(seq[:d], []).append(c)
    leaves, saved, children = {}, {}, {}
    for seq in nodes:
        if seq:
            children[seq[:-1]] = children.get(seq[:-1], 0) + 1
    for seq, members in nodes.items():
        for d in range(len(seq) + 1):
            leaves[seq[:d]] = leaves.get(seq[:d], 0) + (seq not in children)
            saved[seq[:d]] = saved.get(seq[:d], 0) + (len(members) - 1) * (len(seq[-1][1]) if seq else 0)
    out = []
    for seq, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if made[c] == seq)
        out.append((
            min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), children.get(seq, 0),
            leaves[seq], saved[seq], hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return out


def same(df, want):
    assert df.columns == COLUMNS
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def table(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_against_loops(spark, limit):
    draw = random.Random(11)
    rows = []
    for c in range(260):
        base = c % 7
        for t in range(draw.randint(1, 9)):
            # shared beginnings of different lengths, copies among them
            text = f"turn {base} {t} é\U0001f600" if t < draw.randint(0, 9) else f"own {draw.randint(0, 3)}"
            rows.append((c, t, draw.choice(["user", "user", None]), text))
    # copies, a long chain of shared turns that parts late, and one that ends inside another
    rows += [(c, t, "user", "same" * t) for c in range(306, 340) for t in range(6)]
    rows += [(c, t, "system", f"{t}" if t < 60 - c % 5 else f"{c} {t}") for c in range(406, 420) for t in range(70)]
    rows += [(c, t, "system", f"{t}") for c in (430, 431) for t in range(50)]
    same(prefix_trie.conversation_trie(table(spark, rows), container_sequences=limit), brute(rows))


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "no conversation"), (7, None, None, None), (7, 1, "", ""), (7, 1, "", ""), (7, None, "a", "b"),
        (8, 3, "user", "x" * 50_000), (8, 2, "ab", "c"), (9, 2, "a", "bc"), (100, 0, "user", "first"), (106, 5, "user", "later"),
        (10, 0, "user", ""), (200_000_000_000, 0, "user", "é"), (300, 1, "u", "t"), (309, 1, "u", "t"),
    ]
    docs = table(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("key", "turns", "digest", "heads", "n", "place", "depth")])
    for limit in (1, 1000):
        same(prefix_trie.conversation_trie(docs, container_sequences=limit), brute(rows))
        assert prefix_trie.conversation_trie(docs.limit(0), container_sequences=limit).collect() == []


def test_conversation_without_turns_of_its_own(spark):
    # c keeps nothing after its first h turns, and its group has no first conversation
    c = next(x for x in range(101, 200) if zlib.crc32(str(x).encode()) % 6 > 1)
    rows = [(c, 0, "user", "gone")]
    want = [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert brute(rows) == want
    same(prefix_trie.conversation_trie(table(spark, rows)), want)


def test_members_in_many_chunks(spark):
    members = spark.range(5_000).selectExpr("cast('a' as binary) as node", "id as m").unionAll(
        spark.createDataFrame([(b"b", 10), (b"b", 9)], "node binary, m long")
    )
    found = {bytes(r.node): r.sha for r in prefix_trie.member_digests(members, "node", "m", "sha").collect()}
    assert found == {
        b"a": hashlib.sha256(",".join(map(str, range(5_000))).encode()).hexdigest(),
        b"b": hashlib.sha256(b"9,10").hexdigest(),
    }
