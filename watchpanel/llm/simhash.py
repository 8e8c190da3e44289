"""SimHash near-duplicates: Golay-code fuzzy hashing of the fingerprints.

A text is lower-cased in A-Z, its words are joined three by three, and each of the 64 fingerprint
bits is 1 if it is set in over half of the XXH64 values (seed 42) of these shingles.  Texts whose
fingerprints differ in at most two bits are linked; links form components.

Search: the 64 bits are three segments of 22, 21 and 21 bits.  Two differing bits leave one segment
without error, and any other segment with two at most.  So a key is an error-free segment with a
Golay index of the next one: 18 keys at most for a fingerprint, and each linked pair shares one.
Keys are compared between distinct fingerprints only.  Keys with few fingerprints are joined
with themselves and each pair is verified.  Fingerprints under a key that holds more
are linked through the 65 points within one bit of each of them, as two fingerprints within two bits
have such a point in common: rows stay in proportion to fingerprints, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchpanel.llm.components import components
from watchpanel.llm.golay import ball_indices
from watchpanel.llm.rowmatch import matching
from watchpanel.sources.storage import materialize

SHINGLE_WORDS = 3
#: (lowest bit, bits) of each segment
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: keys with more fingerprints are linked without forming pairs
PAIRS_UP_TO = 128

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: str | None) -> int:
    """Fingerprint of one text as a signed 64-bit number; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = SHINGLE_WORDS
    if len(words) < k:
        hashes = np.array([_hash(b" ".join(words))], dtype=np.uint64)
    else:
        runs = zip(*(words[i:] for i in range(k)))
        hashes = np.fromiter(map(_hash, map(b" ".join, runs)), np.uint64, len(words) - k + 1)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a column `fingerprint_bits` (bigint).  A null or wordless text has 0."""
    add = F.pandas_udf(lambda s: pd.Series([fingerprint(t) for t in s], dtype="int64"), T.LongType())
    return docs.withColumn("fingerprint_bits", add(F.col(text)))


def _keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), 4096):
            bits = frame["fp"].to_numpy(dtype=np.int64)[at : at + 4096].view(np.uint64)
            seg = [(bits >> np.uint64(low)) & np.uint64((1 << n) - 1) for low, n in SEGMENTS]
            keys, owners = [], []
            for i in range(3):
                j = (i + 1) % 3
                near = np.sort(ball_indices(seg[j], SEGMENTS[j][1]).astype(np.uint64), axis=1)
                new = np.concatenate(
                    [np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]], axis=1
                )
                row, col = np.nonzero(new)
                keys.append(
                    np.uint64(i << 40) | (seg[i][row] << np.uint64(12)) | near[row, col]
                )
                owners.append(row)
            owner = np.concatenate(owners)
            yield pd.DataFrame(
                {"key": np.concatenate(keys).view(np.int64), "fp": bits.view(np.int64)[owner]}
            )


def golay_keys(prints: DataFrame) -> DataFrame:
    """(key, fp) for a table with a column `fp`."""
    return prints.select("fp").mapInPandas(_keys, "key long, fp long")


def links(prints: DataFrame, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """(a, b): links that connect the distinct fingerprints `fp` as all pairs within 2 bits would."""
    keys = golay_keys(prints)
    sizes = keys.groupBy("key").count().where("count > 1")
    few = keys.join(sizes.where(F.col("count") <= pairs_up_to).select("key"), "key")
    left, right = few.withColumnRenamed("fp", "a"), few.withColumnRenamed("fp", "b")
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    pairs = left.join(right, "key").where((F.col("a") < F.col("b")) & close).select("a", "b")

    many = keys.join(sizes.where(F.col("count") > pairs_up_to).select("key"), "key")
    many = materialize(many.select("fp").distinct())
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit((1 << i) - ((i == 63) << 64)).cast("bigint") for i in range(64)])
    points = many.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point"))
    shared = points.groupBy("point").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    through = points.join(shared.select("point", "a"), "point").where("a < fp").select("a", F.col("fp").alias("b"))
    return pairs.unionByName(through)


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for each row.

    `fingerprint` is 16 hex digits; `component_id` is the smallest key reachable through links, its
    own included.  Rows without words share fingerprint 0 and are linked like any other.  Repeated
    rows stay; null keys never become a component id unless a component has no other key.  Other
    columns are left out, whatever their names.
    """
    rows = materialize(
        fingerprints(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text").select(
            "_id", F.col("fingerprint_bits").alias("fp")
        )
    )
    classes = materialize(rows.groupBy("fp").agg(F.min("_id").alias("least")))
    joined = components(links(classes), "a", "b")
    member = classes.join(joined, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    smallest = member.groupBy("root").agg(F.min("least").alias("component_id"))
    named = member.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("_id").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def linked_by(
    *searches: Callable[[DataFrame, str, str], DataFrame],
) -> Callable[[DataFrame, str, str], DataFrame]:
    """A search for `one_per_component`: components of the links of all `searches` together; keys are not null."""

    def near(docs: DataFrame, key: str, text: str) -> DataFrame:
        found = [
            materialize(search(docs, key, text).select(F.col(key).alias("_id"), "component_id")) for search in searches
        ]
        joined = components(reduce(DataFrame.unionByName, found), "_id", "component_id")
        return found[0].join(joined, F.col("_id") == F.col("node"), "left").select(
            F.col("_id").alias(key), F.coalesce("component", "_id").alias("component_id")
        )

    return near


def one_per_component(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    near: Callable[[DataFrame, str, str], DataFrame] = near_duplicates,
) -> DataFrame:
    """One row of `docs` for each component of `near`: the one with the smallest key.

    A row without key takes part under a negative number made from its text, so that equal texts
    without keys are one document.  Of rows repeated under the kept key one stays.
    """
    named = F.coalesce(F.col(key).cast("bigint"), -1 - F.pmod(F.xxhash64(text), F.lit(1 << 62)))
    found = near(docs.select(named.alias("_key"), F.col(text).alias("_body")), "_key", "_body")
    chosen = materialize(
        found.where("_key = component_id").groupBy(F.col("_key").alias("_kept")).agg(F.count("*").alias("_times"))
    )
    once = matching(docs, named, chosen.where("_times = 1"), "_kept", "left_semi")
    again = chosen.where("_times > 1")
    if again.isEmpty():
        return once
    repeated = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("all"), named.alias("key")).join(
        again.select(F.col("_kept").alias("key")), "key", "left_semi"
    )
    return once.unionByName(repeated.groupBy("key").agg(F.min_by("all", F.xxhash64("all")).alias("all")).select("all.*"))
