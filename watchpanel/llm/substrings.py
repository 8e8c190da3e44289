"""Repeated passages: fixed-block anchors.

A passage is a window of `width` consecutive words that also starts in a document with a smaller key.
Reference blocks are non-overlapping runs of `block` words at places 0, block, 2*block, ... of every
document; with 2 * block - 1 <= width each window holds a whole one.  Every rolling run of
`block` words of every document probes the index of blocks; a block that is met under another key is an
anchor.  Around the hits, anchors are extended: all windows that hold an anchor are compared by their own
hash, so a repeat comes out as long as it is exact, and its words are the union of its windows.

Documents are dealt into chunks by a hash.  A chunk sends, for each part of the hash space, its distinct
run hashes as one packed value, so a passage that a third of all documents share counts once for
a chunk, no row is sent for a single word, and no pairs of documents are formed.  Texts are shuffled
once; the steps that need them read that shuffle again.  Hashes are 64 bits wide; of runs only the first
bits are sent, as a run that only looks like a block adds windows to compare and no result.  Keys are
compared as numbers.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel.llm.wordspans import Words, covered, slices, utf8

WIDTH, BLOCK = 13, 7
#: characters of a chunk and hashes of a part on average
CHUNK_CHARS = 4_000_000
PART_HASHES = 2_000_000
#: bits of a run's hash that are sent beyond those that number the words
SPARE_BITS = 10


def _planes(values: np.ndarray) -> bytes:
    """64-bit values, their lowest bytes first, then their second ones and so on, compressed."""
    return zlib.compress(values.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _values(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _packed(hashes: np.ndarray) -> bytes:
    """Ascending hashes by their distances, which have fewer bits."""
    return _planes(np.diff(hashes, prepend=np.uint64(0)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_values(data), dtype=np.uint64)


def _part(hashes: np.ndarray, parts: int, bits: int) -> np.ndarray:
    return ((hashes >> np.uint64(bits - 16)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def _least(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, ascending, and the least key of each."""
    order = np.lexsort((keys, hashes))
    hashes, keys = hashes[order], keys[order]
    first = np.concatenate([[True], hashes[1:] != hashes[:-1]])[: len(hashes)]
    return hashes[first], keys[first]


def _has(ascending: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(hashes), bool)
    return ascending[np.minimum(np.searchsorted(ascending, hashes), len(ascending) - 1)] == hashes


def _by_part(hashes: np.ndarray, parts: int, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, index of hashes) for ascending hashes."""
    part = _part(hashes, parts, bits)
    cuts = np.flatnonzero(np.diff(part)) + 1
    for at in np.split(np.arange(len(hashes)), cuts):
        if len(at):
            yield int(part[at[0]]), at


def _blocks_in_chunk(texts: list, ids: np.ndarray, block: int, cut_off: np.uint64) -> tuple[np.ndarray, ...]:
    """Sorted distinct run hashes of a chunk, which of them are blocks, and which have several keys."""
    hashes, fixed, owners = [np.zeros(0, np.uint64)], [np.zeros(0, bool)], [np.zeros(0, np.int64)]
    for cut in slices(texts):
        words = Words(texts[cut])
        at, h = words.windows(block)
        doc = words.doc[at]
        hashes.append(h >> cut_off)
        fixed.append((at - words.first[doc]) % block == 0)
        owners.append(ids[cut][doc])
    h = np.concatenate(hashes)
    order = np.argsort(h, kind="stable")
    h, keys = h[order], np.concatenate(owners)[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])[: len(h)])
    if not len(h):
        return h, np.zeros(0, bool), np.zeros(0, bool)
    several = np.minimum.reduceat(keys, first) != np.maximum.reduceat(keys, first)
    return h[first], np.logical_or.reduceat(np.concatenate(fixed)[order], first), several


def _met_again(hashes: list[np.ndarray], fixed: list[np.ndarray], several: list[np.ndarray]) -> np.ndarray:
    """Ascending hashes of the blocks that chunks hold under several keys, or several chunks hold."""
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    if not len(every):
        return every
    again = np.logical_or.reduceat(np.concatenate(several)[order], first) | (np.diff(first, append=len(every)) > 1)
    return every[first][again & np.logical_or.reduceat(np.concatenate(fixed)[order], first)]


def _bits(flags: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(flags).tobytes(), 1)


def _flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(data), np.uint8), count=n).astype(bool)


def repeated_words(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    width: int = WIDTH,
    block: int = BLOCK,
    with_text: bool = False,
    chunk_chars: int = CHUNK_CHARS,
    part_hashes: int = PART_HASHES,
) -> DataFrame:
    """(key, n_words, n_removed, kept_sha256[, kept_text]) of every row.

    Windows are judged on the input.  A null text has no words.  Rows that repeat a key do not remove
    each other's words; rows with a null key count as the largest key.  `kept_text` is the kept
    words joined by one space.  Other columns are left out.
    """
    if 2 * block - 1 > width:
        raise ValueError("a window must hold a whole block")
    total = docs.agg(F.sum(F.length(text).cast("bigint"))).first()[0] or 0
    chunks = max(1, round(total / chunk_chars))
    parts = min(1 << 16, max(1, round(total / 6 / part_hashes)))
    top = np.iinfo(np.int64).max
    # of a run's hash so many bits are sent that one in 2 ** SPARE_BITS runs, or fewer, looks like a block
    bits = min(64, max(16, SPARE_BITS + math.ceil(math.log2(total + 2))))
    cut_off = np.uint64(64 - bits) if bits < 64 else np.uint64(0)
    # a null key in pandas would turn the others into floats
    rows = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(top - 1)).alias("id"), F.col(text).alias("text"))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("id", F.length("text")), F.lit(chunks)))

    def keys(frame: pd.DataFrame) -> np.ndarray:
        return frame["id"].to_numpy(np.int64)

    def send_blocks(frame: pd.DataFrame) -> pd.DataFrame:
        h, fixed, several = _blocks_in_chunk(utf8(frame["text"]), keys(frame), block, cut_off)
        chunk = int(frame["chunk"].iloc[0])
        out = [(chunk, p, _packed(h[at]), _bits(fixed[at]), _bits(several[at])) for p, at in _by_part(h, parts, bits)]
        return pd.DataFrame(out, columns=["chunk", "part", "hashes", "fixed", "several"])

    def find_anchors(frame: pd.DataFrame) -> pd.DataFrame:
        hashes = [_unpacked(x) for x in frame["hashes"]]
        flags = [[_flags(x, len(h)) for x, h in zip(frame[c], hashes)] for c in ("fixed", "several")]
        anchors = _met_again(hashes, *flags)
        hits = [h[_has(anchors, h)] for h in hashes]
        out = [(chunk, _packed(hit)) for chunk, hit in zip(frame["chunk"], hits) if len(hit)]
        return pd.DataFrame(out, columns=["chunk", "hashes"])

    def send_windows(texts_: pd.DataFrame, anchors_: pd.DataFrame) -> pd.DataFrame:
        """The distinct windows around a chunk's anchors, with the least key of each."""
        out = []
        if len(texts_) and len(anchors_):
            anchors = np.sort(np.concatenate([_unpacked(x) for x in anchors_["hashes"]]))
            texts, ids = utf8(texts_["text"]), keys(texts_)
            hashes, owners = [], []
            for cut in slices(texts):
                words = Words(texts[cut])
                at, h = _anchored_windows(words, anchors, cut_off, width, block)
                hashes.append(h)
                owners.append(ids[cut][words.doc[at]])
            h, least = _least(np.concatenate(hashes), np.concatenate(owners))
            chunk = int(texts_["chunk"].iloc[0])
            out = [(chunk, p, _packed(h[at]), _planes(least[at])) for p, at in _by_part(h, parts, 64)]
        return pd.DataFrame(out, columns=["chunk", "part", "hashes", "least"])

    def started_before(frame: pd.DataFrame) -> pd.DataFrame:
        """For each chunk: its windows that have a smaller key elsewhere."""
        hashes = [_unpacked(x) for x in frame["hashes"]]
        least = [_values(x).view(np.int64) for x in frame["least"]]
        all_h, all_k = _least(np.concatenate(hashes), np.concatenate(least))
        out = []
        for chunk, h, k in zip(frame["chunk"], hashes, least):
            earlier = all_k[np.searchsorted(all_h, h)] < k
            if earlier.any():
                out.append((chunk, _packed(h[earlier])))
        return pd.DataFrame(out, columns=["chunk", "hashes"])

    def remove(texts_: pd.DataFrame, known_: pd.DataFrame) -> pd.DataFrame:
        known = np.sort(np.concatenate([np.zeros(0, np.uint64), *[_unpacked(x) for x in known_["hashes"]]]))
        texts, ids = utf8(texts_["text"]), keys(texts_)
        cuts, found = list(slices(texts)), []
        for cut in cuts:
            words = Words(texts[cut])
            at, h = words.windows(width)
            found.append((at, h, ids[cut][words.doc[at]]))
        # a window that starts in one chunk only is judged by the keys of that
        own, least = _least(*[np.concatenate([np.zeros(0, t), *[f[i] for f in found]]) for i, t in ((1, np.uint64), (2, np.int64))])
        out = []
        for cut, (at, h, key_) in zip(cuts, found):
            split = [(t or b"").split() for t in texts[cut]]
            ends = np.cumsum([len(s) for s in split])
            gone = covered(at[_has(known, h) | (least[np.searchsorted(own, h)] < key_)], width, int(ends[-1]))
            for id_, text_, mine, lost in zip(texts_["id"].iloc[cut], texts[cut], split, np.split(gone, ends[:-1])):
                kept = b" ".join(compress(mine, ~lost))
                whole = kept.decode() if with_text and text_ is not None else None
                out.append((id_, len(mine), int(lost.sum()), hashlib.sha256(kept).hexdigest(), whole))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    by_chunk = rows.groupBy("chunk")
    sent = by_chunk.applyInPandas(
        send_blocks, "chunk long, part long, hashes binary, fixed binary, several binary"
    )
    anchors = sent.groupBy("part").applyInPandas(find_anchors, "chunk long, hashes binary")
    windows = by_chunk.cogroup(anchors.groupBy("chunk")).applyInPandas(
        send_windows, "chunk long, part long, hashes binary, least binary"
    )
    known = windows.groupBy("part").applyInPandas(started_before, "chunk long, hashes binary")
    removed = by_chunk.cogroup(known.groupBy("chunk")).applyInPandas(
        remove, "id long, n_words long, n_removed long, kept_sha256 string, kept_text string"
    )
    out = removed.withColumn("id", F.when(F.col("id") != top - 1, F.col("id"))).withColumnRenamed("id", key)
    return out if with_text else out.drop("kept_text")


def _anchored_windows(words: Words, anchors: np.ndarray, cut_off: np.uint64, width: int, block: int):
    """Index of the first word, and hash, of each window that holds an anchor."""
    near = np.zeros(len(words) + 1, np.int64)
    start, runs = words.windows(block)
    hit = start[_has(anchors, runs >> cut_off)]
    # a window holds the run if it starts at most width - block words before it
    np.add.at(near, np.maximum(hit - (width - block), 0), 1)
    np.add.at(near, hit + 1, -1)
    at, hashes = words.windows(width)
    held = np.cumsum(near)[at] > 0
    return at[held], hashes[held]
