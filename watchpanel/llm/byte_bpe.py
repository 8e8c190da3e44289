"""Byte-level BPE encoding and decoding of whole texts.

Pre-tokens come from `pretokens` as byte ranges of a batch of texts.  Each distinct pre-token is merged
once and kept; new ones of a batch are merged together, one merge a word and round, so that a round is a
few array operations.  Pre-tokens that are long have a heap instead.  The ids carry the byte offset of
every token, by which any range of tokens is decoded without the tokens before it.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel.llm import pretokens
from watchpanel.llm.workers import handing_back

#: bytes of texts that are cut together; a longer text stands alone
BATCH_BYTES = 1 << 18
#: longer pre-tokens are merged by a heap, and not kept
LONG_BYTES = 64
#: pre-tokens that a Python worker keeps
KEPT_WORDS = 250_000

_NONE = np.int64(1 << 40)


def letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, others follow U+00FF."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Ranks:
    """A byte-level vocabulary: tokens, and which two join into which, in what order.

    A file of ranks gives every byte string an id, lower ids join first and a word that is a token needs no
    joins.  A JSON file lists the joins in order.
    """

    def __init__(self, path: str):
        if path.endswith(".json"):
            with open(path, encoding="utf-8") as file:
                model = json.load(file)["model"]
            byte_of = letters()
            ids = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items()}
            named = {token: i for token, i in model["vocab"].items()}
            joins = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
            pairs = {named[x] << 32 | named[y]: (k, named[x + y]) for k, (x, y) in reversed(list(enumerate(joins)))}
            self.words: dict[bytes, int] = ids if model.get("ignore_merges") else {}
            end = model.get("end_of_word_suffix") or ""
            letter_of = {b: c for c, b in byte_of.items()}
            last = [named[letter_of[b] + end] for b in range(256)]
        else:
            with open(path, "rb") as lines:
                entries = [line.split() for line in lines if line.strip()]
            ids = self.words = {base64.b64decode(token): int(rank) for token, rank in entries}
            last = [ids[bytes([b])] for b in range(256)]
            pairs = {
                ids[token[:k]] << 32 | ids[token[k:]]: (i, i)
                for token, i in ids.items()
                for k in range(1, len(token))
                if token[:k] in ids and token[k:] in ids
            }
        self.tokens = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            self.tokens[i] = token
        self.sizes = np.fromiter(map(len, self.tokens), dtype=np.int64, count=len(self.tokens))
        self.first = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], dtype=np.int64)
        # a vocabulary may have tokens of their own for the last byte of a word
        self.of_last = np.array(last, dtype=np.int64)
        self.order = {key: k for key, (k, _) in pairs.items()}
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.pair_order = np.array([self.order[key] for key in self.pair.tolist()], dtype=np.int64)
        self.joined = np.zeros(max(k for k, _ in pairs.values()) + 1, dtype=np.int64)
        for k, i in pairs.values():
            self.joined[k] = i
        self.kept: dict[bytes, bytes] = {}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """When each pair joins, or _NONE."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_order[at], _NONE)

    def merged(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of short words as little-endian 32-bit integers: all words together, one merge a round."""
        done = {w: self.words[w] for w in words if w in self.words}
        found = {w: np.uint32(i).tobytes() for w, i in done.items()}
        words = [w for w in words if w not in done]
        if not words:
            return found
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        raw = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.of_byte[raw]
        number = np.arange(len(words))
        rank = np.full(len(ids), _NONE)
        last = np.cumsum(size) - 1
        ids[last] = self.of_last[raw[last]]
        inner = np.ones(len(ids), dtype=bool)
        inner[last] = False
        at = np.flatnonzero(inner)
        rank[at] = self.rank(ids[at], ids[at + 1])
        while len(number):
            begin = np.cumsum(size) - size
            best = np.minimum.reduceat(rank, begin)
            over = best == _NONE
            if over.any():
                data = ids.astype("<u4").tobytes()
                for k in np.flatnonzero(over):
                    found[words[number[k]]] = data[4 * begin[k] : 4 * (begin[k] + size[k])]
                stay = np.repeat(~over, size)
                ids, rank = ids[stay], rank[stay]
                number, size, best = number[~over], size[~over], best[~over]
                if not len(number):
                    break
            word = np.repeat(np.arange(len(number)), size)
            hit = np.flatnonzero(rank == best[word])
            of = word[hit]
            hit = hit[np.append(True, of[1:] != of[:-1])]  # the leftmost of each word
            ids[hit] = self.joined[best]
            keep = np.ones(len(ids), dtype=bool)
            keep[hit + 1] = False
            # the pair that began at the dropped place is judged anew from the joined token
            place = hit - np.arange(len(hit))
            ids, rank = ids[keep], rank[keep]
            size = size - 1
            begin = np.cumsum(size) - size
            final = begin + size - 1
            rank[place] = _NONE
            more = place < final
            rank[place[more]] = self.rank(ids[place[more]], ids[place[more] + 1])
            back = place > begin
            rank[place[back] - 1] = self.rank(ids[place[back] - 1], ids[place[back]])
        return found

    def merged_long(self, word: bytes) -> bytes:
        """Ids of one word, merged by a heap of candidate pairs."""
        if word in self.words:
            return np.uint32(self.words[word]).tobytes()
        start = self.of_byte[np.frombuffer(word, dtype=np.uint8)]
        start[-1] = self.of_last[word[-1]]
        ids = start.tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        order = self.order.get

        def rank(i: int) -> int | None:
            j = after[i]
            return order(ids[i] << 32 | ids[j]) if j < n else None

        heap = [(r, i) for i, r in enumerate(self.rank(start[:-1], start[1:]).tolist()) if r != _NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue  # one of the two is gone by now
            gone = after[i]
            ids[i], ids[gone] = int(self.joined[r]), -1
            after[i] = after[gone]
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0 and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k))
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw, begin, end, first = pretokens.cut(texts)
        pieces = list(map(raw.__getitem__, map(slice, begin.tolist(), end.tolist())))
        new = set(pieces).difference(self.kept)
        found = self.merged([w for w in new if len(w) <= LONG_BYTES])
        self.kept.update(found)
        long = {w: self.merged_long(w) for w in new if len(w) > LONG_BYTES}
        if long:
            ids = [long[w] if w in long else self.kept[w] for w in pieces]
        else:
            ids = list(map(self.kept.__getitem__, pieces))
        trim(self.kept, KEPT_WORDS)  # after the batch, which has its own list by now
        return [b"".join(ids[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """First byte of each token in its text."""
        sizes = self.sizes[ids]
        return np.cumsum(sizes) - sizes

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> bytes:
        """Bytes of consecutive tokens; `offsets` may begin anywhere in the text."""
        if not len(ids):
            return b""
        sizes = self.sizes[ids]
        place = offsets.astype(np.int64) - int(offsets[0])
        source = np.repeat(self.first[ids] - place, sizes) + np.arange(int(sizes.sum()))
        return self.bytes[source].tobytes()


def trim(kept: dict, most: int) -> None:
    """Drop what came first, down to half of `most`, once there is more."""
    if len(kept) > most:
        for key in list(islice(kept, len(kept) - most // 2)):
            del kept[key]


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@cache
def vocabulary(path: str | None) -> Ranks:
    """The vocabulary of a file, read once in a Python worker with the pre-tokens it has seen."""
    return Ranks(path or default_ranks())


def runs(sizes: list[int], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive items of about `limit` in total; a larger item stands alone."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if i > begin and total + size > limit:
            yield begin, i
            begin, total = i, 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", *, ranks: str | None = None) -> DataFrame:
    """(key, n_tokens, ids, offsets) of every row; ids and offsets are packed little-endian 32-bit integers.

    `ranks` is a file of token and rank that every executor has; without one, the installed
    byte_bpe_multi_50k.tiktoken.  Offsets are the first byte of each token in the UTF-8 text.  Null and
    empty texts have no tokens, keys may be null, repeated rows stay, an empty table gives an empty one;
    other columns are left out, whatever their names.  A text of any length is one row, cut in one go.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks)
        for batch in batches:
            for a, b in runs(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist(), BATCH_BYTES):
                ids = known.encode([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                offsets = [known.offsets(np.frombuffer(x, dtype="<u4")).astype("<u4").tobytes() for x in ids]
                numbers = pa.array([len(x) // 4 for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), numbers, pa.array(ids, pa.binary()), pa.array(offsets, pa.binary())],
                    names=["k", "n_tokens", "ids", "offsets"],
                )

    source = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(handing_back(run), f"k {kind}, n_tokens long, ids binary, offsets binary").withColumnRenamed("k", key)


def decode(
    encoded: DataFrame, ids: str = "ids", offsets: str = "offsets", out: str = "decoded", *, ranks: str | None = None
) -> DataFrame:
    """`encoded` with the bytes of its tokens as column `out`; null ids or offsets give null.

    The rows may hold a range of a text's tokens with their offsets, and give that range of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(ranks)
        for batch in batches:
            for a, b in runs(pc.fill_null(pc.binary_length(batch.column(0)), 0).to_pylist(), BATCH_BYTES):
                packed, places = (batch.column(i).slice(a, b - a).to_pylist() for i in (0, 1))
                made = [
                    None if x is None or y is None else known.decode(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))
                    for x, y in zip(packed, places)
                ]
                rest = [batch.column(i).slice(a, b - a) for i in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), *rest], names=names)

    columns = [c for c in encoded.columns if c != out]
    source = encoded.select(
        F.col(f"`{ids}`").alias("_0"), F.col(f"`{offsets}`").alias("_1"),
        *[F.col(f"`{c}`").alias(f"_{i + 2}") for i, c in enumerate(columns)],
    )
    names = ["_out", *source.columns[2:]]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields[2:])
    return source.mapInArrow(handing_back(run), f"_out binary, {kinds}").toDF(out, *columns).select(*[f"`{c}`" for c in columns], f"`{out}`")
