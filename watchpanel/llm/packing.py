"""Best-fit packing of token sequences: bounded-space online best-fit.

Documents are tokenised and cut into pieces of at most one sequence.  Pieces are dealt into blocks
by a hash; within a block they arrive in a fixed order and each goes into the open bin that it fills
best.  A fixed number of bins is open; when one more is needed, the fullest closes first.  Open bins
are found through a bitset with one bit for each amount of free space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel.llm.byte_bpe import LONG_BYTES, Ranks
from watchpanel.llm.workers import handing_back
from watchpanel.sources.storage import materialize

SEQUENCE_TOKENS = 2048
OPEN_BINS = 256
#: pieces dealt to one block on average
BLOCK_PIECES = 6000
#: words whose ids a Python worker keeps; the older half goes beyond it
KEPT_WORDS = 500_000


# a word of small letters: a-z, and U+00DF to U+00FF in UTF-8
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


def _file(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return path


@cache
def _tokenizer(path: str | None):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(_file(path))


class WordTokens:
    """Token ids of texts for a tokenizer that drops white space and ends every word on its own.

    Each distinct word is encoded once and looked up afterwards.  New words are encoded together,
    with a one-token word (``0``) between them that tells where each ends; words of small letters only are
    merged together by the vocabulary's joins (`byte_bpe`) if that gives the same.  A word of letters with one
    mark of punctuation after it is the word and the mark, and texts of Latin-1 characters are looked up
    in small letters if the tokenizer makes them small itself.
    """

    MARK = b"0"
    PUNCTUATION = b".,;:!?"

    def __init__(self, path: str | None, kept: int = KEPT_WORDS):
        self.tokenizer = _tokenizer(path)
        self.kept = kept
        self.ids: dict[bytes, bytes] = {}
        (self.mark,) = self._encode(self.MARK).tolist()
        if not np.array_equal(self._encode(b"ab cd"), np.concatenate([self._encode(b"ab"), self._encode(b"cd")])):
            raise ValueError("the tokenizer must drop white space and end every word on its own")
        joined = lambda *parts: np.concatenate([self._encode(p) for p in parts])
        self.small = np.array_equal(self._encode("AB \u00c9Z".encode()), self._encode("ab \u00e9z".encode()))
        self.parted = all(
            np.array_equal(self._encode(b"ab" + p), joined(b"ab", p)) and np.array_equal(self._encode(b"\xc3\xa9" + p), joined(b"\xc3\xa9", p))
            for p in (bytes([c]) for c in self.PUNCTUATION)
        )

        self.joins = self._joins(path)

    def _encode(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, dtype="<u4")

    def _joins(self, path: str | None) -> Ranks | None:
        """The vocabulary's joins, if words of letters are what the tokenizer makes of them."""
        try:
            joins = Ranks(_file(path))
        except (KeyError, TypeError, ValueError):
            return None  # no byte-level vocabulary
        vocabulary = (t.removesuffix("</w>") for t in list(self.tokenizer.get_vocab())[::97])
        samples = {w for t in vocabulary if _LETTERS.fullmatch(w := t.encode())} | {"stra\u00dfe".encode(), "\u00e9t\u00e9\u00ff".encode()}
        made = joins.merged(list(samples))
        return joins if all(made[w] == self._encode(w).tobytes() for w in samples) else None

    def learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each of `words`."""
        found: dict[bytes, bytes] = {}
        stems = {w: w[:-1] for w in words if self._is_parted(w)}
        if stems:
            ends = {bytes([c]) for c in self.PUNCTUATION}
            whole = words.difference(stems).union(ends.difference(self.ids), set(stems.values()).difference(self.ids))
            found = self.learn(whole)
            known = lambda w: found[w] if w in found else self.ids[w]
            found.update([(w, known(stem) + known(w[-1:])) for w, stem in stems.items()])
            return found
        if self.joins is not None:
            letters = [w for w in words if len(w) <= LONG_BYTES and _LETTERS.fullmatch(w)]
            found.update(self.joins.merged(letters))
            words = words.difference(letters)
        plain = [w for w in words if self.MARK not in w]
        for at in range(0, len(plain), 2000):
            part = plain[at : at + 2000]
            ids = self._encode((b" " + self.MARK + b" ").join(part))
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part) - 1:  # a word has the mark in another form
                found.update((w, self._encode(w).tobytes()) for w in part)
                continue
            begin = np.concatenate([[0], cut + 1]) * 4
            end = np.concatenate([cut, [len(ids)]]) * 4
            data = ids.tobytes()
            found.update(zip(part, map(data.__getitem__, map(slice, begin.tolist(), end.tolist()))))
        found.update((w, self._encode(w).tobytes()) for w in words if self.MARK in w)
        return found

    def _is_parted(self, word: bytes) -> bool:
        """One mark after a letter: ASCII, or one of U+00C0 to U+00FF."""
        if not self.parted or len(word) < 2 or word[-1] not in self.PUNCTUATION:
            return False
        last = word[-2]
        return 97 <= last <= 122 or 65 <= last <= 90 or (len(word) > 2 and word[-3] == 0xC3 and last not in (0x97, 0xB7))

    def _lowered(self, text: str) -> str:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        # ASCII white space only: other white space stays inside a word, and the tokenizer drops it
        split = [(self._lowered(t) if self.small else t).encode().split() for t in texts]
        words = set().union(*split)
        # the table is complete for this batch, and trimmed after it
        if new := words.difference(self.ids):
            self.ids.update(self.learn(new))
        find = self.ids.__getitem__
        made = [np.frombuffer(b"".join(map(find, ws)), dtype="<u4") for ws in split]
        if len(self.ids) > self.kept:
            for word in list(islice(self.ids, len(self.ids) - self.kept // 2)):
                del self.ids[word]
        return made


@cache
def _words(path: str | None) -> WordTokens:
    """The word table of a Python worker, which its tasks share."""
    return WordTokens(path)


def pieces(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    capacity: int = SEQUENCE_TOKENS,
    end_id: int = 0,
    tokenizer: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every row, null texts as empty ones.

    A document's ids end with `end_id`; only documents longer than `capacity` are cut.  `tokenizer`
    is a file every executor has; without one, the installed word_bpe_49k.json.
    """

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _words(tokenizer)
        last = np.array([end_id], dtype="<u4")
        for frame in frames:
            texts = [t if isinstance(t, str) else "" for t in frame["text"]]
            for at in range(0, len(texts), 64):
                rows = []
                for k, ids in zip(frame["id"].iloc[at : at + 64], encode(texts[at : at + 64])):
                    ids = np.concatenate([ids, last])
                    for n, begin in enumerate(range(0, len(ids), capacity)):
                        part = ids[begin : begin + capacity]
                        row = (k, n, begin, len(part), zlib.crc32(part.tobytes()))
                        rows.append((*row, part.astype(np.int32)) if with_ids else row)
                names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
                out = pd.DataFrame(rows, columns=names)
                out["id"] = out["id"].astype(frame["id"].dtype)
                yield out

    source = docs.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    schema = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return source.mapInPandas(handing_back(_whole_ids(cut)), schema).withColumnRenamed("id", key)


def _whole_ids(fn):
    """Frames with nullable integer ids, as a missing id turns a column into floats."""

    def run(frames):
        for_fn = (f.assign(id=f["id"].astype("Int64")) for f in frames)
        yield from fn(for_fn)

    return run


class OpenBins:
    """The open bins of bounded-space best-fit."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits = 0  # bit f: a bin with f free is open
        self.by_free: dict[int, list[int]] = {}
        self.open = 0
        self.made = 0

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.open -= 1
        return bin_

    def _put(self, bin_: int, free: int) -> None:
        if not free:
            return  # full: closed
        if self.open == self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)
        self.by_free.setdefault(free, []).append(bin_)
        self.bits |= 1 << free
        self.open += 1

    def add(self, length: int) -> tuple[int, int]:
        """(bin, place in it) for a piece."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        self._put(bin_, free - length)
        return bin_, self.capacity - free


def pack(
    items: DataFrame,
    length: str = "length",
    order: tuple[str, ...] = ("doc_id", "piece"),
    *,
    capacity: int = SEQUENCE_TOKENS,
    open_bins: int = OPEN_BINS,
    block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """`items` with `sequence_id` and `offset`; every sequence holds at most `capacity`.

    Lengths are 1 to `capacity`; an item of another length is an error.  A block arrives in the
    order of a hash of `order`, so a run of it after a lost executor gives the same bins.  Items
    that are equal in every column of `order` may swap places.  An empty table gives an empty one.
    """
    n = items.count()
    blocks = max(1, round(n / block_pieces))
    mixed = F.xxhash64(*order, length)
    names = items.columns
    dealt = items.withColumn("_order", mixed).withColumn("_block", F.pmod(F.xxhash64("_order"), F.lit(blocks)))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_order", *order], kind="stable")
        lengths = frame[length].to_numpy()
        if len(lengths) and not (1 <= lengths.min() and lengths.max() <= capacity):
            raise ValueError(f"lengths must be 1 to {capacity}")
        bins = OpenBins(capacity, open_bins)
        placed = np.array([bins.add(x) for x in lengths.tolist()], dtype=np.int64).reshape(-1, 2)
        out = frame[names].copy()
        out["sequence_id"] = (np.int64(frame["_block"].iloc[0]) << 32) + placed[:, 0]
        out["offset"] = placed[:, 1]
        return out

    return dealt.groupBy("_block").applyInPandas(place, fields + ", sequence_id long, offset long")


def packed_documents(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    capacity: int = SEQUENCE_TOKENS,
    tokenizer: str | None = None,
    with_ids: bool = True,
) -> DataFrame:
    """Pieces of all documents with their places: (key, piece, start, length, ids_crc32[, ids],
    sequence_id, offset).

    Handles null keys and texts (an empty document is its end id), repeated rows (each is packed)
    and empty tables.  Other columns are left out.
    """
    cut = materialize(pieces(docs, key, text, capacity=capacity, tokenizer=tokenizer, with_ids=with_ids))
    return pack(cut, order=(key, "piece", "ids_crc32"), capacity=capacity)
