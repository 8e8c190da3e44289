"""Words of many texts at once, as numpy arrays, with hashes of any run of words.

A word is a run of bytes other than 0x20 and 0x09-0x0D of the UTF-8 text, which is the same as a
run of characters matching ``[^\\x20\\x09-\\x0D]``.  A window of consecutive words has a 64-bit hash
that depends on its words only, not on the white space between them; hashes of all windows of one
width cost a few vector operations, whatever the width.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[list(SPACES)] = True

# an odd number whose powers repeat late, and its inverse modulo 2**64
BASE = 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)
_KEPT_POWERS = 1 << 21


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers, so that all bits of a window hash are usable."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


# a random 64-bit number for each byte value; the second half is for the first byte of a word
_BYTE = _mixed(_mixed(np.arange(1, 513, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, np.uint64(base))
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= _KEPT_POWERS:
            _powers[base] = have
    return have[:n]


class Words:
    """Words of a list of texts (bytes; None counts as empty).

    ``start``/``end``: byte range of each word in ``raw``; ``doc``: index of its text;
    ``counts``: number of words of each text; ``doc_start``: byte at which each text starts.
    """

    def __init__(self, texts: list[bytes | None]):
        self.texts = [t or b"" for t in texts]
        sizes = np.fromiter(map(len, self.texts), dtype=np.int64, count=len(self.texts))
        self.sizes = sizes
        self.doc_start = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1] if len(sizes) else sizes
        self.raw = np.frombuffer(b" ".join(self.texts), dtype=np.uint8)
        self.black = ~IS_SPACE[self.raw]
        edge = np.diff(self.black.view(np.int8), prepend=0, append=0)
        self.start = np.flatnonzero(edge == 1)
        self.end = np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(self.doc_start, self.start, side="right") - 1
        self.counts = np.bincount(self.doc, minlength=len(self.texts)).astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])[:-1].astype(np.int64)
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    def _prefix(self) -> tuple[np.ndarray, np.ndarray]:
        if self._sums is None:
            lengths = self.end - self.start
            self._cut = np.concatenate([[0], np.cumsum(lengths)])
            value = self.raw[self.black].astype(np.int64)
            value[self._cut[:-1]] += 256
            terms = _BYTE[value] * _power_table(BASE, len(value))
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])
        return self._sums, self._cut

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word, and hash, of each window of `width` words inside one text."""
        n = len(self.start)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums, cut = self._prefix()
        at = np.flatnonzero(self.doc[: n - width + 1] == self.doc[width - 1 :])
        back = _power_table(INVERSE, len(sums))[cut[at]]
        return at, _mixed((sums[cut[at + width]] - sums[cut[at]]) * back)

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]].tobytes()


def covered(at: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n words lie in one of the windows that start at `at`."""
    step = np.zeros(n + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + width, -1)
    return np.cumsum(step[:-1]) > 0


def utf8(texts: pd.Series) -> list[bytes | None]:
    return [t.encode() if isinstance(t, str) else None for t in texts]


def slices(texts: list[bytes | None], limit: int = 1 << 20) -> Iterator[slice]:
    """Cut a list of texts into runs of about `limit` bytes; a longer text stands alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        more = len(text or b"") + 1
        if i > begin and size + more > limit:
            yield slice(begin, i)
            begin, size = i, 0
        size += more
    if begin < len(texts):
        yield slice(begin, len(texts))
