"""Binary Golay code (23, 12, 7): every 23-bit word is within 3 bits of exactly one codeword.

`ball_indices` gives, for each word, the codeword indices of itself and of all its one-bit
neighbours: one index if the word is within 2 bits of its codeword, six otherwise.  Two words that
differ in at most 2 bits have a word between them that is a neighbour (or equal) of both, so their
index lists share an entry.
"""

from __future__ import annotations

from functools import cache

import numpy as np

LENGTH, CHECKS = 23, 11
# x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101


def _syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of the words, read as polynomials, modulo the generator."""
    rest = words.astype(np.uint32)
    for degree in range(LENGTH - 1, CHECKS - 1, -1):
        lead = (rest >> np.uint32(degree)) & np.uint32(1)
        rest ^= lead * np.uint32(GENERATOR << (degree - CHECKS))
    return rest


@cache
def _errors() -> np.ndarray:
    """The error pattern of at most 3 bits for each of the 2048 remainders."""
    one = [1 << i for i in range(LENGTH)]
    patterns = [0, *one]
    patterns += [a | b for i, a in enumerate(one) for b in one[:i]]
    patterns += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    words = np.array(patterns, dtype=np.uint32)
    table = np.zeros(1 << CHECKS, dtype=np.uint32)
    table[_syndrome(words)] = words
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    words = words.astype(np.uint32)
    return (words ^ _errors()[_syndrome(words)]) >> np.uint32(CHECKS)


def ball_indices(words: np.ndarray, bits: int = LENGTH) -> np.ndarray:
    """A row for each word: indices of the word and of its neighbours in the lowest `bits` bits."""
    words = words.astype(np.uint32)
    flips = np.array([0, *(1 << i for i in range(bits))], dtype=np.uint32)
    return decode((words[:, None] ^ flips[None, :]).ravel()).reshape(len(words), len(flips))
