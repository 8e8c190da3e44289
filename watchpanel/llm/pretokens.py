"""Pre-token boundaries of byte-level BPE, from codepoint classes and a scan of transition functions.

The boundaries are those of the published pattern (contractions, an optional space with letters, numbers
or other characters, white space), found without a regular expression.  Each codepoint becomes a symbol:
its class, and what of the next codepoints decides (whether white space is the last of its run, whether
an apostrophe begins a contraction).  A symbol is a function on the states of a small automaton.  These
functions are closed under composition, which is associative, so that the states of all positions come
from prefix compositions: inside columns of a block first, across the columns' totals next.  A separator
is a constant function, so many texts are scanned at once.
"""

from __future__ import annotations

import unicodedata

import numpy as np

LETTER, NUMBER, OTHER, SPACE = range(4)

# What Unicode 16 added to Unicode 15.1, which Python's tables may lack.
LETTERS_16 = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0),
)
NUMBERS_16 = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA),
)
WHITE_SPACE = (
    *range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


def _class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, dtype=np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            table[cp] = LETTER
        elif kind == "N":
            table[cp] = NUMBER
    for ranges, kind in ((LETTERS_16, LETTER), (NUMBERS_16, NUMBER)):
        for first, last in ranges:
            table[first : last + 1] = kind
    table[list(WHITE_SPACE)] = SPACE
    return table


_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """Class of every codepoint; built once in a Python worker."""
    global _classes
    if _classes is None:
        _classes = _class_table()
    return _classes


# Symbols: the classes, then what needs a look ahead.
SHORT, LONG = 4, 5  # apostrophe with one or two letters of a contraction
BLANK, GAP, INNER = 3, 6, 7  # white space: U+0020 before a word, another character before a word, any other
RESET = 8
N_SYMBOLS = 9

# States: nothing open, in letters, numbers or others, a space that the next word takes, in white space,
# one or two letters of a contraction to come.
CLEAR, IN_L, IN_N, IN_O, TAKEN, IN_S, ONE, TWO = range(8)
N_STATES = 8


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """(next state, does a token start here)."""
    joins = state == TAKEN
    if symbol == LETTER:
        if state == TWO:
            return ONE, False
        if state == ONE:
            return CLEAR, False
        return IN_L, not (joins or state == IN_L)
    if symbol == NUMBER:
        return IN_N, not (joins or state == IN_N)
    if symbol == OTHER:
        return IN_O, not (joins or state == IN_O)
    if symbol in (SHORT, LONG):
        if joins or state == IN_O:
            return IN_O, False
        return (ONE if symbol == SHORT else TWO), True
    if symbol == BLANK:
        return TAKEN, True
    if symbol == GAP:
        return CLEAR, True
    if symbol == INNER:
        return IN_S, state != IN_S
    return CLEAR, True


def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All compositions of the symbols' functions: (function of each symbol, composition table, images)."""
    of_symbol = [tuple(_step(s, x)[0] for s in range(N_STATES)) for x in range(N_SYMBOLS)]
    known = {f: i for i, f in enumerate(dict.fromkeys([tuple(range(N_STATES)), *of_symbol]))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in of_symbol:
            both = tuple(g[x] for x in f)
            if both not in known:
                known[both] = len(known)
                todo.append(both)
    images = np.array(list(known), dtype=np.uint8)
    table = np.array([[known[tuple(g[x] for x in f)] for g in known] for f in known], dtype=np.uint8)
    return np.array([known[f] for f in of_symbol], dtype=np.uint8), table, images


_FUNCTION, _COMPOSED, _IMAGE = _monoid()
_STARTS = np.array([[_step(s, x)[1] for x in range(N_SYMBOLS)] for s in range(N_STATES)])
_COLUMN = 256


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """State in front of each symbol."""
    n = len(symbols)
    columns = -(-n // _COLUMN)
    padded = np.full(columns * _COLUMN, RESET, dtype=np.uint8)
    padded[:n] = symbols
    # row j holds the j-th symbol of every column, so that a step works on all columns
    prefix = np.ascontiguousarray(_FUNCTION[padded].reshape(columns, _COLUMN).T)
    for j in range(1, _COLUMN):
        prefix[j] = _COMPOSED[prefix[j - 1], prefix[j]]
    total = prefix[-1].copy()
    reach = 1
    while reach < columns:
        total[reach:] = _COMPOSED[total[:-reach], total[reach:]]
        reach *= 2
    enter = np.zeros(columns, dtype=np.uint8)
    enter[1:] = _IMAGE[total[:-1], CLEAR]
    after = np.ascontiguousarray(_IMAGE[prefix, enter].T).reshape(-1)[:n]
    before = np.empty(n, dtype=np.uint8)
    before[:1] = CLEAR
    before[1:] = after[:-1]
    return before


def codepoints(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype="<u4")


def utf8_sizes(cps: np.ndarray) -> np.ndarray:
    """Bytes of each codepoint in UTF-8."""
    return 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)


def starts(cps: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Indexes at which a token starts; the codepoints at `breaks` part texts and are tokens of their own."""
    kind = classes()[cps]
    symbols = kind.copy()
    symbols[breaks] = RESET
    white = np.flatnonzero(symbols == SPACE)
    follow = np.full(len(cps) + 1, RESET, dtype=np.uint8)
    follow[: len(cps)] = symbols
    last = ~np.isin(follow[white + 1], (SPACE, RESET))
    symbols[white] = np.where(last, np.where(cps[white] == 0x20, BLANK, GAP), INNER)
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        ahead = np.zeros(len(cps) + 2, dtype=np.uint32)
        ahead[: len(cps)] = cps
        ahead[breaks] = 0
        for ending in CONTRACTIONS:
            hit = np.logical_and.reduce([ahead[quote + 1 + i] == ord(c) for i, c in enumerate(ending)])
            symbols[quote[hit]] = SHORT if len(ending) == 1 else LONG
        symbols[breaks] = RESET
    return np.flatnonzero(_STARTS[_states_before(symbols), symbols])


def cut(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(UTF-8 of all texts, first byte and end of each token, index of each text's first token and the end)."""
    joined = "\n".join(texts)
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    breaks = (np.cumsum(sizes + 1) - 1)[:-1]
    cps = codepoints(joined)
    at = starts(cps, breaks)
    byte = np.concatenate([[0], np.cumsum(utf8_sizes(cps))])
    ends = np.append(at[1:], len(cps))
    text_of = np.searchsorted(breaks, at)
    real = ~np.isin(at, breaks, assume_unique=True)
    at, ends, text_of = at[real], ends[real], text_of[real]
    return joined.encode(), byte[at], byte[ends], np.searchsorted(text_of, np.arange(len(texts) + 1))
