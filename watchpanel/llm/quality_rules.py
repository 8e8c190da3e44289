"""Quality rules: divergence of a document from its language's reference histograms.

Two histograms of a text are compared with those of its language by the Jensen-Shannon distance (the
square root of the divergence in bits, 0 to 1): classes of characters, and common function words
with all other words as one bin.  A language's reference is the mean of the histograms of all
its documents that pass the base rules, so that a long document counts no more than a short one; it
is taken a second time over the documents near the first mean, so that junk does not shift it.

Guards: the character distance needs `min_chars` characters and the word distance `min_words`
words; shorter texts are not judged by it.  A language with fewer than `min_reference` documents,
or a null one, is compared with every reference that has enough, and the nearest counts.  Without
any reference nothing is rejected by distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchpanel.llm.rowmatch import matching
from watchpanel.llm.wordspans import Words, covered, slices, utf8
from watchpanel.llm.workers import handing_back
from watchpanel.sources.storage import materialize

# Frequent function words of four languages, lower case.
COMMON_WORDS = (
    "the of and to in a is that for it was on with as be at by this from are or an not "
    "de la le et les des en un une du que qui dans pour sur avec pas au il est "
    "el los las y del se por con una su para no al lo como "
    "der die und das den von zu mit ist im für auf nicht ein eine sich dem auch es"
).split()
SYMBOLS = b"#*$%&|<>"

CLASSES = (
    "lower", "upper", "accented", "other letter", "digit", "space", "full stop", "comma",
    "exclamation", "other punctuation", "symbol", "other",
)


def _classes() -> np.ndarray:
    """Class of each code point up to 0x24F; the last entry is for all above."""
    out = np.full(0x251, CLASSES.index("other"), dtype=np.uint8)
    for code in range(0x250):
        c = chr(code)
        if c.isalpha():
            name = ("upper" if c.isupper() else "lower") if code < 128 else "accented"
        elif c.isdigit():
            name = "digit"
        elif c.isspace():
            name = "space"
        elif c in ".,!":
            name = {".": "full stop", ",": "comma", "!": "exclamation"}[c]
        elif c in "\"'()-:;?/":
            name = "other punctuation"
        else:
            name = "symbol"
        out[code] = CLASSES.index(name)
    out[0x250] = CLASSES.index("other letter")
    return out


_CLASS = _classes()
_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    repeat_percent: int = 50
    repeat_width: int = 3
    #: characters and words below which a distance is not judged
    min_chars: int = 200
    distance_words: int = 100
    min_reference: int = 20
    #: the second reference is made of documents within this distance of the first
    trim_distance: float = 0.12
    max_char_distance: float = 0.14
    #: added to the limit, divided by the square root of the characters
    char_noise: float = 1.0
    max_word_distance: float = 0.6


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    unique = list(dict.fromkeys(COMMON_WORDS))
    _, hashes = Words([w.encode() for w in unique]).windows(1)
    order = np.argsort(hashes)
    return hashes[order], order


_COMMON, _PLACE = _common_hashes()
WORD_BINS = len(_COMMON) + 1


def measures(texts: list[bytes | None], rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """Base measures and the two histograms (counts) of each text."""
    n = len(texts)
    words = Words(texts)
    sizes = np.bincount(words.doc, words.end - words.start, n).astype(np.int64)
    # bytes that continue a character are not characters
    inner = np.concatenate([[0], np.cumsum((words.raw & 0xC0) == 0x80)])
    inside = np.bincount(words.doc, inner[words.end] - inner[words.start], n).astype(np.int64)
    at, hashes = words.windows(rules.repeat_width)
    # equal windows of one text are neighbours after the sort
    order = np.lexsort((hashes, words.doc[at]))
    h, d = hashes[order], words.doc[at][order]
    same = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(h), bool)
    again[1:] |= same
    again[:-1] |= same
    repeated = covered(at[order[again]], rules.repeat_width, len(words))
    symbols, lines = np.zeros(n, np.int64), np.zeros(n, np.int64)
    chars = np.zeros((n, len(CLASSES)), np.int64)
    for i, text in enumerate(words.texts):
        symbols[i] = len(text) - len(text.translate(None, SYMBOLS))
        with_word = [x for x in text.split(b"\n") if x.strip(b"\x20\x09\x0a\x0b\x0c\x0d")]
        lines[i] = len(with_word) - len(set(with_word))
        codes = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)
        chars[i] = np.bincount(_CLASS[np.minimum(codes, 0x250)], minlength=len(CLASSES))
    plain = Words([t.translate(_LOWER) for t in words.texts])
    _, word_hash = plain.windows(1)
    place = np.minimum(np.searchsorted(_COMMON, word_hash), len(_COMMON) - 1)
    bins = np.where(_COMMON[place] == word_hash, _PLACE[place], len(_COMMON))
    common = np.bincount(plain.doc * WORD_BINS + bins, minlength=n * WORD_BINS).reshape(n, WORD_BINS)
    return {
        "n_words": words.counts,
        "word_chars": sizes - inside,
        "n_symbols": symbols,
        "n_dup_lines": lines,
        "n_repeat_words": np.bincount(words.doc, repeated, n).astype(np.int64),
        "chars": chars,
        "common": common.astype(np.int64),
    }


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance along the last axis, 0 to 1."""
    m = (p + q) / 2

    def part(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.maximum((part(p) + part(q)) / 2, 0))


def _base_failed(m: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    return (m["n_words"] < rules.min_words) | (
        100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"]
    )


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(key, lang, base measures, base_failed, chars, common) of every row."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = utf8(frame["text"])
            for cut in slices(texts):
                m = measures(texts[cut], rules)
                out = frame.iloc[cut][["id", "lang"]].assign(id=frame["id"].iloc[cut].astype("Int64"))
                out = out.assign(**{name: m[name] for name in BASE}, base_failed=_base_failed(m, rules))
                yield out.assign(chars=list(m["chars"]), common=list(m["common"]))

    source = docs.select(
        F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")
    )
    schema = "id long, lang string, " + "".join(f"{n} long, " for n in BASE)
    return source.mapInPandas(handing_back(run), schema + "base_failed boolean, chars array<bigint>, common array<bigint>")


def references(rows: DataFrame) -> DataFrame:
    """(lang, n, chars, common): mean histograms of the rows of each language that pass the base rules.

    Sums are kept on both sides of the shuffle: it moves a row for each language and task.
    """
    good = rows.where("not base_failed and lang is not null")
    sums = [F.count("*").alias("n")]
    for name, bins in (("chars", len(CLASSES)), ("common", WORD_BINS)):
        total = F.aggregate(name, F.lit(0).cast("bigint"), lambda a, x: a + x)
        good = good.withColumn(f"{name}_total", F.greatest(total, F.lit(1)))
        sums.append(
            F.array(*[F.avg(F.get(name, F.lit(i)) / F.col(f"{name}_total")) for i in range(bins)]).alias(name)
        )
    return good.groupBy("lang").agg(*sums)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rules: Rules = Rules()) -> DataFrame:
    """(key, base measures, base_failed, kept, char_distance, word_distance) of every row.

    A null or empty text has no words and fails the base rules.  Repeated rows each give a row; null
    keys stay null.  A distance that a guard leaves out is null.  References are one row for each
    language that has `min_reference` documents, so a driver holds at most one in twenty-odd of
    the rows' languages, and only a few numbers of each.
    """
    rows = materialize(measured(docs, key, text, lang, rules))
    first = _known(rows, rules)
    near = _compared(rows, first, rules).where(
        F.col("char_distance").isNull() | (F.col("char_distance") <= rules.trim_distance)
    )
    second = _known(near, rules)
    seen = {r["lang"] for r in second}
    found = _compared(rows, second + [r for r in first if r["lang"] not in seen], rules)
    size = F.aggregate("chars", F.lit(0).cast("bigint"), lambda a, x: a + x)
    most = rules.max_char_distance + rules.char_noise / F.sqrt(F.greatest(size, F.lit(1)))
    far = F.coalesce(F.col("char_distance") > most, F.lit(False)) | F.coalesce(
        F.col("word_distance") > rules.max_word_distance, F.lit(False)
    )
    return found.select(
        F.col("id").alias(key), *BASE, "base_failed", "char_distance", "word_distance",
        (~F.col("base_failed") & ~far).alias("kept"),
    )


def _known(rows: DataFrame, rules: Rules) -> list:
    """References with enough documents: one small row for each language."""
    return references(rows).where(F.col("n") >= rules.min_reference).collect()


def _compared(rows: DataFrame, known: list, rules: Rules) -> DataFrame:
    """`rows` with char_distance and word_distance."""
    names = [r["lang"] for r in known]
    ref = {f: np.array([r[f] for r in known], dtype=float) for f in ("chars", "common")}
    index = {name: i for i, name in enumerate(names)}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            own = frame["lang"].map(index).fillna(-1).astype(int).to_numpy()
            out = frame.assign(id=frame["id"].astype("Int64"))
            for field, name, guard in (
                ("chars", "char_distance", rules.min_chars),
                ("common", "word_distance", rules.distance_words),
            ):
                if not len(names) or not len(frame):
                    out[name] = pd.array([None] * len(frame), dtype="Float64")
                    continue
                counts = np.array(frame[field].tolist())
                each = np.stack([js_distance(_shares(counts), r) for r in ref[field]], axis=1)
                found = np.where(own >= 0, each[np.arange(len(frame)), own], each.min(axis=1))
                out[name] = pd.array(found, dtype="Float64")
                out.loc[counts.sum(axis=1) < guard, name] = pd.NA
            yield out

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(handing_back(run), fields + ", char_distance double, word_distance double")


def good_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Rows of `docs` that are kept, all columns.  Rows are matched by a hash of key, text and
    language, so null and repeated keys are judged by their own text."""
    row = F.xxhash64(F.col(key).cast("bigint"), F.col(text), F.col(lang))
    found = judged(docs.select(row.alias("_row"), F.col(text).alias("_t"), F.col(lang).alias("_l")), "_row", "_t", "_l")
    return matching(docs, row, found.where("kept"), "_row", "left_semi")
