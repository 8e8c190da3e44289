"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits.  A seed is a fixed mask over a run
of words that ignores some positions; its hash is taken at each place of each document and of each
benchmark item.  Equal hashes are hits; a hit fixes an alignment of item and document, along which
words are compared.  An item is found if some `window` consecutive aligned words agree in
`similarity` of the places or more (substitutions are tolerated), or `exact` consecutive ones agree
in all.  Fewer words than `window` are aligned where the item is shorter (all of it counts) or the
document begins or ends inside it (`exact` words or more count).

No such window is lost: each pattern of substitutions in 11 to 20 words leaves a place for one of the
masks.  Items of fewer words have masks of their own length, made for the lengths that occur.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel.llm.rowmatch import matching

#: 1: the word counts, 0: it is ignored.  Found by search over all patterns in windows of 11 to 20 words.
MASKS = ("1111011", "110010111", "110101011", "111010011", "111111")
#: words of the shortest item that these masks serve
MASKED_WORDS = 11


@dataclass(frozen=True)
class Match:
    masks: tuple[str, ...] = MASKS
    window: int = 20
    exact: int = 13
    similarity: float = 0.8
    #: benchmark seeds up to which they are broadcast (about 40 bytes each); more are shuffled
    broadcast_seeds: int = 500_000


def word_hashes(text: str) -> Column:
    """Hash of each word of a text; none for a null or wordless text."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(plain, " "), lambda w: F.xxhash64(w))
    )


def row_hash(*columns: Column) -> Column:
    """Hash of a row; a null counts as a value of its own."""
    return F.xxhash64(*columns, *[c.isNull() for c in columns])


def short_masks(n: int, similarity: float) -> list[str]:
    """Masks over an item of `n` words that leave a place for each tolerated pattern of substitutions."""
    wrong = max(k for k in range(n + 1) if n - k >= similarity * n)
    if not wrong:
        return ["1" * n]
    parts = min(n, wrong + 2)
    part = [i * parts // n for i in range(n)]
    return ["".join("0" if x in out else "1" for x in part) for out in combinations(range(parts), wrong)]


def seeds(rows: DataFrame, keep: list[str], words: str, masks: list[tuple[int, str]]) -> DataFrame:
    """(keep, place, seed): every seed of each row for masks with their numbers."""
    runs = F.greatest(F.size(words) - (min(len(m.rstrip("0")) for _, m in masks) - 1), F.lit(0))
    shifted = [F.slice(words, i + 1, runs).alias(f"w{i}") for i in range(max(len(m) for _, m in masks))]
    placed = rows.select(*keep, F.posexplode(F.arrays_zip(*shifted))).select(*keep, F.col("pos").alias("place"), "col.*")
    each = [
        # a mask that reaches over the end has no seed
        F.when(F.col(f"w{mask.rindex('1')}").isNotNull(), F.xxhash64(F.lit(n), *[f"w{i}" for i, c in enumerate(mask) if c == "1"]))
        for n, mask in masks
    ]
    return placed.select(*keep, "place", F.explode(F.array(*each)).alias("seed")).where(F.col("seed").isNotNull())


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    match: Match = Match(),
) -> DataFrame:
    """(key, item, start, n_words, n_equal): each document and each item found in it.

    `start` is the word of the document where the item's best window begins, `n_words` the window's
    length and `n_equal` the equal words in it; of alignments the best counts, then the first.
    Null and wordless texts match nothing.  Repeated rows and null keys of either table each give
    their rows.  Other columns are left out.
    """
    items = (
        benchmark.select(
            F.col(item).alias("_item"), row_hash(F.col(item), F.col(item_text)).alias("_of"), word_hashes(item_text).alias("_words")
        )
        .where(F.size("_words") > 0)
        .dropDuplicates(["_of"])
    )
    lengths = sorted(r.n for r in items.select(F.size("_words").alias("n")).where(F.col("n") < MASKED_WORDS).distinct().collect())
    masks = list(enumerate(match.masks))
    known = seeds(items.where(F.size("_words") >= MASKED_WORDS), ["_of"], "_words", masks)
    for n in lengths:
        own = [(1000 * n + i, m) for i, m in enumerate(short_masks(n, match.similarity))]
        short = seeds(items.where(F.size("_words") == n), ["_of"], "_words", own)
        known = known.unionByName(short.where("place = 0"))
        masks += own
    known = known.select("_of", F.col("place").alias("_at"), F.col("seed")).distinct()
    small = known.limit(match.broadcast_seeds + 1).count() <= match.broadcast_seeds
    if small:
        known = F.broadcast(known)
    row = row_hash(F.col(key), F.col(text))
    hashed = docs.select(row.alias("_row"), word_hashes(text).alias("_h"))
    hits = (
        seeds(hashed, ["_row"], "_h", masks)
        .join(known, "seed")
        .select("_row", "_of", (F.col("place") - F.col("_at")).alias("_shift"))
        .distinct()
    )
    # a document's alignments: at most as many as its words have seeds in items
    aligned = hits.groupBy("_row").agg(F.collect_list(F.struct("_of", "_shift")).alias("_hits"))
    found = (
        docs.select(F.col(key).alias("_id"), row.alias("_row"), F.col(text).alias("_text"))
        .join(aligned, "_row")
        .select("_id", "_row", word_hashes("_text").alias("_h"), F.explode("_hits").alias("_hit"))
        .select(
            "_id", "_row", F.col("_hit._of").alias("_of"), F.col("_hit._shift").alias("_shift"),
            F.slice("_h", F.greatest(F.col("_hit._shift"), F.lit(0)) + 1, F.lit(1 << 20)).alias("_h"),
        )
        .join(F.broadcast(items) if small else items, "_of")
    )
    # `_h` begins at the aligned word, or at the document's first word inside the item
    skipped = F.greatest(-F.col("_shift"), F.lit(0))
    common = F.least(F.size("_h"), F.size("_words") - skipped)
    same = F.zip_with(
        F.slice("_h", F.lit(1), common), F.slice("_words", skipped + 1, common), lambda a, b: (a == b).cast("int")
    )
    least = F.least(F.lit(match.exact), F.size("_words"))
    judged = F.least(F.lit(match.window), F.size("_words"), common)
    compared = found.where(common >= least).select("_id", "_row", "_item", "_shift", same.alias("_same"), judged.alias("_n"))

    def best_of(n: Column) -> Column:
        return F.array_max(F.transform(
            F.sequence(F.lit(1), F.size("_same") - n + 1),
            lambda i: F.struct(F.aggregate(F.slice("_same", i, n), F.lit(0), lambda a, x: a + x).alias("equal"), (-i).alias("at")),
        ))

    # the best window, or else the first run of `exact` equal words
    run = F.lit(match.exact)
    tried = compared.withColumn("_best", best_of(F.col("_n"))).withColumn(
        "_good", F.col("_best.equal") >= F.lit(match.similarity) * F.col("_n")
    )
    tried = tried.withColumn("_best", F.when(~F.col("_good") & (F.size("_same") >= run), best_of(run)).otherwise(F.col("_best")))
    tried = tried.withColumn("_n", F.when(~F.col("_good") & (F.size("_same") >= run), run).otherwise(F.col("_n")))
    best = tried.where(F.col("_good") | ((F.col("_n") == run) & (F.col("_best.equal") == run)))
    start = F.greatest("_shift", F.lit(0)) - F.col("_best.at") - 1
    chosen = F.struct(F.col("_best.equal").alias("equal"), (-start).alias("at"), "_n")
    kept = best.groupBy("_row", "_item").agg(F.max(chosen).alias("b"))
    ids = docs.select(F.col(key).alias("_id"), row.alias("_row"))
    return kept.join(ids, "_row").select(
        F.col("_id").alias(key), F.col("_item").alias(item), (-F.col("b.at")).cast("bigint").alias("start"),
        F.col("b._n").cast("bigint").alias("n_words"), F.col("b.equal").cast("bigint").alias("n_equal"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", match: Match = Match()) -> DataFrame:
    """Rows of `docs` in which no item is found, all columns."""
    row = row_hash(F.col(key), F.col(text))
    found = leaks(docs.select(row.alias("_leak"), F.col(text).alias("_t")), benchmark.select(
        F.col("item_id"), F.col("text").alias("_t")), "_leak", "_t", "item_id", "_t", match)
    return matching(docs, row, found, "_leak", "left_anti")
