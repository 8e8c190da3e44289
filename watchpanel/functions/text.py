"""Text expressions: cleaning, key sentences, document lines, prefilter, prompts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import as_column, strip
from watchpanel.params import PrefilterParams, TextParams


def any_of(phrases: Sequence[str]) -> str:
    """Regular expression matching any phrase literally, earlier ones first."""
    return "|".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in phrases if p.strip())


def clean_text(c: Column | str) -> Column:
    """Null and 'nan' become empty; runs of blanks and of line breaks shrink to one."""
    text = strip(F.coalesce(as_column(c).cast("string"), F.lit("")))
    text = F.when(F.lower(F.substring(text, 1, 4)) == "nan", F.lit("")).otherwise(text)
    # plain replacement for the rare kinds of blanks; the regular expressions run only on
    # texts that have runs to shrink
    for blank in "\t\r\f\x0b":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    text = F.when(text.contains("  "), F.regexp_replace(text, " {2,}", " ")).otherwise(text)
    text = F.when(text.contains("\n\n"), F.regexp_replace(text, "\n{2,}", "\n")).otherwise(text)
    return strip(text)


def contains_any(c: Column, phrases: Sequence[str]) -> Column:
    """Whether a text contains one of the phrases, by plain search."""
    found = F.lit(False)
    for phrase in phrases:
        if phrase:
            found = found | c.contains(phrase)
    return found


def first_chars(c: Column | str, n: int | None) -> Column:
    """The first n characters; everything when n is None."""
    return as_column(c) if n is None else F.substring(as_column(c), 1, n)


def with_key_sentences(
    df: DataFrame, text: str, out: str, params: TextParams = TextParams()
) -> DataFrame:
    """Add the key sentences of a text column.

    Short texts are kept whole.  Longer ones give the first few different sentences that
    contain a keyword; without any, their head and tail.  Without a length limit every text is
    kept whole.  Done in steps so that the cleaned text and the sentence list are evaluated once
    per row.
    """
    n = params.key_max_chars
    if n is None:
        return df.withColumn(out, clean_text(text))
    half = n // 2
    c, sentences, picked = F.col("_clean"), F.col("_sentences"), F.col("_picked")
    tail = strip(F.right(c, F.lit(half)))
    head = strip(F.substring(c, 1, half))
    around = F.when(tail != "", F.concat(head, F.lit(fv.ELLIPSIS), tail)).otherwise(head)
    longer = F.length(c) > n
    split_up = F.filter(
        F.transform(F.split(c, params.sentence_breaks), lambda s: strip(s)), lambda s: s != ""
    )
    relevant = F.filter(
        sentences,
        lambda s: (F.length(s) >= params.min_sentence_chars) & contains_any(s, params.keywords),
    )
    different = F.array_distinct(relevant)
    return (
        df.withColumn("_clean", clean_text(text))
        .withColumn("_sentences", F.when(longer, split_up))
        .withColumn("_picked", different if params.max_sentences is None else F.slice(different, 1, params.max_sentences))
        .withColumn(
            out,
            F.when(~longer, c)
            .when(F.size(picked) > 0, F.substring(F.array_join(picked, fv.JOINER), 1, n))
            .when(F.size(sentences) == 0, F.substring(c, 1, n))
            .otherwise(F.substring(around, 1, n)),
        )
        .drop("_clean", "_sentences", "_picked")
    )


def document_line(
    category: Column | str, title: Column | str, key: Column | str, params: TextParams = TextParams()
) -> Column:
    """`category：title`, followed by the key sentences when there are any."""
    head = F.concat(as_column(category), F.lit("："), first_chars(title, params.title_max_chars))
    body = as_column(key)
    line = F.when(body != "", F.concat(head, F.lit("；正文要点："), body)).otherwise(head)
    return first_chars(line, params.document_max_chars)


def keep_tail(c: Column | str, max_chars: int, mark: str = fv.TRUNCATED_MARK) -> Column:
    """Keep the end of a long text, with a mark in front."""
    text = F.coalesce(as_column(c), F.lit(""))
    return F.when(
        F.length(text) > max_chars, F.concat(F.lit(mark), F.right(text, F.lit(max_chars)))
    ).otherwise(text)


DEFAULT_INSTRUCTIONS = (
    "Read the dated documents of one company and rate the risk that it enters the regulated "
    'status within a year. Answer with one line of JSON: {"risk_score": <0-100>}.'
)


def scoring_prompt(
    text: Column | str,
    instructions: str = DEFAULT_INSTRUCTIONS,
    max_chars: int = 2500,
    *,
    before: str = "Documents, oldest first:\n",
    after: str = "\n\nJSON only:",
) -> Column:
    """Instructions, then the tail of the text between two fixed pieces."""
    return F.concat(
        F.lit(instructions + "\n"), F.lit(before), keep_tail(text, max_chars), F.lit(after)
    )


def with_prefilter(
    df: DataFrame,
    text: str,
    params: PrefilterParams = PrefilterParams(),
    *,
    label: str = "filter_label",
    score: str = "filter_score",
) -> DataFrame:
    """Rate a text by different keywords found, category terms and keyword density.

    The whole text is read unless `scan_chars` limits it to a prefix.
    """
    text_col = strip(F.coalesce(F.col(text), F.lit("")))
    scanned = text_col if params.scan_chars is None else F.substring(text_col, 1, params.scan_chars)
    keyword = f"(?iu)({any_of(params.keywords)})"
    term = f"(?iu)(?:{any_of(params.category_terms)})"
    found = F.size(F.array_distinct(F.regexp_extract_all(F.col("_scan"), F.lit(keyword), 1)))
    has_term = F.when(F.col("_scan").rlike(term), F.lit(2)).otherwise(F.lit(0))
    chars = F.greatest(F.length("_scan"), F.lit(1))
    dense = F.col("_found") / (chars / F.lit(1000.0) + F.lit(1e-6)) > 2.0
    points = (
        F.least(F.col("_found"), F.lit(10))
        + has_term
        + F.when(dense, F.lit(2)).otherwise(F.lit(0))
    )
    blank = (F.col("_scan") == "") | (F.col("_scan") == fv.NO_DOCUMENT)
    return (
        df.withColumn("_scan", scanned)
        .withColumn("_found", found)
        .withColumn(score, F.when(blank, F.lit(0)).otherwise(points))
        .withColumn(
            label,
            F.when(blank, F.lit("LOW"))
            .when(F.col(score) >= params.high, F.lit("HIGH"))
            .when(F.col(score) >= params.medium, F.lit("MEDIUM"))
            .otherwise(F.lit("LOW")),
        )
        .drop("_scan", "_found")
    )
