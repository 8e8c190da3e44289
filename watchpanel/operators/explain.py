"""Explanations of listed rows: risk categories, main category, sentence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import strip
from watchpanel.functions.phrases import DEFAULT_RULES, PhraseRules, category_hits, level_name

_KEYWORDS_SHOWN = 8


def with_risk_types(
    df: DataFrame, text: str, out: str = "risk_types", rules: PhraseRules = DEFAULT_RULES
) -> DataFrame:
    """Add array<struct<risk_type, risk_level, matched_keywords>>, categories by priority.

    The rule list is fixed when the query is built, so each category is one array of at most
    as many elements as it has phrases, already in its final order.
    """
    categories = rules.ordered_categories()
    # null texts have no hits; without the strip, phrases are looked for in the column itself
    source = strip(text) if rules.needs_strip() else F.col(text)
    staged = df.withColumn("_t", source).withColumns(
        {f"_hits{i}": category_hits("_t", c, rules) for i, (c, _) in enumerate(categories)}
    )
    found = [
        F.when(
            F.size(f"_hits{i}") > 0,
            F.struct(
                F.lit(category).alias("risk_type"),
                level_name(F.col(f"_hits{i}")[0]["strength"]).alias("risk_level"),
                F.transform(f"_hits{i}", lambda h: h["phrase"]).alias("matched_keywords"),
            ),
        )
        for i, (category, _) in enumerate(categories)
    ]
    return staged.withColumn(out, F.array_compact(F.array(*found))).drop(
        "_t", *[f"_hits{i}" for i in range(len(categories))]
    )


def risk_type_rows(df: DataFrame, types: str = "risk_types") -> DataFrame:
    """One row per category found, with its 1-based `place`, instead of the array.

    The outer form of explode keeps the optimizer from filtering on the array, which would
    evaluate all phrase rules once more below.
    """
    keep = [c for c in df.columns if c != types]
    return (
        df.select(*keep, F.posexplode_outer(types).alias("_i", "_r"))
        .where(F.col("_i").isNotNull())
        .select(*keep, "_r.*", (F.col("_i") + 1).alias("place"))
    )


def _severity(level: Column) -> Column:
    return F.when(level == "high", F.lit(0)).when(level == "medium", F.lit(1)).otherwise(F.lit(2))


def with_main_type(df: DataFrame, types: str = "risk_types") -> DataFrame:
    """Add `primary_risk_type` (highest level, then priority) and `secondary_risk_types`."""
    # the array is in priority order, so the place of an entry stands for its priority
    by_severity = F.array_sort(
        F.transform(
            types,
            lambda r, i: F.struct(
                _severity(r["risk_level"]).alias("s"), i.alias("i"), r["risk_type"].alias("name")
            ),
        )
    )
    primary = F.when(F.size(types) > 0, F.col("_sorted")[0]["name"])
    return (
        df.withColumn("_sorted", by_severity)
        .withColumn("primary_risk_type", primary)
        .withColumn(
            "secondary_risk_types",
            F.filter(
                F.transform(types, lambda r: r["risk_type"]),
                lambda name: name != F.col("primary_risk_type"),
            ),
        )
        .drop("_sorted")
    )


def with_sentence(df: DataFrame, types: str = "risk_types", out: str = "overall_explanation") -> DataFrame:
    """Add the explanation sentence: none, one category by level, several mixed or equal."""
    t = F.col(types)
    names = F.transform(types, lambda r: r["risk_type"])
    main = F.filter(types, lambda r: r["risk_type"] == F.col("primary_risk_type"))[0]
    levels = F.array_distinct(F.transform(types, lambda r: r["risk_level"]))
    zh = F.create_map(*[F.lit(x) for pair in fv.LEVEL_NAMES.items() for x in pair])
    many_names = F.concat(
        F.array_join(F.slice("_names", 1, F.size("_names") - 1), fv.KEYWORD_JOINER),
        F.lit(fv.CATEGORY_JOINER),
        F.element_at("_names", -1),
    )
    level, words = F.col("_main.risk_level"), F.col("_words")
    one = (
        F.when(level == "high", F.format_string(fv.SENTENCE_ONE_HIGH, "primary_risk_type", words))
        .when(level == "medium", F.format_string(fv.SENTENCE_ONE_MEDIUM, "primary_risk_type", words))
        .otherwise(F.format_string(fv.SENTENCE_ONE_LOW, "primary_risk_type", words))
    )
    return (
        df.withColumn("_main", F.when(F.size(t) > 0, main))
        .withColumn("_names", names)
        .withColumn("_levels", levels)
        .withColumn(
            "_words",
            F.array_join(F.slice("_main.matched_keywords", 1, _KEYWORDS_SHOWN), fv.KEYWORD_JOINER),
        )
        .withColumn(
            out,
            F.when(F.size(t) == 0, F.lit(fv.SENTENCE_NONE))
            .when(F.size(t) == 1, one)
            .when(
                F.size("_levels") > 1,
                F.format_string(
                    fv.SENTENCE_MIXED, many_names, "primary_risk_type", zh[level], words
                ),
            )
            .otherwise(F.format_string(fv.SENTENCE_SAME, many_names, zh[level], words)),
        )
        .drop("_main", "_names", "_levels", "_words")
    )


def explain(df: DataFrame, text: str = "ann_daily", rules: PhraseRules = DEFAULT_RULES) -> DataFrame:
    """Add the struct `explain`: risk types, main and further types, sentence."""
    staged = with_sentence(with_main_type(with_risk_types(df, text, "risk_types", rules)))
    parts = ("risk_types", "primary_risk_type", "secondary_risk_types", "overall_explanation")
    return staged.withColumn("explain", F.struct(*parts)).drop(*parts)
