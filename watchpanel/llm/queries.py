"""Registered queries of the training-data operators, one for each, and the pipeline.

Each applies its operator with production parameters to its whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpanel.llm import byte_bpe, decontaminate, main_text, packing, prefix_trie, quality_rules, secrets, sharding, simhash, substrings, surrogates, token_alignment, weak_labels

Query = Callable[[SparkSession, str], DataFrame]
#: production takes its own from its key store
PII_SECRET = "watchpanel-surrogates"
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op3_simhash_golay")
def op3_simhash_golay(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf, "documents"))


@query("op9_best_fit_packing")
def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf, "documents"), with_ids=False)


@query("op10_hash_tree_shards")
def op10_hash_tree_shards(spark: SparkSession, sf: str) -> DataFrame:
    tree = sharding.even_tree(8)
    placed = sharding.shard_documents(table(spark, sf, "documents"), tree, sharding.with_shard(tree, 8))
    return placed.withColumn("law", F.lit("key"))


@query("op2_divergence_rules")
def op2_divergence_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.judged(table(spark, sf, "documents"))


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf: str) -> DataFrame:
    return main_text.extract(table(spark, sf, "pages"))


@query("op7_surrogates")
def op7_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    """(doc_id, n_entities, text, spans) of every document; spans are JSON."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = surrogates.distinct_surrogates(docs, PII_SECRET, spans="found")
    return found.select(
        "doc_id", F.size("found").cast("bigint").alias("n_entities"), "text", F.to_json("found").alias("spans")
    )


@query("op5_trigram_secrets")
def op5_trigram_secrets(spark: SparkSession, sf: str) -> DataFrame:
    found = secrets.scan(table(spark, sf, "documents"))
    spans = F.col("spans")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [number(r.kind) for r in secrets.BASE]
    base = F.filter(spans, lambda s: s["order"] < len(secrets.BASE))
    return found.select(
        "doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(spans).alias("spans")
    )


@query("op4_spaced_seeds")
def op4_spaced_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_block_anchors")
def op8_block_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.repeated_words(table(spark, sf, "documents"))


@query("op1_weak_labels")
def op1_weak_labels(spark: SparkSession, sf: str) -> DataFrame:
    return weak_labels.scored(table(spark, sf, "documents"))


@query("op12_byte_bpe")
def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    decoded = byte_bpe.decode(byte_bpe.encode(table(spark, sf, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


OP13_SQL = """
with turns as (
  select conv_id, row_number() over (
      partition by conv_id order by turn nulls first, sha256(length(r) || ':' || r || t)) as place,
    sha256(length(r) || ':' || r || t) as id, length(t) as n
  from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t
        from conversations where conv_id is not null)),
convs as (
  select conv_id, xor(4294967295, list_reduce(
      list_concat([4294967295::bigint], list_transform(
        range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i, 1))::bigint)),
      lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end))) % 6 as h,
    conv_id - conv_id % 100 as base
  from (select distinct conv_id from conversations where conv_id is not null)),
rebuilt as (
  select c.conv_id, 0 as part, t.place, t.id, t.n
  from convs c join turns t on t.conv_id = c.base and t.place <= c.h
  union all
  select c.conv_id, 1, t.place, t.id, t.n from convs c join turns t on t.conv_id = c.conv_id and t.place > c.h),
lists as (
  select c.conv_id, coalesce(list(r.id order by r.part, r.place) filter (r.id is not null), []) as ids,
    coalesce(list(r.n order by r.part, r.place) filter (r.id is not null), []) as ns
  from convs c left join rebuilt r on r.conv_id = c.conv_id group by c.conv_id),
prefixes as (
  select conv_id, d, ids[1:d] as prefix, case when d = 0 then 0 else ns[d] end as n, d = len(ids) as ends
  from lists, lateral (select unnest(range(0, len(ids) + 1)) as d)),
nodes as (
  select prefix, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n) as n,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from prefixes group by prefix),
kids as (select prefix[1:depth - 1] as of, count(*) as n_children from nodes where depth > 0 group by 1),
whole as (
  select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids on kids.of = nodes.prefix),
below as (
  select prefix[1:a] as top, sum((n_convs - 1) * n) as saved_tokens, count(*) filter (n_children = 0) as n_leaves
  from whole, lateral (select unnest(range(0, depth + 1)) as a) group by 1)
select w.conv_id, w.depth, p.conv_id as parent_conv_id, w.n_convs, w.n_children, b.n_leaves,
  b.saved_tokens::bigint as saved_tokens, w.ends_sha256
from whole w join below b on b.top = w.prefix
left join whole p on w.depth > 0 and p.prefix = w.prefix[1:w.depth - 1]
"""


@query("op13_prefix_trie", OP13_SQL)
def op13_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_trie.conversation_trie(table(spark, sf, "conversations"))


@query("op11_pointer_jumping")
def op11_pointer_jumping(spark: SparkSession, sf: str) -> DataFrame:
    found = token_alignment.align(table(spark, sf, "documents"))
    sha = F.when(F.col("n_a") == 0, "").otherwise(F.sha2("groups", 256))
    return found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum",
        sha.alias("groups_sha256"),
    )
