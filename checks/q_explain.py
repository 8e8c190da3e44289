"""Phrase rules and explanations over whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import PHRASES, documents, sql, sql_strip
from checks.q_text import _DOC_RUN, _REASONED_SELECT
from checks.registry import QUERIES, query
from watchpanel.functions.phrases import DEFAULT_RULES, PhraseRules, phrase_applies
from watchpanel.operators.explain import explain, risk_type_rows, with_main_type, with_risk_types, with_sentence


def _list(items) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


def _positions(table: str, words: str) -> str:
    """Occurrences from the pieces between them (none of the words overlaps itself)."""
    return f"""
      select id, w, p from (
        select id, w, i, n, sum(length(piece)) over (partition by id, w order by i)
            + (i - 1) * length(w) as p
        from (select id, w, unnest(pieces) as piece, generate_subscripts(pieces, 1) as i, len(pieces) as n
          from (select id, w, string_split(t, w) as pieces from {table}, (values {words}) as q(w) where contains(t, w))))
      where i < n"""


_ALL = sorted({p for c in PHRASES.categories.values() for group in c[1:] for p in group})


def _phrase_ctes(rules: PhraseRules) -> dict[str, str]:
    """Hits, disclaimer spans, negations and categories of the texts of `txt`."""
    phrases = sorted({p for c in rules.categories.values() for group in c[1:] for p in group})
    rows = ", ".join(
        f"('{c}', {rules.categories[c][0]}, '{p}', {rank}, {seq})"
        for c in rules.categories
        for seq, (p, rank) in enumerate(rules.ordered_phrases(c))
    )
    return {
        "txt": f"select id, {sql_strip('content')} as t from docs",
        "hits": _positions("txt", _list(phrases)),
        "negs": _positions("txt", _list(rules.negations)),
        "dis": _positions("txt", _list(rules.disclaimers)),
        "dis_marked": """
          select id, p as a, p + length(w) as b,
            max(p + length(w)) over (partition by id order by p, length(w) rows between unbounded preceding and 1 preceding) as reached
          from dis""",
        "spans": """
          select id, min(a) as a, max(b) as b from (
            select *, sum(case when reached is null or a > reached then 1 else 0 end) over (
              partition by id order by a, b rows unbounded preceding) as g from dis_marked) group by id, g""",
        "valid": f"""
          select distinct h.id, h.w from hits h
          where not exists (select 1 from spans s where s.id = h.id and h.p >= s.a and h.p + length(h.w) <= s.b)
            and not exists (select 1 from negs n where n.id = h.id
              and n.p >= h.p - {rules.reach} and n.p + length(n.w) <= h.p + length(h.w) + {rules.reach})""",
        "rules": f"select * from (values {rows}) as r(category, priority, w, strength, seq)",
        "cats": """
          select v.id, r.category, any_value(r.priority) as priority, min(r.strength) as strength,
            string_agg(v.w, '、' order by r.seq) as words
          from valid v join rules r using (w) group by 1, 2""",
        "mains": "select id, arg_min(category, (strength, priority)) as main, count(*) as n, count(distinct strength) as levels from cats group by 1",
    }


_CTES = _phrase_ctes(PHRASES)


@query(
    "phrase_hits",
    sql("select id, w as phrase from valid", "docs", extra=_CTES),
)
def phrase_hits(spark, sf):
    from watchpanel.functions.columns import strip

    docs = documents(spark, sf).select("id", strip("content").alias("t"))
    found = F.array_compact(
        F.array(*[F.when(phrase_applies("t", p, PHRASES), F.lit(p)) for p in _ALL])
    )
    return docs.select("id", F.explode(found).alias("phrase"))


@query(
    "risk_categories",
    sql(
        """select id, category as risk_type, case strength when 0 then 'high' when 1 then 'medium' else 'low' end as risk_level,
             words as matched_keywords, cast(row_number() over (partition by id order by priority) as int) as place from cats""",
        "docs", extra=_CTES,
    ),
)
def risk_categories(spark, sf):
    df = with_risk_types(documents(spark, sf), "content", rules=PHRASES)
    return risk_type_rows(df.select("id", "risk_types")).withColumn(
        "matched_keywords", F.array_join("matched_keywords", "、")
    )


@query(
    "main_and_further_categories",
    sql(
        """select d.id, m.main as primary_risk_type,
             coalesce((select string_agg(c.category, ',' order by c.priority) from cats c where c.id = d.id and c.category <> m.main), '')
               as secondary_risk_types
           from docs d left join mains m using (id)""",
        "docs", extra=_CTES,
    ),
)
def main_types(spark, sf):
    df = with_main_type(with_risk_types(documents(spark, sf), "content", rules=PHRASES))
    return df.select(
        "id", "primary_risk_type", F.array_join("secondary_risk_types", ",").alias("secondary_risk_types")
    )


_SENTENCE = """
  case when id is null then '该公告未匹配到明确的 ST 相关风险短语，建议结合全文与其他指标综合判断。'
  when n = 1 and strength = 0 then '该公告整体命中' || main || '高风险信号，主要关键词包括' || w || '，表明公司存在较高风险，需重点关注。'
  when n = 1 and strength = 1 then '该公告整体命中' || main || '中风险信号，主要关键词包括' || w || '，表明存在较明显的风险迹象，建议结合年报与审计意见等综合判断。'
  when n = 1 then '该公告整体命中' || main || '低风险提示，主要关键词包括' || w || '，提示一般性风险关注，可酌情跟踪。'
  when levels > 1 then '该公告整体命中' || names || '等风险信号，其中「' || main || '」风险等级更高（' || lv || '），主要关键词包括' || w || '等。'
  else '该公告整体命中' || names || '等风险信号，均以' || lv || '等级为主，主要关键词包括' || w || '等，建议结合公告全文综合判断。' end"""


_EXPLAINED = f"""select doc as id, main as primary_risk_type, {_SENTENCE} as overall_explanation from (
             select d.id as doc, m.id, m.main, m.n, m.levels, c.strength, c.w,
               case c.strength when 0 then '高' when 1 then '中' else '低' end as lv,
               (select case count(*) when 1 then any_value(category) else
                  array_to_string(list_slice(list(category order by priority), 1, count(*) - 1), '、') || '与' || arg_max(category, priority) end
                from cats x where x.id = d.id) as names
             from txt d left join mains m using (id)
             left join (select id, category, strength, array_to_string(list_slice(string_split(words, '、'), 1, 8), '、') as w from cats) c
               on c.id = m.id and c.category = m.main)"""


@query(
    "explanation_sentences",
    sql(f"select id, overall_explanation from ({_EXPLAINED})", "docs", extra=_CTES),
)
def sentences(spark, sf):
    df = with_sentence(with_main_type(with_risk_types(documents(spark, sf), "content", rules=PHRASES)))
    return df.select("id", "overall_explanation")


_REASONED_CTES = {
    **_DOC_RUN,
    "reasoned": _REASONED_SELECT,
    **_CTES,
    "txt": "select date || '/' || entity as id, ann_daily as t from reasoned",
}


@query(
    "explained_watchlist",
    sql(
        f"""select r.date, r.rank, r.entity, r.risk_score, e.primary_risk_type, e.overall_explanation
            from reasoned r join ({_EXPLAINED}) e on e.id = r.date || '/' || r.entity""",
        "doc_text", extra=_REASONED_CTES,
    ),
)
def explained_watchlist(spark, sf):
    """Documents to watchlist to explanations."""
    rows = explain(QUERIES["reasoned_watchlist_from_documents"](spark, sf), rules=PHRASES)
    return rows.select(
        "date", "rank", "entity", "risk_score",
        "explain.primary_risk_type", "explain.overall_explanation",
    )


@query(
    "explained_documents_with_shipped_rules",
    sql(
        f"select id, primary_risk_type, overall_explanation from ({_EXPLAINED})",
        "docs", extra=_phrase_ctes(DEFAULT_RULES),
    ),
)
def explained_documents(spark, sf):
    """All documents under the shipped phrase rules."""
    df = explain(documents(spark, sf), "content")
    return df.select("id", "explain.primary_risk_type", "explain.overall_explanation")
