"""Documents, prefilter, scoring, score parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.data import (
    DOC_FIRST,
    DOC_LAST,
    DOC_OUTPUT,
    KEYWORDS,
    PREFILTER,
    TEXT,
    USABLE,
    documents,
    dim_scores,
    scorer_outputs,
    sql,
    sql_clean,
    sql_code,
    sql_strip,
    table,
)
from checks.registry import query
from watchpanel import fixed_values as fv
from watchpanel.functions import columns as cl
from watchpanel.functions import outputs as op
from watchpanel.functions import text as tx
from watchpanel.operators import documents as dc
from watchpanel.operators import panel as pn
from watchpanel.operators import scoring as sc
from watchpanel.params import TextParams

KEYS = pn.KEYS
RANGE = (DOC_FIRST, DOC_LAST)


def daily(spark, sf):
    return dc.daily_text(documents(spark, sf), *RANGE, TEXT)


def texts(spark, sf):
    panel = pn.dense_panel(pn.universe(documents(spark, sf)), *RANGE)
    return dc.text_panel(panel, documents(spark, sf), *RANGE, TEXT)


# --- scalar expressions -----------------------------------------------------
@query(
    "normalize_code",
    sql(
        f"""select o_orderkey as id, raw,
             case when regexp_matches(cut, '^[0-9]+$') and length(cut) < 6 then lpad(cut, 6, '0') else cut end as code
           from (select *, split_part({sql_strip('raw')}, '.', 1) as cut from (
             select o_orderkey, case o_orderkey % 4 when 0 then ' ' || cast(o_custkey as varchar) || '.SZ'
               when 1 then cast(o_custkey as varchar) || '.0' when 2 then o_orderpriority
               else cast(o_orderkey * 100003 as varchar) end as raw from orders))"""
    ),
)
def normalize(spark, sf):
    o = table(spark, sf, "orders")
    form, key = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    raw = (
        F.when(form == 0, F.concat(F.lit(" "), key, F.lit(".SZ")))
        .when(form == 1, F.concat(key, F.lit(".0")))
        .when(form == 2, F.col("o_orderpriority"))
        .otherwise((F.col("o_orderkey") * 100003).cast("string"))
    )
    return o.select(F.col("o_orderkey").alias("id"), raw.alias("raw"), cl.normalize_code(raw).alias("code"))


@query(
    "parse_mixed_dates",
    sql("select o_orderkey as id, case when o_orderkey % 5 = 4 then null else cast(o_orderdate as date) end as date from orders"),
)
def mixed_dates(spark, sf):
    o = table(spark, sf, "orders")
    form, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    raw = (
        F.when(form == 0, F.date_format(d, "yyyy-MM-dd"))
        .when(form == 1, F.date_format(d, "yyyy/M/d"))
        .when(form == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss"))
        .when(form == 3, F.date_format(d, "yyyyMMdd"))
        .otherwise(F.lit("not a date"))
    )
    return o.select(F.col("o_orderkey").alias("id"), cl.parse_mixed_date(raw).alias("date"))


@query(
    "parse_numeric_dates",
    sql("select o_orderkey as id, case when o_orderkey % 3 = 2 then null else cast(o_orderdate as date) end as date from orders"),
)
def numeric_dates(spark, sf):
    o = table(spark, sf, "orders")
    form, text = F.col("o_orderkey") % 3, F.date_format("o_orderdate", "yyyyMMdd")
    raw = F.when(form == 0, F.concat(text, F.lit(".0"))).when(form == 1, text).otherwise(F.lit("20249999"))
    return o.select(F.col("o_orderkey").alias("id"), cl.parse_yyyymmdd(raw).alias("date"))


@query(
    "coerce_scores",
    sql(
        """select event_id as id, round(cast(cast(least(greatest(case when event_id % 7 = 0 then 0 else value - 50 end, 0), 100)
             as real) as double), 4) as clipped,
             round(case when event_id % 7 = 0 then 0 else value - 50 end, 4) as plain from events"""
    ),
)
def coerce(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 7 == 0, F.lit("n/a")).otherwise((F.col("value") - 50).cast("string"))
    return e.select(
        F.col("event_id").alias("id"),
        F.round(cl.coerce_score(raw).cast("double"), 4).alias("clipped"),
        F.round(cl.coerce_score(raw, clip=False), 4).alias("plain"),
    )


@query(
    "calendar_features",
    sql(
        """select o_orderkey as id, month(d) as month, quarter(d) as quarter, dayofyear(d) as dayofyear,
             round(sin(2 * pi() * month(d) / 12), 6) as month_sin, round(cos(2 * pi() * month(d) / 12), 6) as month_cos
           from (select o_orderkey, cast(o_orderdate as date) as d from orders)"""
    ),
)
def calendar_features(spark, sf):
    parts = cl.calendar_parts(F.to_date("o_orderdate"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"),
        *[parts[p].cast("bigint").alias(p) for p in ("month", "quarter", "dayofyear")],
        *[(F.round(parts[p], 6) + 0.0).alias(p) for p in ("month_sin", "month_cos")],
    )


@query(
    "clip_and_integer_scores",
    sql(
        """select event_id as id, round(least(greatest((value - 50) / 100, 0), 1), 6) as unit,
             cast(trunc(value - 50) as bigint) as whole from events"""
    ),
)
def clip_int(spark, sf):
    v = F.col("value") - 50
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.round(cl.clip_unit(v / 100), 6).alias("unit"), cl.int_score(v).alias("whole")
    )


@query("clean_text", sql(f"select id, {sql_clean('content')} as content from docs", "docs"))
def clean(spark, sf):
    return documents(spark, sf).select("id", tx.clean_text("content").alias("content"))


@query("key_sentences", sql("select id, key from keyed_docs_all", "keyed_docs_all"))
def key_sentences(spark, sf):
    return tx.with_key_sentences(documents(spark, sf), "content", "key", TEXT).select("id", "key")


@query(
    "keep_tail_and_prompt",
    sql(
        """select doc_id as id, case when length(text) > 500 then '…(省略前文)…' || right(text, 500) else text end as tail,
             length('Rate.' || chr(10) || 'Documents, oldest first:' || chr(10) ||
               case when length(text) > 2500 then '…(省略前文)…' || right(text, 2500) else text end
               || chr(10) || chr(10) || 'JSON only:') as prompt_chars
           from documents"""
    ),
)
def tails(spark, sf):
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"),
        tx.keep_tail("text", 500).alias("tail"),
        F.length(tx.scoring_prompt("text", "Rate.")).cast("bigint").alias("prompt_chars"),
    )


# --- documents to daily texts -----------------------------------------------
@query(
    "usable_documents",
    sql(
        """select id, entity, date, title, category_name from used_docs
           where date between date '2023-12-20' and date '2024-01-20'""",
        "used_docs",
    ),
)
def usable(spark, sf):
    """A period within the documents' days is the feature here."""
    return dc.usable_documents(documents(spark, sf), *USABLE).select("id", *KEYS, "title", "category_name")


@query("first_documents_per_day", sql("select id, entity, date, rank from kept_docs", "kept_docs"))
def first_docs(spark, sf):
    usable_docs = dc.usable_documents(documents(spark, sf), *RANGE)
    return dc.first_documents(usable_docs, 3).select("id", *KEYS, "rank")


@query("document_lines", sql("select entity, date, rank, line from doc_lines", "doc_lines"))
def lines(spark, sf):
    return dc.daily_lines(documents(spark, sf), *RANGE, TEXT)


@query("daily_text", sql("select entity, date, doc_text from doc_text", "doc_text"))
def daily_query(spark, sf):
    return daily(spark, sf)


@query(
    "daily_text_without_limits",
    sql(
        f"""select entity, date, string_agg(category_name || '：' || title ||
              case when key <> '' then '；正文要点：' || key else '' end, '；' order by id) as doc_text
            from (select id, entity, date, title, category_name, {sql_clean("coalesce(content, '')")} as key from used_docs)
            group by 1, 2""",
        "used_docs",
    ),
)
def daily_whole(spark, sf):
    """Every document of a day with its whole text."""
    whole = TextParams(
        max_docs_per_day=None, max_sentences=None, key_max_chars=None, title_max_chars=None, document_max_chars=None
    )
    return dc.daily_text(documents(spark, sf), *RANGE, whole)


_TEXT_PANEL = {
    "doc_panel": """
      select entity, date from (select distinct entity from docs) cross join
        (select cast(unnest(generate_series(date '2023-12-10', date '2024-01-23', interval 1 day)) as date) as date)""",
    "text_panel": """
      select p.entity, p.date, coalesce(any_value(d.doc_text), '无相关公告') as doc_text,
        coalesce(string_agg(w.doc_text, '；' order by w.date), '无相关公告') as lookback
      from doc_panel p left join doc_text d on d.entity = p.entity and d.date = p.date
        left join doc_text w on w.entity = p.entity and w.date between p.date - 21 and p.date
      group by 1, 2""",
}


@query(
    "lookback_text_panel",
    sql("select entity, date, doc_text, lookback from text_panel", "doc_text", extra=_TEXT_PANEL),
)
def lookback(spark, sf):
    return texts(spark, sf).select(*KEYS, "doc_text", "lookback")


@query(
    "text_and_status_panel",
    sql(
        """select t.entity, t.date, length(t.lookback) as chars, case when l.entity is not null then 1 else 0 end as y_status
           from text_panel t left join (
             select distinct source as entity, publish_date as date from docs join documents on doc_id = id where lang = 'de') l
           using (entity, date)""",
        "doc_text", extra=_TEXT_PANEL,
    ),
)
def text_status(spark, sf):
    """German documents stand for in-status days."""
    german = (
        documents(spark, sf).where(F.col("category_name") == "de")
        .select("entity", F.col("publish_date").alias("date"), F.lit(1).alias("y_status")).distinct()
    )
    joined = pn.join_text_and_status(texts(spark, sf), german)
    return joined.select(*KEYS, F.length("lookback").cast("bigint").alias("chars"), "y_status")


# --- prefilter and selection ------------------------------------------------
def _prefilter_cte(source: str, text: str, key: str, scan: str) -> dict[str, str]:
    kw, terms = tx.any_of(PREFILTER.keywords), tx.any_of(PREFILTER.category_terms)
    return {
        "rated": f"""
          select *, case when points >= 5 then 'HIGH' when points >= 3 then 'MEDIUM' else 'LOW' end as filter_label
          from (select *, case when s = '' or s = '无相关公告' then 0 else
               least(cnt, 10) + (case when regexp_matches(s, '(?i)({terms})') then 2 else 0 end)
               + (case when cnt / (greatest(length(s), 1) / 1000.0 + 1e-6) > 2.0 then 2 else 0 end) end as points
            from (select *, len(list_distinct(regexp_extract_all(s, '(?i)({kw})', 1))) as cnt
              from (select {key}, {scan.format(sql_strip(text))} as s from {source})))""",
    }


@query(
    "prefilter_whole_documents",
    sql(
        "select id, filter_label, cast(points as int) as filter_score from rated",
        "docs", extra=_prefilter_cte("docs", "content", "id", "{}"),
    ),
)
def prefilter_documents(spark, sf):
    from dataclasses import replace

    df = tx.with_prefilter(documents(spark, sf), "content", replace(PREFILTER, scan_chars=None))
    return df.select("id", "filter_label", F.col("filter_score").cast("int"))


_RATED_DAYS = _prefilter_cte("doc_text", "doc_text", "entity, date, doc_text", "substring({}, 1, 1200)")


@query(
    "prefilter_daily_text",
    sql("select entity, date, filter_label, cast(points as int) as filter_score from rated", "doc_text", extra=_RATED_DAYS),
)
def prefilter_daily(spark, sf):
    df = tx.with_prefilter(daily(spark, sf), "doc_text", PREFILTER)
    return df.select(*KEYS, "filter_label", F.col("filter_score").cast("int"))


@query(
    "prefilter_label_counts",
    sql("select filter_label, count(*) as n from rated group by 1", "doc_text", extra=_RATED_DAYS),
)
def label_counts(spark, sf):
    return dc.prefilter_counts(tx.with_prefilter(daily(spark, sf), "doc_text", PREFILTER))


@query(
    "select_plain_tasks",
    sql(
        """select entity, date, lookback as text from text_panel
           where date between date '2024-01-01' and date '2024-01-23' and lookback <> '无相关公告'
             and (doc_text <> '无相关公告' or date = date '2024-01-01')""",
        "doc_text", extra=_TEXT_PANEL,
    ),
)
def plain_tasks(spark, sf):
    return dc.select_plain(texts(spark, sf), DOC_OUTPUT, first_day_all=True)


_TASKS_SQL = """select entity, date, doc_text as text from rated
                where date <= date '2024-01-23' and filter_label in ('HIGH', 'MEDIUM')"""


@query("select_prefiltered_tasks", sql(_TASKS_SQL, "doc_text", extra=_RATED_DAYS))
def prefiltered_tasks(spark, sf):
    return dc.select_prefiltered(daily(spark, sf), DOC_OUTPUT, PREFILTER)


# --- scoring ----------------------------------------------------------------
_SCORE_SQL = "least(100, 20 * ({}))".format(
    " + ".join(f"(case when contains(text, '{k}') then 1 else 0 end)" for k in KEYWORDS)
)


make_scorer = sc.keyword_answers(KEYWORDS)


def scored(spark, sf):
    return sc.score_texts(dc.select_prefiltered(daily(spark, sf), DOC_OUTPUT, PREFILTER), make_scorer, parts=8)


@query(
    "batch_text_scoring",
    sql(
        f"select entity, date, cast({_SCORE_SQL} as int) as risk_score, true as parse_ok from ({_TASKS_SQL})",
        "doc_text", extra=_RATED_DAYS,
    ),
)
def batch_scoring(spark, sf):
    return sc.scoring_results(scored(spark, sf))


@query(
    "scoring_log",
    sql(
        f"""select entity, date,
             case when length(text) > 600 then '…(省略前文)…' || right(text, 600) else text end as text_tail,
             length(text) as text_chars, '{{"risk_score": ' || {_SCORE_SQL} || '}}' as raw_output_trunc,
             true as parse_ok, cast({_SCORE_SQL} as int) as risk_score, cast(null as varchar) as parse_error
           from ({_TASKS_SQL})""",
        "doc_text", extra=_RATED_DAYS,
    ),
)
def scoring_log(spark, sf):
    return sc.debug_rows(scored(spark, sf)).withColumn("text_chars", F.col("text_chars").cast("bigint"))


@query(
    "batch_text_scoring_in_python",
    sql(
        f"select entity, date, cast({_SCORE_SQL} as int) as risk_score, true as parse_ok from ({_TASKS_SQL})",
        "doc_text", extra=_RATED_DAYS,
    ),
)
def batch_scoring_python(spark, sf):
    """The form for scorers that are no expression: batches of texts in Python workers."""
    tasks = dc.select_prefiltered(daily(spark, sf), DOC_OUTPUT, PREFILTER)
    return sc.scoring_results(sc.score_texts(tasks, lambda: sc.KeywordScorer(KEYWORDS), parts=8))


@query(
    "scoring_with_answer_store",
    sql(
        f"""select entity, date, cast({_SCORE_SQL} as int) as risk_score, true as parse_ok,
             (select count(distinct text) from ({_TASKS_SQL}) where date < date '2024-01-05') as first_run,
             (select count(distinct text) from ({_TASKS_SQL}) where text not in (
                select text from ({_TASKS_SQL}) where date < date '2024-01-05')) as second_run, 0 as third_run
           from ({_TASKS_SQL})""",
        "doc_text", extra=_RATED_DAYS,
    ),
)
def scoring_store(spark, sf):
    """Three runs over one store: the days up to a day, all days, all days again; each scores new texts only."""
    from watchpanel.sources.answers import AnswerStore
    from watchpanel.sources.storage import materialize, scratch_path

    store = AnswerStore(spark, scratch_path(spark, "answers"))
    tasks = materialize(dc.select_prefiltered(daily(spark, sf), DOC_OUTPUT, PREFILTER))
    written = [0]
    for part in (tasks.where("date < '2024-01-05'"), tasks, tasks):
        done = store.score(part, make_scorer)
        written.append(store.rows().count())
    new = [b - a for a, b in zip(written, written[1:])]
    return sc.scoring_results(done).select(
        "*", *[F.lit(n).cast("bigint").alias(c) for n, c in zip(new, ("first_run", "second_run", "third_run"))]
    )


@query("parse_scores", sql("select id, risk_score, parse_ok from parsed", "parsed"))
def parse_scores(spark, sf):
    return op.with_parsed_score(scorer_outputs(spark, sf), "raw").select("id", "risk_score", "parse_ok")


@query(
    "strip_code_fences",
    sql("select id, case when id % 5 = 1 then 'json {\"risk_score\": ' || k || '}' else raw end as body from outputs", "outputs"),
)
def fences(spark, sf):
    return scorer_outputs(spark, sf).select("id", op.strip_fences("raw").alias("body"))


@query(
    "parse_four_scores",
    sql(
        """select event_id as id, event_id % 3 <> 2 as parse_ok,
             case when event_id % 3 = 2 then 0 else k end as financial_risk,
             case when event_id % 3 = 2 then 0 else k end as normative_risk,
             case when event_id % 3 = 2 then 0 else cast(least(trunc(value), 100) as int) end as illegal_risk,
             0 as other_risk
           from (select *, cast(json_extract_string(props, '$.k') as int) as k from events)"""
    ),
)
def parse_four(spark, sf):
    """Numbers, text integers, fractions, a missing field; every third with an unreadable field."""
    k = F.get_json_object("props", "$.k")
    broken = F.when(F.col("event_id") % 3 == 2, F.lit('"12.5"')).otherwise(F.concat(F.lit('"'), k, F.lit('"')))
    raw = F.concat(
        F.lit('Answer: {"financial_risk": '), k, F.lit(', "normative_risk": '), broken,
        F.lit(', "illegal_risk": '), F.col("value").cast("string"), F.lit("}."),
    )
    df = table(spark, sf, "events").select(F.col("event_id").alias("id"), raw.alias("raw"))
    return op.with_parsed_dims(df, "raw").select("id", "parse_ok", *fv.DIMS)


@query(
    "scoring_run_summary",
    sql(
        """select count(*) as n_total, count(*) filter (parse_ok) as n_parse_ok, count(*) filter (not parse_ok) as n_parse_fail,
             round(count(*) filter (parse_ok) / count(*), 6) as parse_ok_rate from parsed""",
        "parsed",
    ),
)
def run_summary(spark, sf):
    df = sc.scoring_summary(op.with_parsed_score(scorer_outputs(spark, sf), "raw"))
    return df.withColumn("parse_ok_rate", F.round("parse_ok_rate", 6))


@query(
    "place_last_result",
    sql(
        """select p.entity, p.date, cast(r.risk_score as double) as risk_score from panel p left join (
             select entity, date, arg_max(risk_score, id) as risk_score from parsed group by 1, 2) r using (entity, date)""",
        "panel", "parsed",
    ),
)
def place_last(spark, sf):
    from checks.q_rules import panel_of

    results = op.with_parsed_score(scorer_outputs(spark, sf), "raw")
    df = sc.place_results(panel_of(spark, sf), results, ["risk_score"], "id")
    return df.select(*KEYS, F.col("risk_score").cast("double").alias("risk_score"))


# --- whole document runs ----------------------------------------------------
def _document_rules():
    from dataclasses import replace

    from checks.data import RULES

    return replace(
        RULES, output_start=DOC_OUTPUT[0], output_end=DOC_OUTPUT[1], decay=10.0, entry=60.0, retain=40.0
    )


_DOC_RUN = {
    **_RATED_DAYS,
    "doc_scores": f"select entity, date, {_SCORE_SQL} as v from ({_TASKS_SQL}) where date >= date '2024-01-01'",
    "doc_dense": """
      select e.entity, c.date, coalesce(s.v, 0) as v from (select distinct entity from docs) e cross join
        (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-23', interval 1 day)) as date) as date) c
        left join doc_scores s using (entity, date)""",
    "doc_mem": """
      select entity, date, cast(case when v >= 60 then v else 0 end as double) as s from doc_dense where date = date '2024-01-01'
      union all
      select d.entity, d.date, case when x.s1 < 40 then 0.0 else x.s1 end as s
      from doc_mem m join doc_dense d on d.entity = m.entity and d.date = m.date + 1,
        lateral (select greatest(m.s - 10, 0.0) as s0) a,
        lateral (select case when d.v > 0 and a.s0 > 0 then greatest(a.s0, d.v)
                             when d.v > 0 and d.v >= 60 then d.v else a.s0 end as s1) x""",
    "doc_status": """select distinct source as entity, cast(ts as date) as date from documents join events on event_id = doc_id
                     where event_type = 'signup' and value > 60 and cast(ts as date) between date '2023-12-10' and date '2024-01-23'""",
}


def _document_intervals(spark, sf):
    """Documents meet events by number: large signups give one-day status intervals."""
    ev = table(spark, sf, "events").where((F.col("event_type") == "signup") & (F.col("value") > 60))
    docs = documents(spark, sf).select("id", "entity")
    day = F.to_date("ts")
    return docs.join(ev, F.col("event_id") == F.col("id")).select(
        "entity", day.alias("entry_date"), day.alias("remove_date")
    )


_REASONED_SELECT = """select m.date, cast(row_number() over (partition by m.date order by s desc, m.entity) as bigint) as rank, m.entity,
             cast(trunc(s) as bigint) as risk_score, 0 as is_st, coalesce(t.doc_text, '无相关公告') as ann_daily
           from doc_mem m left join doc_text t using (entity, date)
           where s >= 40 and not exists (select 1 from doc_status d where d.entity = m.entity and d.date = m.date)"""


@query("reasoned_watchlist_from_documents", sql(_REASONED_SELECT, "doc_text", extra=_DOC_RUN))
def reasoned(spark, sf):
    from watchpanel.plans.rule_track import run_from_documents

    result, texts_ = run_from_documents(
        documents(spark, sf), _document_intervals(spark, sf), _document_rules(), make_scorer, scorer_parts=8
    )
    return result.reasoned(texts_)


@query(
    "plain_scheme_filled_scores",
    sql(
        """select p.entity, p.date, cast(case when x.seen is null or p.date - x.seen > 4 then 0 else x.score end as double) as score
           from (select * from doc_panel where date >= date '2024-01-01') p left join lateral (
             select q.date as seen, q.score from (
               select entity, date, """
        + _SCORE_SQL.replace("text", "lookback")
        + """ as score from text_panel where doc_text <> '无相关公告' and date >= date '2024-01-01') q
             where q.entity = p.entity and q.date <= p.date order by q.date desc limit 1) x on true""",
        "doc_text", extra=_TEXT_PANEL,
    ),
)
def plain_scheme(spark, sf):
    from watchpanel.plans.rule_track import filled_scores

    df = filled_scores(documents(spark, sf), _document_rules(), make_scorer, max_days=4, scorer_parts=8)
    return df.select(*KEYS, F.col("score").cast("double").alias("score"))


@query(
    "plain_scheme_first_day_all",
    sql(
        """select p.entity, p.date, cast(case when x.seen is null or p.date - x.seen > 4 then 0 else x.score end as double) as score
           from (select * from doc_panel where date >= date '2024-01-01') p left join lateral (
             select q.date as seen, q.score from (
               select entity, date, """
        + _SCORE_SQL.replace("text", "lookback")
        + """ as score from text_panel where date >= date '2024-01-01' and lookback <> '无相关公告'
                 and (doc_text <> '无相关公告' or date = date '2024-01-01')) q
             where q.entity = p.entity and q.date <= p.date order by q.date desc limit 1) x on true""",
        "doc_text", extra=_TEXT_PANEL,
    ),
)
def plain_scheme_first_day(spark, sf):
    """Every entity is scored on the first output day, from the days before."""
    from watchpanel.plans.rule_track import filled_scores

    df = filled_scores(documents(spark, sf), _document_rules(), make_scorer, max_days=4, first_day_all=True)
    return df.select(*KEYS, F.col("score").cast("double").alias("score"))


_LOOKBACK_TASKS = """
  select t.entity, t.date, t.lookback as text from text_panel t left join rated r using (entity, date)
  where t.date <= date '2024-01-23' and (t.date = date '2024-01-01' or (r.filter_label in ('HIGH', 'MEDIUM') and t.lookback <> '无相关公告'))"""


@query(
    "watchlist_from_lookback_texts",
    sql(
        "select m.date, cast(row_number() over (partition by m.date order by s desc, m.entity) as bigint) as rank, m.entity, "
        "s as score from doc_mem m where s >= 40 and not exists "
        "(select 1 from doc_status d where d.entity = m.entity and d.date = m.date)",
        "doc_text",
        extra={
            **_TEXT_PANEL, **_DOC_RUN,
            "doc_scores": f"select entity, date, {_SCORE_SQL} as v from ({_LOOKBACK_TASKS}) where date >= date '2024-01-01'",
        },
    ),
)
def lookback_watchlist(spark, sf):
    """The decay scheme on lookback texts, every entity scored on the first output day, through a store."""
    from watchpanel.plans.rule_track import run_from_documents
    from watchpanel.sources.answers import AnswerStore
    from watchpanel.sources.storage import scratch_path

    run, _ = run_from_documents(
        documents(spark, sf), _document_intervals(spark, sf), _document_rules(), make_scorer,
        first_day_all=True, use_daily_text=False, store=AnswerStore(spark, scratch_path(spark, "lookback-answers"), slices=2),
    )
    return run.watchlist().select("date", "rank", "entity", F.col("score").cast("double").alias("score"))


# --- status entities and limits -----------------------------------------------
@query(
    "plain_scheme_with_status_entities",
    sql(
        """select entity, date, cast(score as double) as score from (
             select p.entity, p.date, case when x.seen is null or p.date - x.seen > 4 then 0 else x.score end as score
             from (select * from doc_panel where date >= date '2024-01-01') p left join lateral (
               select q.date as seen, q.score from (
                 select entity, date, """
        + _SCORE_SQL.replace("text", "lookback")
        + """ as score from text_panel where doc_text <> '无相关公告' and date >= date '2024-01-01') q
               where q.entity = p.entity and q.date <= p.date order by q.date desc limit 1) x on true
             union all
             select entity, date, 0 from (select distinct lpad(cast(user_id as varchar), 6, '0') as entity from events
               where event_type = 'signup' and value > 60) cross join
               (select cast(unnest(generate_series(date '2024-01-01', date '2024-01-23', interval 1 day)) as date) as date))""",
        "doc_text", extra=_TEXT_PANEL,
    ),
)
def plain_scheme_status(spark, sf):
    """Entities that have intervals only are in the panel, with score 0."""
    from watchpanel.plans.rule_track import filled_scores

    signups = table(spark, sf, "events").where((F.col("event_type") == "signup") & (F.col("value") > 60))
    intervals = signups.select(
        cl.normalize_code("user_id").alias("entity"), F.to_date("ts").alias("entry_date"), F.to_date("ts").alias("remove_date")
    )
    df = filled_scores(documents(spark, sf), _document_rules(), make_scorer, intervals=intervals, max_days=4)
    return df.select(*KEYS, F.col("score").cast("double").alias("score"))


# --- four dimensions from documents -----------------------------------------
DIM_WORDS = dict(
    zip(fv.DIMS, (("attion", "License"), ("tion the", "@"), ("worthless", "license"), ("nicht", "que la", "anea")))
)


make_dim_scorer = sc.dim_keyword_answers(DIM_WORDS, 30)


def _points(dim: str, column: str) -> str:
    found = " + ".join(f"(case when contains({column}, '{k}') then 1 else 0 end)" for k in DIM_WORDS[dim])
    return f"least(100, 30 * ({found}))"


def _dim_states() -> tuple[str, dict[str, str]]:
    extra = {
        **_RATED_DAYS,
        "dim_scores": "select entity, date, "
        + ", ".join(f"{_points(d, 'text')} as {d}" for d in fv.DIMS)
        + f" from ({_TASKS_SQL})",
        "doc_days": """
          select e.entity, c.date from (select distinct entity from docs) e cross join
            (select cast(unnest(generate_series(date '2023-12-10', date '2024-01-23', interval 1 day)) as date) as date) c""",
    }
    for d in fv.DIMS:
        extra[f"v_{d}"] = f"select p.entity, p.date, coalesce(s.{d}, 0) as v from doc_days p left join dim_scores s using (entity, date)"
        extra[f"s_{d}"] = f"""
          select entity, date, cast(case when v >= 30 then v else 0 end as double) as s from v_{d} where date = date '2023-12-10'
          union all
          select n.entity, n.date, case when x.s1 < 30 then 0.0 else x.s1 end as s
          from s_{d} m join v_{d} n on n.entity = m.entity and n.date = m.date + 1,
            lateral (select greatest(m.s - 4, 0.0) as s0) a,
            lateral (select case when n.v > 0 and a.s0 > 0 then greatest(a.s0, n.v)
                                 when n.v > 0 and n.v >= 30 then n.v else a.s0 end as s1) x"""
    columns = ", ".join(f"round(s_{d}.s, 4) as {d}" for d in fv.DIMS)
    joins = " ".join(f"join s_{d} using (entity, date)" for d in fv.DIMS)
    return f"select p.entity, p.date, {columns} from doc_days p {joins} where p.date >= date '2024-01-01'", extra


_STATES, _STATE_CTES = _dim_states()


@query("dim_score_panel_from_documents", sql(_STATES, "doc_text", extra=_STATE_CTES))
def dim_panel(spark, sf):
    from watchpanel.plans.model_track import score_dims

    df = score_dims(
        documents(spark, sf), make_dim_scorer, output=DOC_OUTPUT, text=TEXT, prefilter=PREFILTER,
        decay=4.0, threshold=30.0, scorer_parts=8,
    )
    return df.select(*KEYS, *[F.round(F.col(d).cast("double"), 4).alias(d) for d in fv.DIMS])


@query(
    "plain_scheme_four_dims",
    sql(
        "select p.entity, p.date, "
        + ", ".join(f"cast(case when x.seen is null or p.date - x.seen > 4 then 0 else x.{d} end as double) as {d}" for d in fv.DIMS)
        + """ from (select * from doc_panel where date >= date '2024-01-01') p left join lateral (
             select q.* from (
               select entity, date as seen, """
        + ", ".join(f"{_points(d, 'lookback')} as {d}" for d in fv.DIMS)
        + """ from text_panel where doc_text <> '无相关公告' and date >= date '2024-01-01') q
             where q.entity = p.entity and q.seen <= p.date order by q.seen desc limit 1) x on true""",
        "doc_text", extra=_TEXT_PANEL,
    ),
)
def plain_dims(spark, sf):
    from watchpanel.plans.rule_track import filled_scores

    df = filled_scores(
        documents(spark, sf), _document_rules(), make_dim_scorer, dims=fv.DIMS, max_days=4, scorer_parts=8
    )
    return df.select(*KEYS, *[F.col(d).cast("double").alias(d) for d in fv.DIMS])


@query(
    "scoring_summary_by_task",
    sql(
        f"""select count(*) as n_total, count(*) as n_parse_ok, 0 as n_parse_fail, true as one_row_a_task, true as rates_follow
            from ({_TASKS_SQL})""",
        "doc_text", extra=_RATED_DAYS,
    ),
)
def summary_by_task(spark, sf):
    """Totals of each scoring task, added up: which task scores a row depends on the partitioning."""
    tasks = sc.scoring_summary(sc.scoring_results(scored(spark, sf)), by_task=True)
    n, ok = F.col("n_total"), F.col("n_parse_ok")
    return tasks.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("n_total"), F.coalesce(F.sum(ok), F.lit(0)).alias("n_parse_ok"),
        F.coalesce(F.sum("n_parse_fail"), F.lit(0)).alias("n_parse_fail"),
        (F.count_distinct("task") == F.count(F.lit(1))).alias("one_row_a_task"),
        F.coalesce(F.bool_and(F.abs(F.col("parse_ok_rate") - ok / n) < 1e-9), F.lit(True)).alias("rates_follow"),
    )
