"""The given tables as inputs of the library, in Spark and as common table expressions.

Every row of a table is used.  `events` give four-dimension scores, status intervals and scorer
outputs; `orders` give long overlapping intervals; `documents` give dated documents.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.columns import normalize_code
from watchpanel.functions.phrases import PhraseRules
from watchpanel.params import ModelParams, PrefilterParams, RuleParams, TextParams

START, END = dt.date(2024, 1, 1), dt.date(2024, 1, 30)
OUTPUT = (START, END)
DIM_EVENTS = dict(zip(fv.DIMS, ("error", "click", "view", "purchase")))

KEYWORDS = ("attion", "tion the", "License", "license", "worthless", "@", "nicht", "que la")
TEXT = TextParams(lookback_days=22, keywords=KEYWORDS, sentence_breaks="[.!?;\n\r]+")
PREFILTER = PrefilterParams(
    high=5, medium=3,
    keywords=("license", "attion", "worthless", "thanedble", "anea", "tion", "token", "nicht", "que"),
    category_terms=("the anea", "de la", "und", "@"),
)
RULES = RuleParams(
    output_start=START, output_end=END, decay=5.0, entry=80.0, retain=65.0,
    horizon_days=20, market_n=5400, text=TEXT, prefilter=PREFILTER,
)
MODEL = ModelParams(
    train_start=START, train_end=dt.date(2024, 1, 20),
    predict_start=dt.date(2024, 1, 21), predict_end=END,
    validation_start=dt.date(2024, 1, 15), horizon_days=20,
)
DOC_FIRST, DOC_LAST = dt.date(2023, 12, 10), dt.date(2024, 1, 23)
# the lookback of the first output day reaches the first document
DOC_OUTPUT = (dt.date(2024, 1, 1), DOC_LAST)
USABLE = (dt.date(2023, 12, 20), dt.date(2024, 1, 20))

PHRASES = PhraseRules(
    categories={
        "asset": (3, ("worthless", "Eriner"), ("attion", "license"), ("token",)),
        "audit": (1, ("thanedble",), ("tion the", "nicht"), ("erth",)),
        "debt": (2, ("que la",), ("ouen",), ("lich", "worthless")),
    },
    negations=("not", "sans", "with", "pas"),
    disclaimers=("attion to thanedble the", "to thanedble", "the anea Eriner", "ouen the"),
)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def score_rows(spark: SparkSession, sf: str) -> DataFrame:
    """One four-dimension score row per event."""
    ev = table(spark, sf, "events")
    value = F.least(F.col("value") / F.lit(3.0), F.lit(100.0))
    return ev.select(
        normalize_code("user_id").alias("entity"),
        F.to_date("ts").alias("date"),
        *[
            F.when(F.col("event_type") == kind, value).otherwise(F.lit(0.0)).alias(dim)
            for dim, kind in DIM_EVENTS.items()
        ],
    )


def dim_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Highest value of each dimension per entity and day."""
    return score_rows(spark, sf).groupBy("entity", "date").agg(*[F.max(d).alias(d) for d in fv.DIMS])


def daily_scores(spark: SparkSession, sf: str) -> DataFrame:
    from watchpanel.plans.rule_track import daily_max

    return daily_max(score_rows(spark, sf))


def status_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Five status days from each large signup on."""
    ev = table(spark, sf, "events").where((F.col("event_type") == "signup") & (F.col("value") > 100))
    day = F.to_date("ts")
    return ev.select(
        normalize_code("user_id").alias("entity"),
        day.alias("entry_date"),
        F.date_add(day, 4).alias("remove_date"),
    ).distinct()


def long_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """One interval per order, open while the order is."""
    day = F.to_date("o_orderdate")
    days = (F.floor("o_totalprice") % 400).cast("int")
    return table(spark, sf, "orders").select(
        normalize_code("o_custkey").alias("entity"),
        F.col("o_orderkey").alias("seq"),
        day.alias("entry_date"),
        F.when(F.col("o_orderpriority") != "1-URGENT", F.date_add(day, days)).alias("remove_date"),
        F.col("o_orderpriority").alias("kind"),
    )


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents spread over 45 days, 20 entities."""
    n = F.col("doc_id")
    offset = ((n * 131 + F.floor(n / 7)) % 45).cast("int")
    return table(spark, sf, "documents").select(
        n.alias("id"),
        F.date_add(F.lit(DOC_FIRST), offset).alias("publish_date"),
        F.col("source").alias("entity"),
        F.col("lang").alias("category_name"),
        F.split("text", "\n")[0].alias("title"),
        F.col("text").alias("content"),
    )


def scorer_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """Answers in five forms: prefixed, fenced, out of range, broken, without a score."""
    ev = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    form = F.col("event_id") % 5
    raw = (
        F.when(form == 0, F.concat(F.lit('prefix {"risk_score": '), k, F.lit("} suffix")))
        .when(form == 1, F.concat(F.lit('```json {"risk_score": '), k, F.lit("}```")))
        .when(form == 2, F.concat(F.lit('{"risk_score": '), k, F.lit("99}")))
        .when(form == 3, F.concat(F.lit('{"risk_score": '), k, F.lit(", broken")))
        .otherwise(F.lit("no score"))
    )
    return ev.select(
        F.col("event_id").alias("id"), normalize_code("user_id").alias("entity"),
        F.to_date("ts").alias("date"), raw.alias("raw"),
    )


# ---------------------------------------------------------------------------
# The same as common table expressions
# ---------------------------------------------------------------------------
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def sql_clean(x: str) -> str:
    inner = sql_strip(x)
    inner = f"regexp_replace({inner}, '[ \\t\\r\\f\\v]+', ' ', 'g')"
    inner = f"regexp_replace({inner}, '\\n{{2,}}', chr(10), 'g')"
    return sql_strip(inner)


_CODE = "lpad(cast({} as varchar), cast(greatest(6, length(cast({} as varchar))) as int), '0')"


def sql_code(x: str) -> str:
    return _CODE.format(x, x)


CTES: dict[str, str] = {
    "score_rows": f"""
        select {sql_code('user_id')} as entity, cast(ts as date) as date,
          {', '.join(
              f"case when event_type = '{kind}' then least(value / 3.0, 100.0) else 0.0 end as {dim}"
              for dim, kind in DIM_EVENTS.items())}
        from events""",
    "dims": "select entity, date, "
    + ", ".join(f"max({d}) as {d}" for d in fv.DIMS)
    + " from score_rows group by 1, 2",
    "daily": "select entity, date, greatest(" + ", ".join(fv.DIMS) + ") as score from dims",
    "cal": "select cast(unnest(generate_series(date '2024-01-01', date '2024-01-30', interval 1 day)) as date) as date",
    "panel": "select entity, date from (select distinct entity from score_rows) cross join cal",
    "intervals": f"""
        select distinct {sql_code('user_id')} as entity, cast(ts as date) as entry_date,
          cast(ts as date) + 4 as remove_date
        from events where event_type = 'signup' and value > 100""",
    "status_panel": """
        select p.entity, p.date,
          max(case when i.entity is not null then 1 else 0 end) as y_status
        from panel p left join intervals i
          on p.entity = i.entity and p.date between i.entry_date and i.remove_date
        group by 1, 2""",
    "entries": """
        select entity, date from (
          select *, lag(y_status, 1, y_status) over (partition by entity order by date) as before
          from status_panel)
        where y_status = 1 and before = 0""",
    "dense": "select p.entity, p.date, coalesce(d.score, 0) as v from panel p left join daily d using (entity, date)",
    # day by day, as the definition of the memory says
    "mem": """
        select entity, date, v, case when v >= 80 then v else 0.0 end as s
        from dense where date = date '2024-01-01'
        union all
        select d.entity, d.date, d.v,
          case when x.s1 < 65 then 0.0 else x.s1 end as s
        from mem m join dense d on d.entity = m.entity and d.date = m.date + 1,
          lateral (select greatest(m.s - 5, 0.0) as s0) a,
          lateral (select case when d.v > 0 and a.s0 > 0 then greatest(a.s0, d.v)
                               when d.v > 0 and d.v >= 80 then d.v else a.s0 end as s1) x""",
    "alive": "select entity, date, s as score from mem where s >= 65",
    "listed": "select a.* from alive a join status_panel p using (entity, date) where p.y_status = 0",
    # for each listed day: where its run starts, and the first day after it that is not listed
    "run_days": """
        select l.entity, l.date,
          max(s.date) as start_date, min(g.date) as next_day
        from listed l
        join (select a.entity, a.date from listed a left join listed b
                on a.entity = b.entity and b.date = a.date - 1 where b.entity is null) s
          on s.entity = l.entity and s.date <= l.date
        join (select a.entity, a.date + 1 as date from listed a left join listed b
                on a.entity = b.entity and b.date = a.date + 1 where b.entity is null) g
          on g.entity = l.entity and g.date > l.date
        group by 1, 2""",
    "correct": """
        select r.entity, r.date, r.start_date, r.next_day as event_date
        from run_days r join entries e on e.entity = r.entity and e.date = r.next_day
        where r.next_day - r.start_date between 1 and 20""",
    "day_counts": """
        select c.date,
          (select count(*) from listed l where l.date = c.date) as listed_cnt,
          (select count(*) from correct k where k.date = c.date) as correct_cnt,
          (select count(*) from status_panel s where s.date = c.date and y_status = 1) as status_cnt
        from cal c""",
    "day_metrics": """
        select *, case when listed_cnt > 0 then correct_cnt / listed_cnt end as daily_acc,
          case when 5400 - status_cnt - correct_cnt > 0
               then (listed_cnt - correct_cnt) / (5400 - status_cnt - correct_cnt) end as daily_fpr
        from day_counts""",
    "urgency": """
        select s.entity, s.date, s.y_status,
          case when s.y_status = 1 then null
               else coalesce(1.0 / (min(i.entry_date) - s.date), 0) end as label
        from status_panel s left join intervals i
          on i.entity = s.entity and i.entry_date > s.date
        group by 1, 2, 3""",
    "long_intervals": f"""
        select {sql_code('o_custkey')} as entity, o_orderkey as seq,
          cast(o_orderdate as date) as entry_date,
          case when o_orderpriority <> '1-URGENT'
               then cast(o_orderdate as date) + cast(floor(o_totalprice) % 400 as int) end as remove_date,
          o_orderpriority as kind
        from orders""",
    # a row opens a group unless an earlier row (entry day, then seq) of the entity reaches its entry day
    "long_marked": """
        select *, coalesce(remove_date, date '2099-12-31') as until,
          max(coalesce(remove_date, date '2099-12-31')) over (
            partition by entity order by entry_date, seq
            rows between unbounded preceding and 1 preceding) as reached
        from long_intervals""",
    "long_grouped": """
        select *, sum(case when reached is null or entry_date > reached then 1 else 0 end)
            over (partition by entity order by entry_date, seq) as g
        from long_marked""",
    "long_merged": """
        select entity, min(entry_date) as entry_date, max(until) as remove_date,
          arg_min(seq, (entry_date, seq)) as seq, arg_min(kind, (entry_date, seq)) as kind
        from long_grouped group by entity, g""",
    "docs": """
        select doc_id as id,
          date '2023-12-10' + cast((doc_id * 131 + doc_id // 7) % 45 as int) as publish_date,
          source as entity, lang as category_name, split_part(text, chr(10), 1) as title,
          text as content
        from documents""",
    "used_docs": f"""
        select id, entity, publish_date as date, {sql_clean('title')} as title,
          {sql_clean('category_name')} as category_name, content
        from docs where {sql_clean('title')} <> '' and {sql_clean('category_name')} <> ''""",
    "kept_docs": """
        select * from (select *, row_number() over (partition by entity, date order by id) as rank from used_docs)
        where rank <= 3""",
    "keyed_docs": f"""
        select id, entity, date, rank, title, category_name,
          case when length(c) <= 300 then c
               when len(picked) > 0 then substring(array_to_string(picked, '；'), 1, 300)
               when len(sents) = 0 then substring(c, 1, 300)
               else substring({sql_strip('substring(c, 1, 150)')} ||
                 case when {sql_strip('right(c, 150)')} <> '' then '…' || {sql_strip('right(c, 150)')} else '' end,
                 1, 300) end as key
        from (select *, list_slice(list_filter(rel, lambda x, i: list_position(rel, x) = i), 1, 3) as picked
          from (select *, list_filter(sents, lambda x: length(x) >= 8 and (
                  {' or '.join(f"contains(x, '{k}')" for k in KEYWORDS)})) as rel
            from (select *, list_filter(list_transform(string_split_regex(c, '[.!?;\\n\\r]+'),
                    lambda x: {sql_strip('x')}), lambda x: x <> '') as sents
              from (select *, {sql_clean('content')} as c from SOURCE_DOCS))))""",
    "doc_lines": """
        select entity, date, rank,
          substring(category_name || '：' || substring(title, 1, 60) ||
            case when key <> '' then '；正文要点：' || key else '' end, 1, 220) as line
        from keyed_docs""",
    "doc_text": """
        select entity, date, string_agg(line, '；' order by rank) as doc_text
        from doc_lines group by 1, 2""",
    "outputs": f"""
        select event_id as id, {sql_code('user_id')} as entity, cast(ts as date) as date,
          cast(json_extract_string(props, '$.k') as int) as k,
          case event_id % 5
            when 0 then 'prefix {{"risk_score": ' || json_extract_string(props, '$.k') || '}} suffix'
            when 1 then '```json {{"risk_score": ' || json_extract_string(props, '$.k') || '}}```'
            when 2 then '{{"risk_score": ' || json_extract_string(props, '$.k') || '99}}'
            when 3 then '{{"risk_score": ' || json_extract_string(props, '$.k') || ', broken'
            else 'no score' end as raw
        from events""",
    "parsed": r"""
        select id, entity, date, raw,
          coalesce(least(greatest(try_cast(regexp_extract(raw, '"risk_score"\s*:\s*(-?\d+)', 1) as int), 0), 100), 0) as risk_score,
          regexp_matches(raw, '"risk_score"\s*:\s*(-?\d+)') as parse_ok
        from outputs""",
    "users": "select distinct entity from score_rows",
}
CTES["keyed_docs_all"] = (
    CTES["keyed_docs"].replace("SOURCE_DOCS", "(select *, 0 as rank, publish_date as date from docs)")
)
CTES["keyed_docs"] = CTES["keyed_docs"].replace("SOURCE_DOCS", "kept_docs")

_NEEDS = {
    "dims": ["score_rows"],
    "daily": ["dims"],
    "users": ["score_rows"],
    "panel": ["score_rows", "cal"],
    "status_panel": ["panel", "intervals"],
    "entries": ["status_panel"],
    "dense": ["panel", "daily"],
    "mem": ["dense"],
    "alive": ["mem"],
    "listed": ["alive", "status_panel"],
    "run_days": ["listed"],
    "correct": ["run_days", "entries"],
    "day_counts": ["cal", "listed", "correct", "status_panel"],
    "day_metrics": ["day_counts"],
    "urgency": ["status_panel", "intervals"],
    "long_marked": ["long_intervals"],
    "long_grouped": ["long_marked"],
    "long_merged": ["long_grouped"],
    "used_docs": ["docs"],
    "kept_docs": ["used_docs"],
    "keyed_docs": ["kept_docs"],
    "keyed_docs_all": ["docs"],
    "doc_lines": ["keyed_docs"],
    "doc_text": ["doc_lines"],
    "parsed": ["outputs"],
}


def sql(select: str, *needs: str, extra: dict[str, str] | None = None) -> str:
    """A statement with the common table expressions it needs, in order."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in _NEEDS.get(name, ()):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in needs:
        add(name)
    parts = [f"{n} as ({CTES[n]})" for n in ordered]
    parts += [f"{n} as ({body})" for n, body in (extra or {}).items()]
    return ("with recursive " + ",\n".join(parts) + "\n" if parts else "") + select
