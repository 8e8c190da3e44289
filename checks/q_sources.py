"""Readers and writers: given tables written in an exchange format and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.data import END, OUTPUT, START, dim_scores, documents, long_intervals, score_rows, sql, sql_code, table
from checks.q_rules import LISTED_SQL, OVERALL_SQL, r6, result
from checks.registry import query
from watchpanel import fixed_values as fv
from watchpanel.operators import panel as pn
from watchpanel.operators import watchlist as wl
from watchpanel.sources import readers as rd
from watchpanel.sources import writers as wr
from watchpanel.sources.storage import scratch_path

KEYS = pn.KEYS


def _announcement_files(spark, sf) -> str:
    """Documents as one CSV folder per year under the incoming headers."""
    base = scratch_path(spark, "documents")
    docs = documents(spark, sf).select(
        F.col("id").cast("string").alias("id"),
        F.date_format("publish_date", "yyyy/M/d").alias("publish_date"),
        "title", F.lit("feed").alias("source"), F.lit(1).alias("has_full_text"), "content", "entity",
        F.col("entity").alias("entity_name"), F.lit("c").alias("category_code"), "category_name",
        F.lit("1").alias("level"), F.year("publish_date").alias("_year"),
    )
    for year in (2023, 2024):
        rows = docs.where(F.col("_year") == year)
        wr.write_csv(
            rows.select(*[F.col(new).alias(old) for old, new in fv.DOCUMENT_COLUMNS.items()]),
            f"{base}/announcements_{year}.csv",
        )
    return base


_PERIOD = dict(output_start=dt.date(2024, 1, 1), output_end=dt.date(2024, 1, 20))


@query(
    "scan_documents_by_year",
    sql(
        """select id, publish_date as date, entity, category_name, length(title) as title_chars,
             length(content) as chars, hash_ok from (select *, true as hash_ok from docs)""",
        "docs",
    ),
)
def scan_documents(spark, sf):
    """All years of the period; the text comes back as it was written."""
    df = rd.scan_documents(spark, _announcement_files(spark, sf), lookback_days=60, **_PERIOD)
    original = documents(spark, sf).select(F.col("id"), F.xxhash64("content").alias("_h"))
    joined = df.withColumn("id", F.col("id").cast("bigint")).join(original, "id")
    return joined.select(
        "id", F.to_date("publish_date").alias("date"), "entity", "category_name",
        F.length(F.coalesce("title", F.lit(""))).cast("bigint").alias("title_chars"),
        F.length("content").cast("bigint").alias("chars"),
        (F.xxhash64("content") == F.col("_h")).alias("hash_ok"),
    )


@query(
    "scan_documents_pruned_years",
    sql("select year(publish_date) as year, count(*) as n from docs where publish_date >= date '2024-01-01' group by 1", "docs"),
)
def scan_pruned(spark, sf):
    """A period without lookback into the year before opens one year only."""
    df = rd.scan_documents(spark, _announcement_files(spark, sf), lookback_days=0, **_PERIOD)
    return df.groupBy(F.year("publish_date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_documents_head_sample",
    sql("select year(publish_date) as year, least(count(*), 25) as n from docs group by 1", "docs"),
)
def scan_head(spark, sf):
    """The sampling option: first rows of each year."""
    df = rd.scan_documents(spark, _announcement_files(spark, sf), lookback_days=60, head=25, **_PERIOD)
    return df.groupBy(F.year("publish_date").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "scan_landed_documents",
    sql("select id, publish_date, entity, length(content) as chars from docs where publish_date >= date '2024-01-01'", "docs"),
)
def scan_landed(spark, sf):
    path = scratch_path(spark, "landed")
    rd.land_documents(documents(spark, sf), path)
    df = rd.scan_landed_documents(spark, path, lookback_days=0, **_PERIOD)
    return df.select("id", "publish_date", "entity", F.length("content").cast("bigint").alias("chars"))


@query(
    "scan_status_intervals",
    sql(
        f"""select {sql_code('o_custkey')} as entity, entry_date, remove_date, kind, count(*) as n
            from long_intervals join orders on o_orderkey = seq group by 1, 2, 3, 4""",
        "long_intervals",
    ),
)
def scan_intervals(spark, sf):
    """Codes with an exchange suffix, dates as numbers, blank open ends; second candidate path exists."""
    path = scratch_path(spark, "intervals")
    rows = long_intervals(spark, sf).select(
        F.concat("entity", F.lit(".SZ")).alias("s_info_windcode"),
        F.date_format("entry_date", "yyyyMMdd").alias("entry_dt"),
        F.concat(F.date_format("remove_date", "yyyyMMdd"), F.lit(".0")).alias("remove_dt"),
        F.col("kind").alias("s_type_st"),
    )
    wr.write_csv(rows, path)
    df = rd.scan_status_intervals(spark, [path + "-elsewhere", path])
    return df.groupBy("entity", "entry_date", "remove_date", "kind").agg(F.count(F.lit(1)).alias("n"))


_REAL = ", ".join(f"round(cast(cast({d} as real) as double), 3) as {d}" for d in fv.DIMS)


@query("scan_dim_scores", sql(f"select entity, date, {_REAL} from dims where date <= date '2024-01-20'", "dims"))
def scan_scores(spark, sf):
    path = scratch_path(spark, "scores")
    rows = dim_scores(spark, sf).select(
        F.col("entity").cast("int").cast("string").alias("stock_code"), "date", *fv.DIMS
    )
    wr.write_csv(rows, path)
    df = rd.scan_dim_scores(spark, path, START, dt.date(2024, 1, 20))
    return df.select(*KEYS, *[F.round(F.col(d).cast("double"), 3).alias(d) for d in fv.DIMS])


NATIONS = [str(n) for n in range(25)]
_LABELS = """
  select lpad(cast(n.n as varchar), 6, '0') as entity, d.date, 1 as label_in_file,
    case when v.v is null then 1 else 0 end as y_label_empty,
    case when v.v is not null then least(v.v, 1.0) end as y_label_value
  from (select unnest(range(25)) as n) n
  cross join (select distinct cast(o_orderdate as date) as date from orders
              where o_orderdate between date '1996-01-01' and date '1997-12-31') d
  left join (select cast(o_orderdate as date) as date, c_nationkey, round(max(floor(o_totalprice)) / 400000, 7) as v
             from orders join customer on o_custkey = c_custkey group by 1, 2) v
    on v.date = d.date and v.c_nationkey = n.n"""


def _matrix_file(spark, sf) -> str:
    """Days x nations: largest order of the day as a share; blank without orders."""
    path = scratch_path(spark, "labels")
    orders = table(spark, sf, "orders").join(
        table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    wide = (
        orders.groupBy(F.to_date("o_orderdate").alias("date"))
        .pivot("c_nationkey", list(range(25)))
        .agg(F.round(F.max(F.floor("o_totalprice")) / 400000, 7))
    )
    wr.write_csv(wide, path)
    return path


@query(
    "scan_label_matrix",
    sql("select entity, date, label_in_file, y_label_empty, round(y_label_value, 7) as y_label_value from labels_", extra={"labels_": _LABELS}),
)
def scan_matrix(spark, sf):
    df = rd.scan_label_matrix(spark, _matrix_file(spark, sf), dt.date(1996, 1, 1), dt.date(1997, 12, 31))
    return df.select(*KEYS, "label_in_file", "y_label_empty", F.round("y_label_value", 7).alias("y_label_value"))


@query(
    "daily_watchlist_document_by_line",
    sql("select entity, date from listed", "listed"),
)
def watchlist_document(spark, sf):
    """Exchange document written with a line per day and read back line by line."""
    path = scratch_path(spark, "watchlist")
    days = wl.daily_arrays(result(spark, sf).watchlist(), START, END)
    wr.write_document(days, "entities", path)
    return rd.scan_daily_watchlist(spark, path, *OUTPUT, by_line=True)


def _one_file(spark, days, element, layout: str) -> str:
    """A document `{day: list}` as one file: indented over many lines, or all on one."""
    path = scratch_path(spark, f"document-{layout}")
    text = F.to_json(F.create_map(F.col("date").cast("string"), element), {"pretty": str(layout == "indented").lower(), "ignoreNullFields": "false"})
    # the pair of each day without its own braces
    pair = F.regexp_replace(F.regexp_replace(text, r"^\s*\{", ""), r"\}\s*$", "")
    ordered = days.select("date", pair.alias("pair")).agg(F.array_sort(F.collect_list(F.struct("date", "pair"))).alias("all"))
    whole = F.array_join(F.transform("all", lambda x: x["pair"]), ",")
    # a small fixture: a reference document is one file
    ordered.select(F.concat(F.lit("{"), whole, F.lit("}")).alias("value")).write.text(path)
    return path


@query("daily_watchlist_document", sql("select entity, date from listed", "listed"))
def watchlist_one_file(spark, sf):
    """A document in the incoming layout: one object in one file, indented."""
    days = wl.daily_arrays(result(spark, sf).watchlist(), START, END)
    return rd.scan_daily_watchlist(spark, _one_file(spark, days, F.col("entities"), "indented"), *OUTPUT)


@query(
    "reasoned_watchlist_one_file",
    sql(
        """select date, cast(row_number() over (partition by date order by score desc, entity) as int) as rank, entity,
             cast(trunc(score) as bigint) as risk_score, 0 as is_st,
             'a "{[,]}" \\ of ' || entity as ann_daily from listed""",
        "listed",
    ),
)
def reasoned_one_file(spark, sf):
    """The same with reasons that hold brackets, commas, quotes and backslashes, all on one line."""
    from checks.q_rules import panel_of

    texts = panel_of(spark, sf).withColumn(
        "doc_text", F.concat(F.lit('a "{[,]}" \\ of '), "entity")
    )
    days = wl.daily_arrays(result(spark, sf).reasoned(texts), START, END, element=wl.reason_struct())
    return rd.scan_reasoned_watchlist(spark, _one_file(spark, days, F.col("entities"), "line"))


@query(
    "scan_documents_one_file",
    sql(
        "select id, publish_date as date, entity, length(content) as chars, sha256(content) as sha from docs",
        "docs",
    ),
)
def scan_documents_one_file(spark, sf):
    """All documents of the period in one CSV file for each year, read by byte ranges."""
    base = scratch_path(spark, "one-file")
    docs = documents(spark, sf).withColumn("_year", F.year("publish_date"))
    for year in (2023, 2024):
        rows = docs.where(F.col("_year") == year).select(
            F.col("id").cast("string").alias("id"), F.date_format("publish_date", "yyyy/M/d").alias("publish_date"),
            "title", F.lit("feed").alias("source"), F.lit(1).alias("has_full_text"), "content", "entity",
            F.col("entity").alias("entity_name"), F.lit("c").alias("category_code"), "category_name", F.lit("1").alias("level"),
        )
        # an incoming year is one file
        named = rows.select(*[F.col(new).alias(old) for old, new in fv.DOCUMENT_COLUMNS.items()])
        wr.write_csv_file(named, f"{base}/announcements_{year}.csv")
    df = rd.scan_documents(spark, base, lookback_days=60, **_PERIOD)
    return df.select(
        F.col("id").cast("bigint").alias("id"), F.to_date("publish_date").alias("date"), "entity",
        F.length("content").cast("bigint").alias("chars"), F.sha2("content", 256).alias("sha"),
    )


@query("daily_watchlist_rows", sql("select entity, date from listed", "listed"))
def watchlist_rows(spark, sf):
    """Row form: one object per day and list part."""
    path = scratch_path(spark, "watchlist-rows")
    wr.write_day_objects(wl.daily_arrays(result(spark, sf).watchlist(), START, END, part_size=5), path)
    return rd.scan_watchlist_rows(spark, path, *OUTPUT)


@query(
    "reasoned_watchlist_document",
    sql(
        """select date, cast(row_number() over (partition by date order by score desc, entity) as int) as rank, entity,
             cast(trunc(score) as bigint) as risk_score, 0 as is_st, '无相关公告' as ann_daily from listed""",
        "listed",
    ),
)
def reasoned_document(spark, sf):
    path = scratch_path(spark, "reasoned")
    nothing = score_rows(spark, sf).select(*KEYS).distinct().withColumn("doc_text", F.lit(""))
    rows = result(spark, sf).reasoned(nothing)
    days = wl.daily_arrays(rows, START, END, element=wl.reason_struct())
    wr.write_document(days, "entities", path)
    return rd.scan_reasoned_watchlist(spark, path, by_line=True)


@query(
    "nonzero_score_counts",
    sql(
        "select count(*) as rows, count(*) filter (" + " or ".join(f"{d} > 0" for d in fv.DIMS) + ") as nonzero_rows from score_rows",
        "score_rows",
    ),
)
def nonzero_counts(spark, sf):
    return rd.nonzero_counts(score_rows(spark, sf))


@query(
    "peek_nonzero_scores",
    sql(
        "select entity, date, " + ", ".join(f"round({d}, 6) as {d}" for d in fv.DIMS)
        + " from dims where " + " or ".join(f"{d} > 0" for d in fv.DIMS) + " order by entity, date limit 20",
        "dims",
    ),
)
def peek(spark, sf):
    return rd.peek_nonzero(dim_scores(spark, sf)).select(*KEYS, *[r6(d) for d in fv.DIMS])


@query("metrics_json", OVERALL_SQL)
def metrics_json(spark, sf):
    latest, run = scratch_path(spark, "metrics"), scratch_path(spark, "run")
    wr.write_metrics(result(spark, sf).evaluation.metrics, latest, run)
    m = spark.read.json(run)
    return m.select(r6("acc"), r6("fpr"), r6("avg_list_size"), "total_events", "hit_events", r6("recall"))


@query(
    "daily_statistics_csv",
    sql("select date, listed_cnt, correct_cnt, status_cnt from day_metrics", "day_metrics"),
)
def daily_csv(spark, sf):
    path = scratch_path(spark, "daily")
    wr.write_csv(result(spark, sf).evaluation.daily, path)
    back = spark.read.csv(path, header=True)
    return back.select(
        F.to_date("date").alias("date"),
        *[F.col(c).cast("bigint").alias(c) for c in ("listed_cnt", "correct_cnt", "status_cnt")],
    )


@query(
    "dim_score_panel_csv",
    sql(
        "select p.entity, p.date, "
        + ", ".join(f"round(coalesce({d}, 0), 6) as {d}" for d in fv.DIMS)
        + " from panel p left join dims using (entity, date) where p.date between date '2024-01-05' and date '2024-01-25'",
        "panel", "dims",
    ),
)
def score_panel_csv(spark, sf):
    from checks.q_rules import panel_of

    path = scratch_path(spark, "score-panel")
    filled = pn.fill_panel(panel_of(spark, sf), dim_scores(spark, sf), {d: 0.0 for d in fv.DIMS})
    wr.write_dim_scores(filled, path, dt.date(2024, 1, 5), dt.date(2024, 1, 25))
    df = rd.scan_dim_scores(spark, path, clip=False)
    return df.select(*KEYS, *[r6(d) for d in fv.DIMS])


@query("scoring_results_json", sql("select id, entity, date, risk_score, parse_ok from parsed", "parsed"))
def results_json(spark, sf):
    from checks.data import scorer_outputs
    from watchpanel.functions.outputs import with_parsed_score

    path = scratch_path(spark, "results")
    wr.write_json_rows(
        with_parsed_score(scorer_outputs(spark, sf), "raw").select("id", *KEYS, "risk_score", "parse_ok"), path
    )
    schema = "id bigint, entity string, date date, risk_score int, parse_ok boolean"
    return spark.read.schema(schema).json(path)


@query(
    "interval_json",
    sql("select entity, entry_date, remove_date, seq, kind from long_merged", "long_merged"),
)
def interval_json(spark, sf):
    from watchpanel.operators.intervals import merge_intervals

    path = scratch_path(spark, "interval-json")
    wr.write_json_rows(merge_intervals(long_intervals(spark, sf), "seq"), path)
    return spark.read.schema("entity string, entry_date date, remove_date date, seq bigint, kind string").json(path)


@query(
    "label_document_json",
    sql("select entity, date, round(label, 6) as label from urgency", "urgency"),
)
def label_document(spark, sf):
    from checks.data import status_intervals
    from checks.q_rules import status_panel
    from watchpanel.operators.intervals import urgency_labels

    path = scratch_path(spark, "label-json")
    labels = urgency_labels(status_panel(spark, sf), status_intervals(spark, sf)).withColumn(
        "empty", (F.col("y_status") == 1).cast("int")
    )
    wr.write_day_objects(wl.label_maps(wl.label_rows(labels, "label", "empty"), part_size=60), path)
    back = spark.read.schema("date date, part int, labels map<string,double>").json(path)
    return back.select("date", F.explode("labels").alias("entity", "label")).select(*KEYS, r6("label"))


@query("watchlist_ranked_parquet", LISTED_SQL)
def ranked_parquet(spark, sf):
    """The stored form of a watchlist: rows by day."""
    path = scratch_path(spark, "ranked")
    result(spark, sf).watchlist().write.mode("overwrite").partitionBy("date").parquet(path)
    df = spark.read.parquet(path)
    return df.select(F.col("date").cast("date").alias("date"), "rank", F.col("entity").cast("string").alias("entity"), r6("score"))
