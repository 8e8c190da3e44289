import datetime as dt

from pyspark.sql import functions as F

from watchpanel.functions import columns as cl
from watchpanel.functions import outputs as op
from watchpanel.functions import text as tx
from watchpanel.params import PrefilterParams, TextParams


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.withColumn("y", expression).orderBy("i").select("y").collect()]


def test_codes(spark):
    given = [None, " 000001.SZ ", "1", "1.0", "1234567", "ABC", "", "　12　", "600.1.2"]
    want = ["", "000001", "000001", "000001", "1234567", "ABC", "", "000012", "000600"]
    assert column(spark, given, cl.normalize_code("x")) == want
    assert column(spark, ["1.5", "12"], cl.normalize_code("x", cut=False)) == ["1.5", "000012"]
    assert column(spark, ["1.5", "12"], cl.normalize_code("x", pad=False)) == ["1", "12"]


def test_dates(spark):
    given = ["2024-01-31", "2024/1/5", "20240131", "2024-01-31 10:11:12", "x", None, "2024-13-01"]
    want = [dt.date(2024, 1, 31), dt.date(2024, 1, 5), dt.date(2024, 1, 31), dt.date(2024, 1, 31)] + [None] * 3
    assert column(spark, given, cl.parse_mixed_date("x")) == want
    given = ["20240131.0", "20240131", "", None, "2024", "20240230"]
    want = [dt.date(2024, 1, 31)] * 2 + [None] * 4
    assert column(spark, given, cl.parse_yyyymmdd("x")) == want


def test_numbers(spark):
    given = ["5", "bad", None, "-3", "120", "nan"]
    assert column(spark, given, cl.coerce_score("x")) == [5, 0, 0, 0, 100, 0]
    assert column(spark, given, cl.coerce_score("x", clip=False)) == [5, 0, 0, -3, 120, 0]
    assert column(spark, [None, -1.0, 0.5, 3.0], cl.clip_unit("x"), "double") == [None, 0, 0.5, 1]
    values = [79.9, -1.5, float("nan"), float("inf"), None, 3e9, -3e9, 1e30]
    assert column(spark, values, cl.int_score("x"), "double") == [79, -1, 0, 0, 0, 3 * 10**9, -3 * 10**9, 2**63 - 1]


def test_clean_text(spark):
    given = [None, " NaN ", "a \t b\n\n\nc ", "　x　y　", "a\r\nb", "  ", "a  b"]
    want = ["", "", "a b\nc", "x　y", "a \nb", "", "a b"]
    assert column(spark, given, tx.clean_text("x")) == want


def _key_loop(content, keywords, n=3, chars=300, least=8):
    """Sentence by sentence, for texts that are clean already."""
    import re

    if len(content) <= chars:
        return content
    sents = [s.strip() for s in re.split("[。！？；\n\r]+", content) if s.strip()]
    if not sents:
        return content[:chars]
    picked = []
    for s in sents:
        if len(s) >= least and s not in picked and any(k in s for k in keywords):
            picked.append(s)
        if len(picked) == n:
            break
    if picked:
        return "；".join(picked)[:chars]
    head, tail = content[: chars // 2].strip(), content[-(chars // 2) :].strip()
    return (head + "…" + tail if tail else head)[:chars]


def test_key_sentences(spark):
    import random

    rng = random.Random(3)
    words = ["立案", "调查。", "公司", "；", "ST", "经营情况说明", "！", "a b", "担保事项", "。", "　", "无"]
    texts = ["x" * 300, "。" * 301, "字" * 400, "立案调查一二三四。" * 60, "立案七字句子哈。" * 50]
    texts += ["".join(rng.choice(words) for _ in range(rng.randrange(60, 260))) for _ in range(300)]
    texts = [t.strip() for t in texts]
    params = TextParams(keywords=("立案", "ST", "担保"))
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    got = [r.y for r in tx.with_key_sentences(df, "x", "y", params).orderBy("i").collect()]
    assert got == [_key_loop(t, params.keywords) for t in texts]


def test_document_line_and_tail(spark):
    df = spark.createDataFrame([("类", "题" * 70, "要点"), ("类", "题", "")], "c string, t string, k string")
    got = [r[0] for r in df.select(tx.document_line("c", "t", "k")).collect()]
    assert got == ["类：" + "题" * 60 + "；正文要点：要点", "类：题"]
    assert column(spark, ["abcdef", "abc", None], tx.keep_tail("x", 3, "~")) == ["~def", "abc", ""]


def test_prefilter(spark):
    texts = [None, "无相关公告", "*ST abc st 退市风险", "公司收到立案调查与行政处罚", "平静" * 300 + "立案"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    rows = tx.with_prefilter(df, "x", PrefilterParams()).orderBy("i").collect()
    # *ST, st, 退市 (which shadows 退市风险) are three, the category term and the density two each
    assert [(r.filter_label, r.filter_score) for r in rows[:3]] == [("LOW", 0), ("LOW", 0), ("HIGH", 7)]
    assert rows[3].filter_score == 3 + 2 + 2 and rows[4].filter_score == 1
    long = spark.createDataFrame([(0, "平" * 1300 + "立案")], "i int, x string")
    assert tx.with_prefilter(long, "x").first().filter_score == 1
    prefix = tx.with_prefilter(long, "x", PrefilterParams(scan_chars=1200)).first()
    assert prefix.filter_score == 0


def test_score_parsing(spark):
    fence = "```"
    cases = {
        '{"risk_score": 85.7}': (85, True),
        '{"risk_score": "85"}': (85, True),
        '{"risk_score": "85.7"}': (0, False),
        '{"risk_score": true}': (1, True),
        '{"risk_score": null}': (0, False),
        '{"other": 3}': (0, True),
        'a {"risk_score": 7} b': (7, True),
        '{"a": 1} and {"risk_score": 12}': (12, True),
        '{"risk_score": 099}': (99, True),
        '{"risk_score": -5}': (0, True),
        '{"risk_score": 1e3}': (100, True),
        '{"risk_score": 44, broken': (44, True),
        f'{fence}json\n{{"risk_score": 9}}\n{fence}': (9, True),
        "none": (0, False),
        "": (0, False),
        None: (0, False),
    }
    df = spark.createDataFrame([(i, k) for i, k in enumerate(cases)], "i int, raw string")
    rows = op.with_parsed_score(df, "raw").orderBy("i").collect()
    assert {r.raw: (r.risk_score, r.parse_ok) for r in rows} == cases
    errors = {r.raw: r.parse_error for r in rows}
    assert errors[None] == "empty_output" and errors["none"] == "no_json_found"
    assert errors['{"risk_score": null}'] == "json_load_failed" and errors["a {\"risk_score\": 7} b"] is None


def test_four_scores_all_or_nothing(spark):
    good = '{"financial_risk": 10, "normative_risk": "20", "illegal_risk": 130}'
    bad = '{"financial_risk": 10, "normative_risk": [1]}'
    df = spark.createDataFrame([(0, good), (1, bad), (2, '"financial_risk": 3')], "i int, raw string")
    rows = op.with_parsed_dims(df, "raw").orderBy("i").collect()
    values = [(r.financial_risk, r.normative_risk, r.illegal_risk, r.other_risk, r.parse_ok) for r in rows]
    assert values == [(10, 20, 100, 0, True), (0, 0, 0, 0, False), (0, 0, 0, 0, False)]


def test_strip_handles_all_spaces(spark):
    assert column(spark, ["　 a\x1f", "b", None], cl.strip(F.col("x"))) == ["a", "b", None]
