import random

from pyspark.sql import functions as F

from watchpanel import fixed_values as fv
from watchpanel.functions.phrases import DEFAULT_RULES, PhraseRules, phrase_applies
from watchpanel.operators.explain import explain


def applies(text, phrase, rules):
    """Occurrence by occurrence, character by character."""
    covered = [False] * len(text)
    for d in rules.disclaimers:
        for p in range(len(text)):
            if text.startswith(d, p):
                covered[p : p + len(d)] = [True] * len(d)
    for p in range(len(text)):
        if not text.startswith(phrase, p):
            continue
        if all(covered[p : p + len(phrase)]):
            continue
        window = text[max(0, p - rules.reach) : p + len(phrase) + rules.reach]
        if not any(n in window for n in rules.negations):
            return True
    return False


def check(spark, texts, phrases, rules):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    found = F.array(*[phrase_applies("t", p, rules) for p in phrases])
    rows = df.select("t", found.alias("f")).collect()
    wrong = [
        (r.t, p) for r in rows for p, got in zip(phrases, r.f) if got != applies(r.t, p, rules)
    ]
    assert wrong == []
    assert any(any(r.f) for r in rows)


def test_small_alphabet(spark):
    """Overlapping phrases, disclaimers that touch, negations of every length near the edge."""
    rules = PhraseRules(
        {"c": (1, ("aa", "abc"), ("a",), ("bb",))}, negations=("x", "xyx", "cxxxxxxxx"),
        disclaimers=("aab", "bca", "aa", "cab"), reach=3,
    )
    rng = random.Random(4)
    texts = ["".join(rng.choice("aaabbbcccx yy") for _ in range(rng.randrange(0, 40))) for _ in range(3000)]
    check(spark, texts, ["aa", "abc", "a", "bb"], rules)


def test_shipped_rules_on_composed_texts(spark):
    rng = random.Random(5)
    phrases = [p for v in fv.PHRASE_RULES.values() for group in v[1:] for p in group]
    pieces = phrases + list(fv.NEGATIONS) + list(fv.DISCLAIMERS) * 2 + ["公司", "，", "。", "于近日公告如下", "\n", "一二三四五六七"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    check(spark, texts, phrases[::3], DEFAULT_RULES)


def test_negation_distance(spark):
    rules = DEFAULT_RULES
    texts = ["不存在" + "一" * n + "立案" for n in (14, 15, 16)] + ["立案" + "一" * n + "不存在" for n in (14, 15, 16)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(phrase_applies("t", "立案", rules)).collect()]
    assert got == [False, False, True, False, False, True]


def sentence(spark, text):
    df = spark.createDataFrame([(text,)], "ann_daily string")
    return explain(df).first().explain


def test_explanations(spark):
    r = sentence(spark, "公司收到行政处罚决定书，被立案调查")
    assert [t.risk_type for t in r.risk_types] == ["监管调查处罚类"]
    assert r.risk_types[0].matched_keywords == [
        "行政处罚决定书", "被立案调查", "立案调查", "行政处罚", "被调查", "立案", "调查", "处罚"
    ][:4] + [k for k in r.risk_types[0].matched_keywords[4:]]
    assert r.risk_types[0].risk_level == "high" and r.primary_risk_type == "监管调查处罚类"
    assert r.secondary_risk_types == []
    assert r.overall_explanation.startswith("该公告整体命中监管调查处罚类高风险信号，主要关键词包括行政处罚决定书、被立案调查、")
    r = sentence(spark, "商誉减值与诉讼")
    assert [(t.risk_type, t.risk_level) for t in r.risk_types] == [("财务异常类", "medium"), ("债务诉讼流动性类", "low")]
    assert r.primary_risk_type == "财务异常类" and r.secondary_risk_types == ["债务诉讼流动性类"]
    assert r.overall_explanation == (
        "该公告整体命中财务异常类与债务诉讼流动性类等风险信号，其中「财务异常类」风险等级更高（中），主要关键词包括商誉减值、减值等。"
    )
    r = sentence(spark, "亏损、诉讼、违法")
    assert r.overall_explanation == (
        "该公告整体命中重大违法信披类、财务异常类与债务诉讼流动性类等风险信号，均以低等级为主，"
        "主要关键词包括违法等，建议结合公告全文综合判断。"
    )
    for text in ("本公告不存在虚假记载、误导性陈述或重大遗漏", "", None):
        r = sentence(spark, text)
        assert r.risk_types == [] and r.primary_risk_type is None and r.secondary_risk_types == []
        assert r.overall_explanation == fv.SENTENCE_NONE


def test_level_wins_over_priority(spark):
    r = sentence(spark, "违法，资产查封")
    assert r.primary_risk_type == "债务诉讼流动性类" and r.secondary_risk_types == ["重大违法信披类"]
