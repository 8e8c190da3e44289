"""Names, word lists and message formats that results depend on.

Everything here is data, not logic.  All of it can be replaced through function
arguments; these are only the defaults.
"""

# ---------------------------------------------------------------------------
# Text marks
# ---------------------------------------------------------------------------
NO_DOCUMENT = "无相关公告"
JOINER = "；"
ELLIPSIS = "…"
TRUNCATED_MARK = "…(省略前文)…"
SENTENCE_BREAKS = "[。！？；\n\r]+"

# ---------------------------------------------------------------------------
# Column headers of the incoming files
# ---------------------------------------------------------------------------
DOCUMENT_COLUMNS = {
    "公告标识ID": "id",
    "公告日期": "publish_date",
    "标题": "title",
    "来源": "source",
    "是否有全文": "has_full_text",
    "全文内容": "content",
    "市场代码": "entity",
    "证券简称": "entity_name",
    "分类代码": "category_code",
    "分类名称": "category_name",
    "层级数": "level",
}

STATUS_COLUMNS = {
    "s_info_windcode": "entity",
    "entry_dt": "entry_date",
    "remove_dt": "remove_date",
    "s_type_st": "kind",
}

# Cells that stand for a missing value in the incoming CSV files
MISSING_CELLS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

DIMS = ("financial_risk", "normative_risk", "illegal_risk", "other_risk")

# ---------------------------------------------------------------------------
# Risk keywords of the rule track
# ---------------------------------------------------------------------------
RULE_KEYWORDS = (
    "ST", "*ST", "退市", "退市风险", "终止上市", "暂停上市", "恢复上市",
    "重大违法", "立案", "调查", "监管", "处罚", "行政处罚", "纪律处分",
    "问询", "关注函", "监管函", "纪律", "自律监管",
    "亏损", "净利润为负", "扣非为负", "营收下降", "收入下降",
    "减值", "商誉减值", "资产减值", "信用减值",
    "违约", "逾期", "欠款", "无法偿还", "流动性",
    "诉讼", "仲裁", "执行", "强制执行", "冻结", "查封",
    "担保", "违规担保", "占用", "资金占用",
    "审计", "无法表示意见", "保留意见", "否定意见", "强调事项",
    "重大风险", "持续经营", "存在不确定性",
    "重整", "破产", "清算",
    "财务造假", "虚假记载", "重大遗漏",
)

# ---------------------------------------------------------------------------
# Risk keywords of the model track
# ---------------------------------------------------------------------------
MODEL_KEYWORDS = (
    "ST", "*ST", "退市", "退市风险", "终止上市", "暂停上市", "恢复上市",
    "违法", "立案", "调查", "监管", "处罚", "违纪", "处分",
    "问询", "关注函", "监管函", "纪律", "停牌",
    "亏损", "净利润", "扣非为负", "营收下降", "收入下降",
    "减值", "商誉减值", "资产减值", "信用减值", "安全",
    "违约", "逾期", "欠款", "无法偿还", "流动性",
    "诉讼", "仲裁", "执行", "强制执行", "冻结", "查封",
    "担保", "违规", "占用", "整改",
    "审计", "意见", "保留意见", "否定意见", "强调", "经营",
    "重整", "破产", "清算", "股份", "清偿",
    "造假", "遗漏", "营业额", "风险", "资产", "资金",
    "财报", "信息披露", "股东",
    "依法", "受理", "欺诈", "虚假", "瞒", "否定",
    "失信", "不达标", "不确定",
    "解散", "强制",
    "严重", "重大",
)

# ---------------------------------------------------------------------------
# Category terms that add weight in the prefilter
# ---------------------------------------------------------------------------
CATEGORY_TERMS = (
    "风险提示", "退市风险", "ST风险", "警示公告", "特别处理", "风险警示",
    "重大事项", "业绩预告", "业绩修正", "诉讼", "调查", "处罚", "监管", "异常波动",
)

# ---------------------------------------------------------------------------
# Phrase rules for explanations.
# category -> (priority, strong phrases, medium phrases, weak phrases)
# ---------------------------------------------------------------------------
PHRASE_RULES = {
    "财务异常类": (
        5,
        ("净利润为负", "扣除非经常性损益后净利润为负", "扣非净利润为负", "营业收入低于", "净资产为负"),
        ("商誉减值", "资产减值", "信用减值", "业绩亏损"),
        ("亏损", "减值", "营收下降", "收入下降", "下滑"),
    ),
    "审计意见异常类": (
        2,
        ("无法表示意见", "否定意见", "保留意见", "带强调事项段", "强调事项段"),
        ("非标准审计意见", "审计报告"),
        ("审计机构", "审计意见"),
    ),
    "监管调查处罚类": (
        3,
        ("被立案调查", "立案调查", "行政处罚", "行政处罚决定书", "纪律处分", "自律监管", "监管函", "问询函", "关注函"),
        ("证监会", "证监局", "交易所", "被调查"),
        ("立案", "调查", "监管措施", "处罚", "问询", "关注"),
    ),
    "重大违法信披类": (
        1,
        ("重大违法", "财务造假", "信息披露违法", "虚假记载", "误导性陈述", "重大遗漏"),
        ("信披违法", "造假"),
        ("违法", "虚假", "遗漏"),
    ),
    "债务诉讼流动性类": (
        6,
        ("无法偿还", "流动性紧张", "强制执行", "申请强制执行"),
        ("债务违约", "贷款逾期", "账户冻结", "资产查封"),
        ("违约", "逾期", "欠款", "诉讼", "仲裁", "冻结", "查封", "流动性"),
    ),
    "持续经营破产类": (
        4,
        ("持续经营存在重大不确定性", "持续经营重大不确定性", "破产清算", "破产重整"),
        ("重整", "破产", "清算"),
        ("持续经营", "资不抵债"),
    ),
}

# ---------------------------------------------------------------------------
# Negations, looked for this many characters around a hit
# ---------------------------------------------------------------------------
NEGATION_REACH = 18
NEGATIONS = (
    "不涉及", "不存在", "未触及", "未被", "未发生", "未受到", "未收到", "无需",
    "不构成", "已消除", "风险可控", "保证公告内容真实", "保证信息披露",
)

# ---------------------------------------------------------------------------
# Standard disclaimer wordings
# ---------------------------------------------------------------------------
DISCLAIMERS = (
    "本公告不存在虚假记载、误导性陈述或重大遗漏",
    "没有虚假记载、误导性陈述或重大遗漏",
    "不存在虚假记载、误导性陈述或重大遗漏",
    "本公司及董事会全体成员保证信息披露内容的真实、准确、完整",
    "本公司及董事会全体成员保证信息披露内容真实、准确、完整",
    "保证公告内容真实、准确、完整",
    "保证信息披露内容的真实、准确、完整",
    "保证公告内容的真实、准确、完整",
    "及董事会全体成员保证信息披露内容的真实、准确、完整",
    "董事会全体成员保证信息披露内容的真实、准确、完整",
    "全体成员保证信息披露内容的真实、准确、完整",
    "保证信息披露内容真实、准确、完整",
    "不存在虚假记载",
    "不存在误导性陈述",
    "不存在重大遗漏",
    "没有虚假记载",
    "没有误导性陈述",
    "没有重大遗漏",
    "无虚假记载",
    "无误导性陈述",
    "无重大遗漏",
    "导性陈述或重大遗漏",
    "陈述或重大遗漏",
    "性陈述或重大遗漏",
)

# ---------------------------------------------------------------------------
# Explanation sentences (printf style, used with format_string)
# ---------------------------------------------------------------------------
LEVEL_NAMES = {"high": "高", "medium": "中", "low": "低"}
KEYWORD_JOINER = "、"
CATEGORY_JOINER = "与"
SENTENCE_NONE = "该公告未匹配到明确的 ST 相关风险短语，建议结合全文与其他指标综合判断。"
SENTENCE_ONE_HIGH = "该公告整体命中%s高风险信号，主要关键词包括%s，表明公司存在较高风险，需重点关注。"
SENTENCE_ONE_MEDIUM = (
    "该公告整体命中%s中风险信号，主要关键词包括%s，"
    "表明存在较明显的风险迹象，建议结合年报与审计意见等综合判断。"
)
SENTENCE_ONE_LOW = "该公告整体命中%s低风险提示，主要关键词包括%s，提示一般性风险关注，可酌情跟踪。"
SENTENCE_MIXED = "该公告整体命中%s等风险信号，其中「%s」风险等级更高（%s），主要关键词包括%s等。"
SENTENCE_SAME = (
    "该公告整体命中%s等风险信号，均以%s等级为主，"
    "主要关键词包括%s等，建议结合公告全文综合判断。"
)
