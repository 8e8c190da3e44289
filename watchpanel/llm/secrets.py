"""Secret scans by a trigram inverted index, with DataFrame functions only.

From each rule's regular expression a Boolean query of trigrams is derived that every match must
satisfy (AND within an alternative, OR between alternatives).  The index holds postings (trigram,
text) of the trigrams that occur in some query; postings are intersected for each rule and the rule's
regular expression runs on the texts that are left.  Rules without a mandatory trigram scan
every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: alternatives of a trigram query; a query with more scans fully
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """`pattern` is understood alike by Python and Java; `group` must have `least` characters.

    `lead` is a shorter pattern that every match contains; it decides quickly on texts of rules
    that scan fully.
    """

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    lead: str | None = None

    @property
    def java(self) -> str:
        return ("(?i)" if self.any_case else "") + self.pattern


BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9+/_.=-]{16,}", any_case=True),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9.-]+"),
)


def _product(a: list[tuple], b: list[tuple]) -> list[tuple]:
    return [x + y for x in a for y in b]


def _strings(tree) -> list[tuple]:
    """Alternatives of what a match holds in order: characters, and None where anything may stand."""
    out: list[tuple] = [()]
    for op, arg in tree:
        if op is sre.LITERAL:
            part = [(chr(arg),)]
        elif op is sre.SUBPATTERN:
            part = _strings(arg[3])
        elif op is sre.BRANCH:
            part = [s for branch in arg[1] for s in _strings(branch)]
        elif op is sre.IN and len(arg) <= 8 and all(o is sre.LITERAL for o, _ in arg):
            part = [(chr(c),) for _, c in arg]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            if (least, most) == (0, 1):
                part = [(), *_strings(inner)]
            else:
                once = _strings(inner) if least else [(None,)]
                part = [(None, *s, None) for s in once]
        elif op is sre.AT:
            part = [()]
        else:
            part = [(None,)]
        if len(out) * len(part) > MAX_ALTERNATIVES:
            part = [(None,)]
        out = _product(out, part)
    return out


def trigram_query(rule: Rule) -> list[frozenset[str]]:
    """Sets of lower-case trigrams; a text with a match has all of at least one set.

    Empty if some alternative has no trigram: the rule scans fully.
    """
    found = set()
    for alternative in _strings(parser.parse(rule.pattern)):
        runs = "".join("\n" if c is None else c for c in alternative).lower().split("\n")
        found.add(frozenset(r[i : i + 3] for r in runs for i in range(len(r) - 2)))
    # a set that includes another adds nothing
    least = [s for s in found if not any(o < s for o in found)]
    return [] if frozenset() in found else sorted(least, key=sorted)


def postings(texts: DataFrame, rules: tuple[Rule, ...], text: str, key: str) -> DataFrame:
    """(trigram, key): the inverted index over the trigrams of the rules' queries."""
    wanted = sorted({t for r in rules for s in trigram_query(r) for t in s})
    low = F.lower(text)
    present = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in wanted]))
    return texts.select(F.explode(present).alias("trigram"), F.col(key).alias("key"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(key, kinds): the rules whose trigram query each text satisfies, by intersecting postings.

    The postings of a text are gathered as a set, which has at most as many entries as the queries
    have trigrams.
    """
    held = index.groupBy("key").agg(F.collect_set("trigram").alias("held"))
    kinds = []
    for rule in rules:
        sets = trigram_query(rule)
        if sets:
            fits = [
                F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(s))))) == len(s) for s in sets
            ]
            kinds.append(F.when(reduce(lambda a, b: a | b, fits), F.lit(rule.kind)))
    return held.select("key", F.array_compact(F.array(*kinds)).alias("kinds")).where(F.size("kinds") > 0)


def _spans(text: str, rule: Rule, order: int) -> Column:
    """Spans of a rule: structs (start, order, kind, end, size of the group).

    A text split at the matches gives what stands between them; lengths of both give the places.
    """
    pattern = F.lit(rule.java)
    between = F.split(text, rule.java, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    parts = F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("b"), matches.alias("m"), groups.alias("g"))
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,size:int>>")
    begin = F.struct(F.lit(0).alias("at"), empty.alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        start = acc["at"] + F.length(part["b"])
        end = start + F.length(part["m"])
        span = F.struct(
            start.alias("start"), F.lit(order).alias("order"), F.lit(rule.kind).alias("kind"),
            end.alias("end"), F.length(part["g"]).alias("size"),
        )
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    found = F.aggregate(parts, begin, step)["spans"]
    return F.filter(found, lambda s: s["size"] >= max(rule.least, 1))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """(key, spans) of every row; spans are structs (start, order, kind, end) by start and rule.

    Positions are code points, ends are exclusive.  A null text counts as empty.  Texts are matched
    with the index by a hash of key and text: repeated rows share their candidates, and each gives
    its own row.  Other columns are left out.
    """
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(text), F.lit("")).alias("_text")).withColumn(
        "_key", F.xxhash64("_id", "_text")
    )
    found = candidates(postings(rows, rules, "_text", "_key"), rules)
    # rows without candidate rules need no exchange partner, so only candidates' keys are joined
    joined = rows.join(found.withColumnRenamed("key", "_found"), F.col("_key") == F.col("_found"), "left")
    lists = []
    for order, rule in enumerate(rules):
        full = not trigram_query(rule)
        try_it = F.col("_text").rlike(rule.lead or rule.java) if full else F.array_contains("kinds", rule.kind)
        lists.append(F.when(try_it, _spans("_text", rule, order)).otherwise(F.array()))
    return joined.select(F.col("_id").alias(key), F.array_sort(F.concat(*lists)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
