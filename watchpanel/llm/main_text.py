"""Main text of web pages: the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags.  Words score positive and tags negative; one linear scan
finds the contiguous region with the largest sum; where most of its words lie in one ``<article>``
or ``<main>`` element, the region becomes that element.  The weights come from labelled pages: those that
mark their content with one ``<article>`` or ``<main>`` element.  A tag that stands about as often
inside as outside costs little; a tag found at the edge or outside of content costs more than the
words of any block that stood beside it there, so that no such block is worth crossing it.

Elements that are never article text (navigation, asides, forms, scripts, and blocks whose class or
id says advert, comment, cookie and so on) end a region like any other tag that costs much; those
left inside the region are cut out of it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: labelled pages that weights are fitted on, at most
FIT_PAGES = 2000

# Element names of HTML and words that name page parts.
UNREAD = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "head")
ASIDE = ("nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu")
VOID = ("br", "hr", "img", "input", "meta", "link", "wbr", "source", "track", "col", "area", "base", "embed")
BLOCKS = (
    "p div article main section h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th "
    "caption pre blockquote figure figcaption address hr br body html details summary fieldset legend"
).split()
PARTS = (
    "ad ads advert advertisement banner promo sponsor sponsored comment comments cookie cookies consent "
    "notice sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer share sharing social "
    "related newsletter subscribe popup modal widget toolbar pagination disqus reply replies response responses"
).split()
# words that name no content of their own beside those, as in site-header or comment-list
NEUTRAL = "site page top bottom left right main global list box bar block area slot wrap wrapper container inner item items section form button links link row unit".split()
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_PIECE = re.compile(r"[-_]+")
_QUOTED = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"']+)")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s/]|$)", re.I)
_STYLE = re.compile(r"\bstyle\s*=\s*(?:\"[^\"]*?|'[^']*?)display\s*:\s*none", re.I)


@dataclass(frozen=True)
class Weights:
    """Score of a word and, for each kind of tag, its cost."""

    word: float = 1.0
    other_tag: float = 4.0
    tags: dict[str, float] = field(default_factory=dict)

    def cost(self, kind: str) -> float:
        return self.tags.get(kind, self.other_tag)


def _kind(name: str, attr: str) -> tuple[str, bool]:
    """Kind of a tag, and whether the element is a page part that holds no article text."""
    if name in ASIDE:
        return name, True
    if attr and name not in ("html", "body", "article", "main", *HEADINGS):
        words = " ".join(a or b or c for a, b, c in _NAMED.findall(attr)).lower().split()
        if any(map(_names_part, words)):
            return f"{name}.part", True
        if _HIDDEN.search(_QUOTED.sub("", attr)) or _STYLE.search(attr):
            return f"{name}.hidden", True
    return name, False


def _names_part(word: str) -> bool:
    """Whether a whole class, id or role names a page part: its pieces are such words, with neutral ones."""
    pieces = [p for p in _PIECE.split(word) if p]
    return any(p in PARTS for p in pieces) and all(p in PARTS or p in NEUTRAL for p in pieces)


def tokens(page: str) -> list[tuple[str, str, bool]]:
    """(kind of tag or '' for text, text, outside): `outside` is text inside a page part.

    An element that is a part by its names or attributes, and holds over half of the page's words, is a
    wrapper and no part.
    """
    spared: frozenset[int] = frozenset()
    while True:
        out, parts = _tokens(page, spared)
        total = sum(len(text.split()) for kind, text, _ in out if not kind)
        wrappers = {at for at, n in parts.items() if 2 * n > total}
        if not wrappers:
            return out
        spared = spared | wrappers


def _tokens(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, str, bool]], dict[int, int]]:
    """Tokens, and the words inside each part that its names or attributes make one, by its place."""
    out: list[tuple[str, str, bool]] = []
    open_: list[str] = []  # elements open since the outermost page part
    words: dict[int, int] = {}
    part, begun = "", -1
    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            out.append(("", page[at : m.start()], bool(open_)))
            if open_ and begun >= 0:
                words[begun] = words.get(begun, 0) + len(out[-1][1].split())
        at = m.end()
        if not (name := m["name"]):
            continue
        name = name.lower()
        if m["close"]:
            if open_ and name in open_:
                while open_.pop() != name:
                    pass
                out.append(("/" + (name if open_ else part), "", bool(open_)))
            elif name in ("article", "main", "body", "html"):
                open_.clear()
                out.append(("/" + name, "", False))
            else:
                out.append(("/" + name, "", bool(open_)))
            continue
        kind, aside = _kind(name, m["attr"]) if m.start() not in spared else (name, False)
        if name in ("article", "main") and open_ and part != "dialog":
            open_.clear()
        out.append((kind, "", bool(open_)))
        if name not in VOID and not m["attr"].endswith("/"):
            if open_:
                open_.append(name)
            elif aside or name == "head":
                open_.append(name)
                part, begun = kind, m.start() if "." in kind else -1
    if at < len(page):
        out.append(("", page[at:], bool(open_)))
        if open_ and begun >= 0:
            words[begun] = words.get(begun, 0) + len(page[at:].split())
    return out, words


def fit(pages: list[str]) -> Weights:
    """Weights from pages that have exactly one content element; other pages are left out."""
    inside, outside = Counter(), Counter()
    most: Counter[str] = Counter()
    for page in pages:
        seq = tokens(page or "")
        for label in ("article", "main"):
            edges = [i for i, t in enumerate(seq) if t[0] in (label, "/" + label)]
            if len(edges) == 2:
                break
        else:
            continue
        first, last = edges
        run, near = 0, [first]
        for i, (kind, text, _) in enumerate(seq):
            if not kind:
                run = run if first < i < last else run + len(text.split())
                continue
            if first < i < last:
                inside[kind] += 1
                continue
            outside[kind] += 1
            for k in (kind, seq[near[-1]][0]):
                most[k] = max(most[k], run)
            near, run = [i], 0
    tags = {}
    for kind in inside | outside:
        share = (outside[kind] + 0.5) / (inside[kind] + outside[kind] + 1)
        tags[kind] = round(0.1 + share * (2.0 * (most[kind] + 1)), 3)
    return Weights(tags=tags)


def best_region(scores: list[float]) -> tuple[int, int]:
    """[start, end) with the largest sum; the earliest of equals, empty if nothing is positive."""
    best, found, total, begin = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, begin = 0.0, i
        total += s
        if total > best:
            best, found = total, (begin, i + 1)
    return found


def _element(seq: list, scores: list[float], begin: int, end: int) -> tuple[int, int]:
    """The smallest whole article or main element with most of the region's words, or the region."""
    total = sum(s for s in scores[begin:end] if s > 0)
    open_: dict[str, list[int]] = {"article": [], "main": []}
    for i, (kind, _, _) in enumerate(seq):
        if kind in open_:
            open_[kind].append(i)
        elif kind[:1] == "/" and open_.get(kind[1:]):
            first = open_[kind[1:]].pop()
            inside = sum(s for s in scores[max(first, begin) : min(i, end)] if s > 0)
            if total and 2 * inside > total:
                return first + 1, i
    return begin, end


def main_text(page: str | None, weights: Weights) -> str:
    """Main text of a page: blocks joined by one space; empty for null, empty or text-free pages."""
    seq = tokens(page or "")
    scores = [
        -weights.cost(kind) if kind else 0.0 if aside else weights.word * len(text.split())
        for kind, text, aside in seq
    ]
    begin, end = _element(seq, scores, *best_region(scores))
    # text and inline tags at the edges belong to the block that the region starts or ends in
    while begin > 0 and not _edge(seq[begin - 1]):
        begin -= 1
    while end < len(seq) and not _edge(seq[end]):
        end += 1
    blocks, now = [], []
    for kind, text, aside in seq[begin:end]:
        if kind:
            if kind.lstrip("/").split(".")[0] in BLOCKS:
                blocks.append("".join(now))
                now = []
        elif not aside:
            now.append(html.unescape(text))
    blocks.append("".join(now))
    return " ".join(" ".join(b.split()) for b in blocks if b.split())


def _edge(token: tuple[str, str, bool]) -> bool:
    kind, _, aside = token
    return aside or bool(kind) and (kind.lstrip("/").split(".")[0] in BLOCKS or "." in kind or kind in ASIDE)


def fit_weights(pages: DataFrame, key: str = "page_id", html_column: str = "html", most: int = FIT_PAGES) -> Weights:
    """Weights from at most `most` labelled pages, those with the smallest hash of their key."""
    marked = pages.where(F.col(html_column).rlike("(?i)<(article|main)[ >]")).select(
        F.col(html_column).alias("h"), F.xxhash64(key, F.col(html_column)).alias("o")
    )
    # only hashes are sorted; the pages themselves are read for the chosen ones
    cut = [r.o for r in marked.select("o").orderBy("o").limit(most).collect()]
    if not cut:
        return Weights()
    return fit([r.h for r in marked.where(F.col("o") <= cut[-1]).orderBy("o").limit(most).collect()])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html_column: str = "html", weights: Weights | None = None) -> DataFrame:
    """(key, url, text, n_chars) of every page; a null page has an empty text.

    Repeated rows and null keys each give a row; other columns are left out.
    """
    used = weights or fit_weights(pages, key, html_column)

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([main_text(p, used) if isinstance(p, str) else "" for p in part], dtype=object)

    text = F.pandas_udf(run, T.StringType())
    found = pages.select(F.col(key).alias("_id"), F.col(url).alias("_url"), text(F.col(html_column)).alias("text"))
    return found.select(
        F.col("_id").alias(key), F.col("_url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars")
    )
