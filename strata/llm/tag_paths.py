"""Main text of web pages by tag-path ratios.

A page's text falls into blocks, each with the path of block elements from the root to it.
Text length outside links and punctuation are summed per path and divided by the path's
number of blocks; the two ratios are smoothed over the page's blocks, so a short block
among long ones counts with them, multiplied, and paths above a share of the spread are
content. Short blocks that stand beside content blocks in one element (headings, list
entries, one-word paragraphs) belong to it. Elements that name themselves as something else
(navigation, forms, adverts, notices, comments) have no ratio at all.

Pages are independent rows: one Arrow pass, no shuffle.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

# Fixed values of HTML: element kinds.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe svg math object select option button canvas noframes head xmp".split())
BLOCK = frozenset(("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                   "header hgroup hr li main menu nav ol p pre section summary table tbody thead tfoot tr td th caption ul").split())
#: Elements that only give text a form; blocks in them go with their neighbours.
FORM = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption hgroup address".split())
#: A start tag closes an open element of these kinds first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
          "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: How far up that search goes.
FENCE = frozenset("html body article section div main table ul ol dl blockquote td th aside nav header footer form".split())
#: Elements and words of class, id and role that mark what is not the article.
OTHER = frozenset("nav header footer aside form menu dialog".split())
OTHER_WORDS = frozenset((
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share sharing social newsletter subscribe subscription signup login search form popup modal "
    "cookie cookies consent gdpr notice notices alert disclaimer comment comments reply replies disqus respond discussion pagination pager toolbar contentinfo "
    "complementary outbrain taboola skip").split())

_TAG = re.compile(r"<(?:!--(?P<note>.*?)(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|(?P<cut>\Z))|[!?/][^>]*+(?:>|\Z))", re.S)
_OPEN = re.compile(r"<(?=[a-zA-Z!?/])")
_NAMES = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Punctuation that sentences carry.
MARKS = ".,;:!?…。，、；：！？"
#: Smoothing over blocks, and the share of the ratios' spread that content passes.
KERNEL, SPREAD = np.array([0.05, 0.25, 0.4, 0.25, 0.05]), 0.25


def _other(name: str, attr: str) -> bool:
    if name in OTHER:
        return True
    if name in ("html", "body", "article", "main") or not attr:
        return False
    return any(w.lower() in OTHER_WORDS for m in _NAMES.finditer(attr) for w in _WORD.findall(m[1] or m[2] or m[3] or ""))


class _Element:
    __slots__ = ("name", "path", "parent", "other")

    def __init__(self, name: str, parent: "_Element | None", other: bool):
        self.name, self.parent = name, parent
        self.path = (parent.path if parent else "") + "/" + name
        self.other = other or bool(parent and parent.other)


def blocks(page: str) -> list[tuple[_Element, str, int]]:
    """(element, text with single spaces, characters in links) of each non-empty block in page order."""
    out: list[tuple[_Element, str, int]] = []
    top = _Element("html", None, False)
    stack = [top]
    words: list[str] = []
    links, linked, at, n = 0, 0, 0, len(page)

    def flush() -> None:
        nonlocal links
        if words:
            text = " ".join("".join(words).split())
            if text:
                out.append((stack[-1], text, links))
        words.clear()
        links = 0

    def text(raw: str) -> None:
        nonlocal links
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            words.append(raw)
            links += len(raw) if linked else 0

    while at < n:
        o = _OPEN.search(page, at)
        if not o:
            text(page[at:])
            break
        text(page[at : o.start()])
        m = _TAG.match(page, o.start())
        if not m:  # a quote that never closes: markup to the end
            break
        at = m.end()
        name = m["name"]
        if name is None or m["cut"] is not None:
            continue
        name = name.lower()
        if m["end"]:
            if name == "a":
                linked = max(0, linked - 1)
            elif name in BLOCK and any(e.name == name for e in stack[1:]):
                flush()
                while stack.pop().name != name:
                    pass
                linked = 0
            elif name in BLOCK or name == "br":
                flush()
            continue
        if name in RAW:
            if name == "head":
                continue
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(page, at)
            after = page.find(">", close.start()) if close else -1
            at = after + 1 if after >= 0 else n
        elif name == "a":
            linked = 1
        elif name == "br":
            flush()
        elif name in BLOCK:
            flush()
            linked = 0
            if name not in ("html", "body"):
                shut = CLOSES.get(name, {"p"} | ({"h1", "h2", "h3", "h4", "h5", "h6"} if re.fullmatch("h[1-6]", name) else set()))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in shut:
                        del stack[k:]
                    elif stack[k].name in FENCE:
                        break
                if name not in VOID:
                    stack.append(_Element(name, stack[-1], _other(name, m["attr"])))
    flush()
    return out


def path_scores(nodes: list[tuple[_Element, str, int]]) -> np.ndarray:
    """The fused, smoothed ratio of each block's path; 0 for what names itself as something else."""
    size, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    for e, t, links in nodes:
        if not e.other:
            size[e.path] += max(0, len(t) - links)
            marks[e.path] += sum(map(t.count, MARKS))
            count[e.path] += 1
    own = np.array([not e.other for e, _, _ in nodes])
    by_size = np.array([size[e.path] / count[e.path] if not e.other else 0.0 for e, _, _ in nodes])
    by_marks = np.array([(1 + marks[e.path]) / count[e.path] if not e.other else 0.0 for e, _, _ in nodes])
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), KERNEL, "valid")
    fused = smooth(by_size) * smooth(by_marks) * own
    total, times = defaultdict(float), defaultdict(int)
    for (e, _, _), f in zip(nodes, fused):
        total[e.path] += f
        times[e.path] += 1
    return np.array([total[e.path] / times[e.path] for e, _, _ in nodes]) * own


def main_text(page: str | None) -> str:
    """The article's blocks, joined by line ends; '' for a null or empty page."""
    nodes = blocks(page) if page else []
    if not nodes:
        return ""
    score = path_scores(nodes)
    chosen = score > 0
    chosen &= score >= SPREAD * score.std()
    holders = {e.parent if e.name in FORM and e.parent else e for (e, _, _), c in zip(nodes, chosen) if c}
    out = []
    for (e, text, links), c in zip(nodes, chosen):
        if e.other:
            continue
        x = e
        while x not in holders and x.name in FORM and x.parent:
            x = x.parent
        if c or (x in holders and (links < 0.8 * len(text) or x is not e)):
            out.append(text)
    return "\n".join(out)


@F.arrow_udf(StringType())
def extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(p.as_py()) for p in pages], pa.string())


def extract_pages(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html, ...) -> page_id, url, text, n_chars; a row per input row."""
    text = pages.select("page_id", "url", extract(F.col("html").cast("string")).alias("text"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
