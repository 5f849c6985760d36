"""Main text of web pages: the best contiguous region, by weights learned from labelled pages.

A page is read as a sequence of tags and runs of words. A run scores its words times the least
weight of the elements around it; a tag scores a negative weight of its own. Weights are log odds
of standing inside the article, counted over labelled pages: a page with an <article> element
labels all its words and tags. The <article> tag itself is no feature, so pages without one are
read by the same weights. A linear scan keeps the region with the greatest sum.

Elements whose name, or a whole word of class, id or role, says that they hold no main text
(OUTSIDE) are never words, inside the region or not, unless they hold the main text after all: an
<article> or <main>, or, if they may wrap a page, most of its words. Their weights are counted
like others. Scripts, styles and comments of the markup are no words either.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# HTML elements without text content, without end tags, and that begin a block.
RAW = {"script", "style", "template", "noscript", "textarea", "iframe", "svg", "math", "object", "canvas", "noembed", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main",
    "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "title", "tr", "ul",
}
#: Elements, and words of class, id and role, that mark menus, headers, footers, sidebars, notices, adverts, forms and comments.
OUTSIDE = {"head", "title", "nav", "header", "footer", "aside", "form", "menu", "button", "select", "option", "label", "dialog", "fieldset", "search"}
OUTSIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside",
    "complementary", "contentinfo", "search", "form", "newsletter", "subscribe", "signup", "login", "cookie", "cookies", "consent", "gdpr",
    "notice", "alert", "popup", "modal", "overlay", "comment", "comments", "reply", "replies", "disqus", "discussion", "share", "sharing",
    "social", "related", "recommended", "widget", "pagination", "pager", "toolbar", "skip", "copyright", "legal", "disclaimer",
}
ENDED_BY = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
INLINE_STACK = {"div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "menu", "ul", "ol", "li", "dl", "dt", "dd",
                "table", "tr", "td", "th", "head", "title", "button", "select", "option", "label", "dialog", "fieldset", "search", "blockquote",
                "figure", "figcaption", "details", "span", "a", "pre", "p"}
LABEL = "article"

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
#: Elements of the main text, and names in OUTSIDE that may wrap a whole page.
HOLDERS = {"article", "main"}
WRAPPERS = {"form", "fieldset", "dialog"}
#: Share of a page's words from which an element wraps it.
WIDE = 0.75
SPACES = re.compile(r"\s+")

WORD_SCORE, TAG_SCORE = 1.0, -0.1
MOST = 6.0


class Element:
    """An open element: its name and kinds, the words in it, and whether it holds an <article> or <main>."""

    __slots__ = ("tag", "found", "words", "holds", "out")

    def __init__(self, tag: str, found: tuple[str, ...]):
        self.tag, self.found, self.words, self.holds, self.out = tag, found, 0, False, False


def kinds(tag: str, attributes: str) -> tuple[str, ...]:
    """What an element is counted as: its name, and its name with each word of class, id and role, numbers in these as 0."""
    found = [tag]
    for _, a, b, c in ATTRIBUTE.findall(attributes) if attributes else ():
        found += [f"{tag}.{w}" for w in DIGITS.sub("0", (a or b or c).lower()).split()]
    return tuple(found)


def boilerplate(kind: str) -> bool:
    """Whether an element's name is in OUTSIDE, or a word of its class, id or role is made of OUTSIDE_WORDS alone."""
    tag, _, name = kind.partition(".")
    if not name:
        return tag in OUTSIDE
    words = NAME_WORD.findall(name)
    return bool(words) and tag not in HOLDERS and tag != "body" and tag != "html" and all(w in OUTSIDE_WORDS for w in words)


def settled(element: Element, total: int) -> None:
    """Whether a whole element is outside; one that is not in spite of its names is not counted by these."""
    if not any(map(boilerplate, element.found)):
        return
    wraps = element.tag not in OUTSIDE or element.tag in WRAPPERS
    if element.holds or wraps and element.words > WIDE * total:
        element.found = tuple(k for k in element.found[:1] if not boilerplate(k))
    else:
        element.out = True


def read(page: str) -> Iterator[tuple[str, object, tuple[str, ...], bool, bool]]:
    """Tags and texts of a page in order: (kind, text or None, elements around, outside, in the labelled element)."""
    events, elements, total = parse(page)
    for element in elements:
        settled(element, total)
    last, state = None, ((), False, False)
    for kind, text, chain in events:
        if chain is not last:
            around = tuple(k for e in chain for k in e.found if k != LABEL and not k.startswith(LABEL + "."))
            last, state = chain, (around, any(e.out for e in chain), any(e.tag == LABEL for e in chain))
        yield kind, text, *state


def parse(page: str) -> tuple[list[tuple[str, object, tuple[Element, ...]]], list[Element], int]:
    """(tags and texts with the elements around, all elements, words of the body).

    Unclosed elements end with the element around them; an end tag without a start is skipped.
    """
    events: list[tuple[str, object, tuple[Element, ...]]] = []
    elements: list[Element] = []
    stack: list[Element] = []
    chain: tuple[Element, ...] = ()
    at = total = 0

    def settle():
        nonlocal chain
        chain = tuple(stack)

    def words(text: str):
        nonlocal total
        n = len(text.split())
        for e in chain:
            e.words += n
        if not any(e.tag in ("head", "title") for e in chain):
            total += n
        events.append(("", text, chain))

    while m := TOKEN.search(page, at):
        if m.start() > at:
            words(page[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if any(e.tag == tag for e in stack):
                while stack.pop().tag != tag:
                    pass
                settle()
            events.append(("/" + tag, None, chain))
            continue
        if tag in RAW and not m[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            events.append((tag, None, chain))
            continue
        if tag in ENDED_BY and stack and stack[-1].tag in ENDED_BY[tag]:
            stack.pop()
            settle()
        elif tag in BLOCK and stack and stack[-1].tag == "p":
            stack.pop()
            settle()
        found = kinds(tag, m[3])
        if tag == "body" or (tag in BLOCK and any(e.tag == "head" for e in stack) and tag not in ("title", "head")):
            stack[:] = [e for e in stack if e.tag not in ("head", "title")]
            settle()
        events.append((tag if len(found) == 1 else found[-1], None, chain))
        if tag in INLINE_STACK and tag not in VOID and not m[3].rstrip().endswith("/"):
            if tag in HOLDERS:
                for e in stack:
                    e.holds = True
            elements.append(Element(tag, found))
            stack.append(elements[-1])
            settle()
    if at < len(page):
        words(page[at:])
    return events, elements, total


def count(page: str) -> Counter:
    """(what, inside) -> how often, for the words and tags of a page that has the labelled element."""
    counted: Counter = Counter()
    for kind, text, around, out, inside in read(page):
        if text is None:
            counted["<" + kind, inside] += 1
        else:
            n = len(text.split())
            for k in set(around) or {""}:
                if not out or boilerplate(k):  # boilerplate counts against its own names alone
                    counted[k, inside] += n
    return counted


def learn(labelled: DataFrame, bound: int = 2000, page: str = "html", key: str = "page_id") -> dict[str, float]:
    """Weights from at most `bound` pages with the labelled element, the least by a hash of their key.

    Without such pages the result is empty and all words and tags have their first scores.
    """
    has = F.lower(page).contains(f"<{LABEL}")
    least = labelled.where(has).groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1))).select("__key")
    least = least.orderBy(F.xxhash64("__key"), "__key").limit(bound)
    sample = labelled.where(has).join(least, F.col(key).eqNullSafe(F.col("__key"))).select(F.col(page).alias("__page"))

    def counts(batches):
        total: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                total.update(count(text))
        keys = list(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())],
            ["kind", "inside", "n"])

    found = sample.mapInArrow(counts, "kind string, inside boolean, n long").groupBy("kind", "inside").agg(F.sum("n").alias("n")).collect()
    by = {(r["kind"], r["inside"]): r["n"] for r in found}
    return {k: float(np.clip(np.log((by.get((k, True), 0) + 0.5) / (by.get((k, False), 0) + 0.5)), -MOST, MOST)) for k, _ in by}


def extract(page: str, weights: dict[str, float]) -> str:
    """Main text of one page: blocks of the best region, one a line."""
    tokens = [t for t in read(page)]
    best, total, low, high, begin = 0.0, 0.0, 0, 0, 0
    for i, (kind, text, around, out, _) in enumerate(tokens):
        if total <= 0:
            total, begin = 0.0, i
        if text is None:
            total += min(TAG_SCORE, weights.get("<" + kind, TAG_SCORE)) if not out else 0.0
        elif not out:
            words = len(text.split())
            if words:
                own = [weights[k] for k in around if k in weights]
                least = min(own) if own else weights.get("", WORD_SCORE)
                total += words * (least if least < 0 else max(WORD_SCORE, least))
        if total > best:
            best, low, high = total, begin, i + 1
    blocks: list[str] = []
    line: list[str] = []

    def close():
        joined = SPACES.sub(" ", html.unescape("".join(line))).strip()
        if joined:
            blocks.append(joined)
        line.clear()

    for kind, text, around, out, _ in tokens[low:high]:
        if text is None:
            if kind.partition(".")[0].lstrip("/") in BLOCK:
                close()
            elif kind == "br":
                line.append(" ")
        elif not out:
            line.append(text)
    close()
    return "\n".join(blocks)


def main_text(pages: DataFrame, weights: dict[str, float], page: str = "html") -> DataFrame:
    """`pages` with `text`, the main text of each whole page, and n_chars, its code points.

    Columns of these names are replaced. Character references are decoded, white space inside a
    block is one space, blocks are joined by a line feed in page order. Null and empty pages and
    pages without main text have an empty text. Rows are kept as they are.
    """

    @F.arrow_udf("string")
    def texts_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([extract(p, weights) if p else "" for p in batch.to_pylist()], pa.string())

    source = pages.withColumn("__page", F.col(page))
    return source.withColumn("text", texts_of(F.col("__page"))).drop("__page").withColumn("n_chars", F.length("text").cast("long"))
