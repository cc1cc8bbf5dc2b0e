"""Main text of web pages as the maximum-scoring run of words and tags.

Words score by where they stand, tags score below zero; the weights come from pages that mark their
content themselves. One linear scan finds the best contiguous region, and what stands in it outside
menus, adverts, forms and the like is the text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftline.llm.words import blocks

PIECES = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|svg|title)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>", re.S | re.I)
MARKS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
NAME = re.compile(r"[a-z]+")
CONTENT = {"article", "main"}
CONTAINERS = {
    "body", "div", "section", "nav", "aside", "header", "footer", "article", "main", "form", "ul", "ol",
    "dl", "table", "figure", "details", "dialog", "fieldset", "menu", "blockquote",
}
BLOCKS = CONTAINERS | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "figcaption",
    "caption", "address", "hr", "summary", "legend", "option", "select", "button", "label", "head", "html",
    "thead", "tbody", "tfoot", "hgroup", "search",
}
SIDE_TAGS = {"nav", "aside", "footer", "form", "menu", "dialog", "select", "button", "head", "search"}
#: Parts of class names, ids and roles that tell of something beside the article.
SIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "promotion", "cookie", "cookies", "consent", "gdpr", "banner", "notice", "alert", "sidebar", "side",
    "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead", "comment",
    "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related",
    "recommended", "newsletter", "subscribe", "subscription", "popup", "modal", "overlay", "widget",
    "pagination", "pager", "login", "signup", "search", "toolbar", "complementary", "contentinfo", "dialog",
    "form",
}
#: What stands before a side name when it tells of the layout of the whole: has-sidebar, with-nav, no-ads.
LAYOUT = {"has", "with", "without", "no"}
#: Other tags whose marks are read; a mark lasts to the end of its tag, where that is optional to the next such block.
MARKED = {
    "p", "li", "dt", "dd", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "span", "tbody", "thead",
    "tfoot", "figcaption", "caption", "address",
}
#: Tags that may be left open: a block that starts ends them.
OPEN_ENDED = {
    "p", "li", "dt", "dd", "tr", "td", "th",
}
LIMIT = 5.0


class Piece(NamedTuple):
    """A tag, or a run of text: what it scores by, how often, the block it is part of, and if it is beside the article."""

    key: str
    count: int
    text: str
    block: int
    side: bool
    inside: bool


def _side(tag: str, attributes: str) -> str:
    if tag in SIDE_TAGS:
        return tag
    for m in MARKS.finditer(attributes):
        for word in (m[1] or m[2] or m[3] or "").lower().split():
            names = NAME.findall(word)
            for before, name in zip(["", *names], names):
                if name in SIDE_NAMES and before not in LAYOUT:
                    return name
    return ""


def _close_open(marked: list[tuple[str, str, int]], tag: str, depth: int) -> None:
    """A block that starts ends a marked paragraph, and a row, cell or item its like."""
    rows = ("td", "th", "tr")
    while marked and marked[-1][2] == depth and marked[-1][0] in OPEN_ENDED:
        last = marked[-1][0]
        if last == "p" or last == tag or {last, tag} <= {"dt", "dd"} or {last, tag} <= {"td", "th"} or (last in rows and tag == "tr"):
            marked.pop()
        else:
            break


def _beside(stack: list[tuple[str, str]], marked: list[tuple[str, str, int]]) -> str:
    """The nearest mark; what stands around an article, main or body doesn't count in it.

    An article in another is a comment or the like, so marks between the two do count.
    """
    depth, content, articles = len(stack), 0, 0
    for i, (tag, _) in enumerate(stack):
        if tag in ("body", "main") or (tag == "article" and not articles):
            content = i + 1
        articles += tag == "article"
    for i in range(depth, content - 1, -1):
        inner = next((mark for _, mark, at in reversed(marked) if at == i), "")
        if inner:
            return inner
        if i > content and stack[i - 1][1]:
            return stack[i - 1][1]
    return ""


def pieces(page: str) -> list[Piece]:
    """The page in order. Containers nest; other tags need not be closed."""
    out: list[Piece] = []
    stack: list[tuple[str, str]] = []  # container, what makes it stand beside the article
    block, at, near, link = 0, 0, "body", False
    side, inside = "", 0
    marked: list[tuple[str, str, int]] = []  # other tags with a mark, and how many containers are open around them

    def run(text: str) -> None:
        n = len(text.split())
        if n:
            key = f"side {side}" if side else f"words {near}{' link' if link else ''}"
            out.append(Piece(key, n, text, block, bool(side), inside > 0))
        elif text:
            out.append(Piece("", 0, text, block, bool(side), inside > 0))

    for m in PIECES.finditer(page):
        if m.start() > at:
            run(page[at : m.start()])
        at = m.end()
        if not m[3]:
            continue
        tag, end = m[3].lower(), bool(m[2])
        if tag in BLOCKS:
            block += 1
            near, link = ("body" if end else tag), False
        elif tag == "br":
            out.append(Piece("", 0, " ", block, bool(side), inside > 0))
        elif tag == "a":
            link = not end
        before = (len(stack), len(marked))
        if tag == "body" and not end:
            # The end of a head may be left out, and nothing that is open before the body goes on in it.
            stack.clear()
            marked.clear()
        if tag in CONTAINERS or tag in SIDE_TAGS:
            if not end:
                if marked and tag in BLOCKS:
                    _close_open(marked, tag, len(stack))
                # A header is beside the article unless it stands in it.
                mark = _side(tag, m[4]) or ("header" if tag == "header" and not inside else "")
                mark = "" if tag in CONTENT or tag == "body" else mark
                stack.append((tag, mark))
            elif any(t == tag for t, _ in stack):
                while stack.pop()[0] != tag:
                    pass
                while marked and marked[-1][2] > len(stack):
                    marked.pop()
            inside = sum(t in CONTENT for t, _ in stack)
            if end and stack:
                near = stack[-1][0]
        elif end:
            at_mark = next((i for i in range(len(marked) - 1, -1, -1) if marked[i][0] == tag and marked[i][2] == len(stack)), None)
            if at_mark is not None:
                del marked[at_mark:]
        else:
            if marked and tag in BLOCKS:
                _close_open(marked, tag, len(stack))
            if tag in MARKED and (mark := _side(tag, m[4])):
                marked.append((tag, mark, len(stack)))
        if tag in CONTAINERS or tag in SIDE_TAGS or before != (len(stack), len(marked)):
            side = _beside(stack, marked)
        out.append(Piece(f"tag {tag}", 1, "", block, bool(side), inside > 0))
    run(page[at:])
    return out


def fit(pages: DataFrame, html_column: str = "html", sample: int = 5000) -> dict[str, float]:
    """Weight per key, from about ``sample`` pages that have an article or main element.

    The pages with the lowest hashes teach, so the sample doesn't depend on how the table is stored.
    Keys never seen, and a table without such pages, get the weights of the prior.
    """
    marked = pages.select(F.col(html_column).cast("string").alias("html")).where(F.col("html").rlike("(?i)<(?:article|main)[\\s>]"))
    n = max(1, marked.count())
    share = (F.xxhash64("html").cast("double") / 2.0**63 + 1) / 2
    chosen = marked.where(share <= sample / n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside, outside = Counter(), Counter()
        for batch in batches:
            for page in batch.column(0):
                for p in pieces(page.as_py()):
                    if p.key:
                        (inside if p.inside else outside)[p.key] += p.count
        keys = sorted(inside.keys() | outside.keys())
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array([inside[k] for k in keys], pa.int64()), pa.array([outside[k] for k in keys], pa.int64())], names=["key", "inside", "outside"])

    # Keys are names of tags and of a fixed list; tags met in few places don't count.
    rows = chosen.mapInArrow(count, "key string, inside long, outside long").groupBy("key").agg(F.sum("inside").alias("i"), F.sum("outside").alias("o"))
    found = rows.where("i + o >= 5").orderBy(F.desc(F.col("i") + F.col("o")), "key").limit(2000).collect()
    return {r["key"]: weigh(r["key"], r["i"], r["o"]) for r in found}


def weigh(key: str, inside: int = 0, outside: int = 0) -> float:
    """Log-odds of content with the prior's counts; only words outside the side parts may score above zero.

    What stands beside the article is left out of its text in any case, so it costs little to step over it.
    """
    kind, name = key.split(" ", 1)
    if kind == "tag" and name in CONTENT:
        return -LIMIT
    a, b = (1.0, 2.0) if key.endswith(" link") else {"side": (0.5, 5.0), "words": (3.0, 1.0), "tag": (1.0, 1.2)}[kind]
    odds = max(-LIMIT, min(LIMIT, math.log((inside + a) / (outside + b))))
    least, most = {"words": (-LIMIT, LIMIT), "side": (-0.1, -0.02), "tag": (-1.0, -0.02)}[kind]
    return max(least, min(most, odds))


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The text of the best region: its blocks in order, parted by empty lines."""
    parts = pieces(page or "")
    best, total, begin, region = 0.0, 0.0, 0, (0, 0)
    for i, p in enumerate(parts):
        if p.key:
            weight = weights.get(p.key)
            total += p.count * (weigh(p.key) if weight is None else weight)
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, region = total, (begin, i + 1)
    texts: dict[int, list[str]] = {}
    for p in parts[region[0] : region[1]]:
        if p.text and not p.side:
            texts.setdefault(p.block, []).append(p.text)
    lines = (" ".join(html.unescape("".join(t)).split()) for t in texts.values())
    return "\n\n".join(line for line in lines if line)


def extract_text(pages: DataFrame, weights: dict[str, float], id_column: str = "page_id", html_column: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_column``, the columns in ``keep`` and ``text`` of every row.

    Null and empty pages, and pages without a word, give the empty text; of equally good regions the
    first wins; repeated rows are read each; an empty table gives no rows; other columns are left out.
    """
    rows = pages.select(id_column, *keep, F.col(html_column).cast("string").alias("__html"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__html")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, rows_at):
            texts = [extract(h.as_py(), weights) for h in block.column(rows_at)]
            yield pa.record_batch([*block.columns[:rows_at], pa.array(texts, pa.string())], names=[*block.schema.names[:rows_at], "text"])

    rows_at = 1 + len(keep)
    return rows.mapInArrow(step, f"{schema}, text string")
