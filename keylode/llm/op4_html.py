"""Main text of web pages as a maximum-scoring subsequence.

A page becomes a sequence of scored items: words by where they stand (paragraph,
heading, link, bare, inside an element of a doubtful name) and tags by name.  The scores
are log-odds counted on labelled pages, built below from page parts that are known to be
content or not.  A linear scan finds the contiguous region of the greatest sum; it is
widened to the whole of the innermost container that holds it, so short first and last
paragraphs count.

Set apart are elements that HTML has for it (menus, asides, forms, hidden ones, ...) and
block elements with a class, role or (containers only) id that as a whole names such a
part, like "ad" or "cookie-notice"; they take no part in the sum and are left out.  Names
that only may mean such a part, like "notice" or "related", lower the score of the words
within; the element is left out unless what it holds sums up to more than the labelled
pages' adverts and notices come to.
Names that merely hold such a word ("has-sidebar", "legal-analysis") mean nothing, and
no inline element ends a block.

Character references are decoded; white space inside a block becomes one space; blocks
are trimmed and joined by a line feed.  Nothing is cut by length.  Null html, and
pages without a region of positive score, give an empty text.  The scan reads each
page once, in memory that grows with its tags and text; unclosed tags end with their
container.  Rows are independent: repeats and other columns have no influence; an empty
table gives an empty one.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache, lru_cache
from html import unescape
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from keylode.llm.work import read

_TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)((?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>""")
_ATTRIBUTE = re.compile(r"""(?:^|[\s/"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# HTML element names by role.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
_APART = {"nav", "aside", "footer", "header", "form", "dialog", "menu", "head", "fieldset"}
_APART_INLINE = {"button", "select", "svg", "object", "datalist"}
_CONTAINER = {"html", "body", "article", "main", "section", "div", "td", "th", "table", "tr", "tbody", "thead", "tfoot", "ul", "ol", "dl", "blockquote", "figure", "center"} | _APART
_BLOCK = _CONTAINER | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "pre", "hr", "address", "figcaption", "caption", "details", "summary", "option", "label", "legend", "hgroup"}
_HEADING = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PARAGRAPH = {"p", "li", "td", "th", "dd", "dt", "pre", "blockquote", "figcaption"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Words that, as a whole class, id or role, name a part beside the article.  This list
#: and the next two are choices of this module.
_BESIDE = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "complementary",
    "masthead", "footer", "contentinfo", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay",
    "comment", "comments", "reply", "replies", "respond", "disqus", "share", "sharing", "newsletter", "subscribe", "signup", "login", "pagination", "pager", "toolbar",
}
#: Words that may name such a part, or a part of an article.
_DOUBTFUL = {"header", "banner", "side", "copyright", "legal", "notice", "alert", "discussion", "social", "related", "recommended", "subscription", "search", "widget", "skip"}
#: Words that go with either and mean nothing by themselves.
_NEUTRAL = {"site", "page", "top", "bottom", "left", "right", "global", "primary", "secondary", "container", "wrapper", "wrap", "box", "area", "section", "list", "bar", "unit", "slot", "block", "item", "links", "form"}
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
CLEAR, HINT, APART = 0, 1, 2


@lru_cache(maxsize=1 << 14)
def _meaning(name: str) -> int:
    """What a class, role or id means: nothing, maybe a part beside the article, or one."""
    parts = {w.lower() for w in _NAME_PART.findall(name)} - _NEUTRAL
    if not parts or not parts <= _BESIDE | _DOUBTFUL:
        return CLEAR
    return APART if parts & _BESIDE else HINT


def _standing(name: str, attributes: str) -> int:
    if name in _APART or name in _APART_INLINE:
        return APART
    if not attributes or name in ("html", "body", "article", "main"):
        return CLEAR
    found = CLEAR
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            return APART
        if key == "style":
            if re.search(r"display\s*:\s*none", value, re.I):
                return APART
        elif name in _BLOCK and name not in _HEADING and (key != "id" or name in _CONTAINER):
            found = max([found, *map(_meaning, value.split())])
    return found


class Page:
    """items: (kind, count, block, doubtful element or -1) in page order; blocks: (text,
    container, apart, doubtful element); containers by number, in the order of opening:
    their name, parent, the number after the last one within, whether within an article."""

    def __init__(self, html: str):
        self.items: list[tuple[str, int, int, int]] = []
        self.blocks: list[tuple[str, int, bool, int]] = []
        self.names, self.parent, self.after, self.article = ["", ], [-1], [0], [False]
        self.hints = 0
        # name, container (-1: inline), set apart, doubtful element
        self._stack: list[tuple[str, int, bool, int]] = [("", 0, False, -1)]
        self._count: Counter[str] = Counter()
        self._parts: list[str] = []
        self._inline = ""
        self._link = False
        self._hidden = 0  # inline elements set apart that are open
        self._html = html
        self._read(html)
        self._end()
        self._shut(0)

    def _text(self, raw: str) -> None:
        if self._hidden:
            return
        if not raw or raw.isspace():
            if raw and self._parts:
                self._parts.append(" ")
            return
        text = unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        _, _, apart, hint = self._stack[-1]
        kind = "apart" if apart else "link" if self._link else "heading" if self._inline in _HEADING else "paragraph" if self._inline in _PARAGRAPH else "bare"
        if hint >= 0 and not apart:
            kind = f"doubtful {kind}"
        self.items.append((kind, len(text.split()), len(self.blocks), hint))

    def _end(self) -> None:
        if self._parts:
            if text := " ".join("".join(self._parts).split()):
                _, container, apart, hint = self._stack[-1]
                self.blocks.append((text, container, apart, hint))
            self._parts = []

    def _shut(self, size: int) -> None:
        """Close what is open beyond this depth."""
        for name, container, _, _ in self._stack[size:]:
            self._count[name] -= 1
            if container < 0:
                self._hidden -= 1
            else:
                self.after[container] = len(self.names)
        del self._stack[size:]

    def _open(self, name: str, attributes: str, at: int) -> None:
        if name in _BLOCK:
            self._shut(next(i for i in range(len(self._stack), 0, -1) if self._stack[i - 1][1] >= 0))  # inline ones end here
            self._end()
            self._inline, self._link = name, False
        if name == "a":
            self._link = True
        elif name == "br":
            self._parts.append(" ")
        if name in ("article", "main") and self._stack[-1][2]:
            first = next(i for i, s in enumerate(self._stack) if s[2])
            if not re.compile(f"</{re.escape(self._stack[first][0])}", re.I).search(self._html, at):
                self._shut(first)  # never closed: it ended before
        _, container, apart, hint = self._stack[-1]
        self.items.append(("apart" if apart or self._hidden else f"<{name}>", 1, len(self.blocks), hint))
        standing = _standing(name, attributes) if attributes or name in _APART or name in _APART_INLINE else CLEAR
        if name in _BLOCK and (name in _CONTAINER or standing):
            within = next(s[1] for s in reversed(self._stack) if s[1] >= 0)
            own = name == "header" and self.article[within]  # of the article, not of the page
            if standing == HINT and hint < 0 and not apart:
                hint, self.hints = self.hints, self.hints + 1
            self.names.append(name)
            self.parent.append(within)
            self.after.append(0)
            self.article.append(self.article[within] or name in ("article", "main"))
            self._push(name, len(self.names) - 1, apart or standing == APART and not own, hint)
        elif standing == APART and name not in _VOID:
            self._hidden += 1
            self._push(name, -1, True, hint)

    def _push(self, name: str, container: int, apart: bool, hint: int) -> None:
        self._count[name] += 1
        self._stack.append((name, container, apart, hint))

    def _close(self, name: str) -> None:
        if name in _BLOCK:
            self._end()
            self._inline, self._link = "", False
        if name == "a":
            self._link = False
        _, _, apart, hint = self._stack[-1]
        self.items.append(("apart" if apart or self._hidden else f"<{name}>", 1, len(self.blocks), hint))
        if self._count[name]:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == name:
                    self._shut(i)
                    break
                if self._stack[i][0] in ("td", "th", "table") and name not in ("table", "tr", "tbody", "html", "body"):
                    break

    def _read(self, html: str) -> None:
        at, n, low = 0, len(html), None
        while at < n:
            cut = html.find("<", at)
            if cut < 0:
                self._text(html[at:])
                return
            if cut > at:
                self._text(html[at:cut])
            if html.startswith("<!--", cut):
                end = html.find("-->", cut + 4)
                at = n if end < 0 else end + 3
                continue
            m = _TAG.match(html, cut)
            if m is None:
                if html[cut + 1 : cut + 2] in ("!", "?", "/"):
                    end = html.find(">", cut)
                    at = n if end < 0 else end + 1
                elif html[cut + 1 : cut + 2].isalpha() and html.find(">", cut) < 0:
                    return  # a tag that the page's end cuts off
                else:
                    self._text("<")
                    at = cut + 1
                continue
            name, at = m[1].lower(), m.end()
            if html[cut + 1] == "/":
                self._close(name)
            elif name in _RAW:
                low = low or html.lower()
                end = low.find(f"</{name}", at) if len(low) == n else re.compile(f"</{name}", re.I).search(html, at)
                end = end if isinstance(end, int) else end.start() if end else -1
                stop = html.find(">", end) if end >= 0 else -1
                at = n if stop < 0 else stop + 1
            else:
                self._open(name, m[2], at)


def _labelled_pages(seed: int, n: int) -> Iterator[list[tuple[str, bool]]]:
    """Pages as parts of html with their label: content or not."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(("an", "the", "er", "on", "re", "is", "en", "at", "lo", "mi", "ka", "ti")) for _ in range(r.randint(1, 4)))
    say = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    links = lambda a, b: "".join(f'<li><a href="/{word()}">{say(1, 3)}</a></li>' for _ in range(r.randint(a, b)))
    doubtful = sorted(_DOUBTFUL)
    for _ in range(n):
        head = [("<!DOCTYPE html><html><head><meta charset='utf-8'><title>" + say(3, 9) + "</title><style>p{}</style><script>var a = 1;</script></head><body>", False)]
        before = [
            ("<nav><ul>" + links(3, 9) + "</ul></nav>", False),
            ("<header><a href='/'>" + say(1, 3) + "</a></header>", False),
            ("<div class='ad'>" + say(3, 14) + "</div>", False),
            ("<div id='cookie-notice'><p>" + say(8, 20) + "</p><button>" + word() + "</button></div>", False),
            ("<form action='/s'><input name=q><button>" + word() + "</button></form>", False),
            ("<div>" + "".join(f"<a href='/{word()}'>{word()}</a> | " for _ in range(r.randint(3, 8))) + "</div>", False),
            (f"<div class='{r.choice(doubtful)}'><p>{say(3, 10)}</p></div>", False),
        ]
        after = [
            ("<aside><h3>" + say(1, 3) + "</h3><ul>" + links(3, 8) + "</ul></aside>", False),
            ("<div class='sidebar'><p>" + say(5, 15) + "</p></div>", False),
            ("<div class='comments'><h3>" + say(1, 2) + "</h3>" + "".join(f"<div class='comment'><p>{say(4, 25)}</p></div>" for _ in range(r.randint(1, 4))) + "</div>", False),
            ("<footer>&copy; " + say(4, 20) + " <a href='/'>" + word() + "</a></footer>", False),
            ("<ul>" + links(3, 8) + "</ul>", False),
            (f"<div class='{r.choice(doubtful)}'>{say(1, 4)}<ul>{links(3, 8)}</ul></div>", False),
        ]
        wrap = r.choice((("<article>", "</article>"), ("<main>", "</main>"), ("<div class='content'>", "</div>"), ("<div>", "</div>"), ("<section>", "</section>")))
        body = [(wrap[0], True)]
        if r.random() < 0.8:
            body.append((f"<h1>{say(3, 10)}</h1>", True))
        for _ in range(r.randint(1, 12)):
            body.append((r.choice(("<p>{}</p>", "<p>{}</p>", "<p>{}</p>", "<p><b>{}<br>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<p><a href='/x'>" + word() + "</a> {}</p>")).format(say(1, 60)), True))
        if r.random() < 0.2:
            body.append((f"<section class='{r.choice(doubtful)}'><p>{say(30, 60)}</p><p>{say(30, 60)}</p></section>", True))
        body.append((wrap[1], True))
        yield [*head, *r.sample(before, r.randint(1, 4)), *body, *r.sample(after, r.randint(1, 4)), ("</body></html>", False)]


#: Of a tag that no labelled page has.
UNKNOWN_TAG = -0.3
#: The key of the sum that a doubtful element must pass to stay.
DOUBTFUL = "doubtful"


@cache
def weights() -> dict[str, float]:
    """Log-odds of content for each kind of item, tags lowered by a constant, and the sum
    that parts doubtful elements of the labelled pages best."""
    counts = {True: Counter(), False: Counter()}
    doubtful: list[tuple[Page, bool]] = []
    for parts in _labelled_pages(17, 400):
        for html, label in parts:
            page = Page(html)
            doubtful += [(page, label)] * bool(page.hints)
            for kind, n, _, _ in page.items:
                counts[label][kind] += n
    total = {k: sum(c.values()) for k, c in counts.items()}
    out = {}
    for kind in {*counts[True], *counts[False]}:
        odds = log((counts[True][kind] + 0.5) / total[True]) - log((counts[False][kind] + 0.5) / total[False])
        out[kind] = max(-4.0, min(2.0, odds)) if kind[0] != "<" else min(-0.05, max(-4.0, odds - 1.0))
    sums = sorted((t, label) for page, label in doubtful for t in _doubtful_sums(page, out))
    wrong = [sum(label for _, label in sums[:k]) + sum(not label for _, label in sums[k:]) for k in range(1, len(sums))]
    k = wrong.index(min(wrong)) + 1
    return out | {DOUBTFUL: (sums[k - 1][0] + sums[k][0]) / 2}




def best_region(scores: Iterable[float]) -> tuple[int, int] | None:
    """The contiguous run (first, last) of the greatest sum over zero, the earliest and
    then the longest of equals; None if there is none."""
    best, region, total, start = 0.0, None, 0.0, 0
    for i, score in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, region = total, (start, i)
    return region


def _doubtful_sums(page: Page, score: dict[str, float]) -> list[float]:
    """The sum of the words that each doubtful element holds."""
    total = [0.0] * page.hints
    for kind, n, _, hint in page.items:
        if hint >= 0 and kind[0] != "<":
            total[hint] += n * score.get(kind, UNKNOWN_TAG) * (kind != "apart")
    return total


def _holder(page: Page, first: int, last: int) -> int:
    """The innermost container that holds two others."""
    while not first <= last < max(page.after[first], first + 1):
        first = page.parent[first]
    return first


def main_text(html: str, score: dict[str, float]) -> str:
    page = Page(html)
    dropped = [t <= score[DOUBTFUL] for t in _doubtful_sums(page, score)]
    blocks = [(text, c) for text, c, apart, hint in page.blocks if not apart and not (hint >= 0 and dropped[hint])]
    number = [-1]  # of the last kept block up to each block
    for _, _, apart, hint in page.blocks:
        number.append(number[-1] + (not apart and not (hint >= 0 and dropped[hint])))
    items = [x for x in page.items if x[0] != "apart" and not (x[3] >= 0 and dropped[x[3]])]
    region = best_region(n * score.get(kind, UNKNOWN_TAG) for kind, n, _, _ in items)
    if region is None or not blocks:
        return ""
    first, last = (number[min(items[i][2] + k, len(page.blocks))] + 1 - k for i, k in zip(region, (0, 1), strict=True))
    inside = blocks[first : last + 1]
    if not inside:
        return ""
    size = sum(len(text) for text, _ in inside)
    own = [(text, c) for text, c in inside if page.article[c]]
    if 3 * sum(len(text) for text, _ in own) >= size:  # an article element holds a third of the region or more
        inside = own
    common = inside[0][1]
    for _, c in inside:
        common = _holder(page, min(common, c), max(common, c))
    while common and page.names[common] in ("ul", "ol", "dl", "table", "tbody", "tr", "td", "blockquote", "figure"):
        common = page.parent[common]
    top = common
    while top > 0:  # the outermost article that holds it
        if page.names[top] in ("article", "main"):
            common = top
        top = page.parent[top]
    if page.names[common] not in ("", "html", "body"):
        return "\n".join(text for text, c in blocks if common <= c < page.after[common])
    return "\n".join(text for text, _ in blocks[first : last + 1])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    sent = pages.sparkSession.sparkContext.broadcast(weights())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value
        for batch in batches:
            texts = [main_text(h.as_py() or "", score) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERY, ORACLE = ("op4_html", op4_html), None
