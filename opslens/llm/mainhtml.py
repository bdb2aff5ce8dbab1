"""Main text of web pages by the distribution of line blocks.

Markup becomes lines: one per block of text, empty ones where something was taken out and around the
article. The sum of text lengths over a sliding window of lines surges where running text begins and
dives to zero where it ends; what lies between is kept, whatever the length of its single lines. Tags
and class words weigh the lines: what they tell to be no article is an empty line, and a line of an
article that holds the page's text is a surge by itself.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType

# Lines in a window, and the sum that counts as a surge.
LINES = 3
SURGE = 86
# Least text of an element, or around the articles, that can outweigh a class word or an article tag.
FLOOR = 3 * SURGE

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[a-zA-Z!?/][^>]*(?:>|\Z)",
    re.S,
)
# A whole attribute: its name, then its value if it has one.
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_READ = {"class", "id", "role"}

# Their content is text to the parser, up to the closing tag.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "title", "xmp", "noembed", "noframes"}
# Never part of the main text.
SKIPPED = {
    "head", "nav", "header", "footer", "aside", "form", "button", "select", "dialog", "menu", "svg",
    "canvas", "object", "audio", "video", "map",
}
VOID = {
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source",
    "track", "wbr",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font",
    "i", "img", "input", "ins", "kbd", "label", "mark", "meter", "nobr", "output", "progress", "q", "rp",
    "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "wbr",
}
# As inline, but they part words.
SPACES = {"br", "td", "th"}
# Words of a class, id or role that mark what is not the article.
MARKED = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "sidebar", "complementary", "menu", "navbar", "navigation", "nav",
    "breadcrumb", "breadcrumbs", "pagination", "header", "masthead", "footer", "contentinfo", "search",
    "comment", "comments", "disqus", "respond", "replies", "related", "recommended", "share", "sharing",
    "social", "widget", "disclaimer",
}
# Beside one of these a marked word tells how a page is laid out: "no-sidebar", "search-results-page".
STATES = {
    "no", "with", "without", "has", "page", "wrap", "wrapper", "container", "layout", "content", "results",
    "open", "closed", "enabled", "disabled", "left", "right", "site", "body", "main",
}
# On one of these only the first words tell: a paragraph may be an advert or a notice, but it is no menu.
TEXTUAL = {"p", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "th", "figure", "figcaption"}
NO_TEXT = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo",
    "banner", "cookie", "cookies", "consent", "notice", "notices", "alert", "popup", "modal", "overlay",
    "newsletter", "subscribe", "signup", "comment", "comments", "disclaimer",
}
# Within these, class words color code.
CODE = {"pre", "code"}
_MARK_WORD = re.compile(r"[a-z]+")
ARTICLE = {"article", "main"}


class Line(NamedTuple):
    text: str
    inside: bool  # in an article


class Mark:
    """A marked element: whether its words may tell the layout only, and the text found in it."""

    def __init__(self, weak: bool) -> None:
        self.weak, self.size, self.in_article = weak, 0, 0

    def holds_the_page(self, total: int, in_articles: int) -> bool:
        """Its own text outweighs the rest, so it is a wrapper and no side matter."""
        rest = total - self.size
        if self.size < FLOOR or self.size <= rest:
            return False
        if in_articles >= SURGE:
            return 2 * self.in_article > in_articles
        return self.weak or rest < SURGE


def _marked(name: str, attrs: str) -> Mark | bool:
    """True if hidden, a Mark if a class, id or role says that this is no main text, else False."""
    found, words = [], NO_TEXT if name in TEXTUAL else MARKED
    for key, *values in _ATTR.findall(attrs):
        key, value = key.lower(), next((v for v in values if v), "").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        if key not in _READ:
            continue
        # The page itself and its article may bear any class, such as "has-sidebar".
        if name in ARTICLE and not {"comment", "comments"} & set(_MARK_WORD.findall(value)):
            continue
        if name in ("html", "body"):
            continue
        found += [parts for word in value.split() if (parts := set(_MARK_WORD.findall(word))) & words]
    return Mark(all(parts & STATES for parts in found)) if found else False


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, with empty lines for what is left out and around articles.

    A marked element is left out unless it holds the page; how much text each has is measured first.
    """
    marks: dict[int, Mark] = {}
    lines = _lines(page, marks, None)
    if not marks:
        return lines
    total = sum(len(line.text) for line in lines)
    in_articles = sum(len(line.text) for line in lines if line.inside)
    return _lines(page, marks, {at for at, m in marks.items() if not m.holds_the_page(total, in_articles)})


def _lines(page: str, marks: dict[int, Mark], skipped: set[int] | None) -> list[Line]:
    """Lines without the elements that start at the ``skipped`` places. None: without hidden ones
    only, while ``marks`` gets the marked ones by their place, and marked articles count as none."""
    lines: list[Line] = []
    parts: list[str] = []
    open_tags: list[str] = []
    # Where each tag's elements are open, so that an end tag finds its own at once.
    places: dict[str, list[int]] = {}
    # Depth of open_tags at which the outermost skipped element began.
    skip_from: int | None = None
    articles = 0
    # Open marked elements by their depth, and how many of the open tags hold code.
    open_marks: list[tuple[int, Mark]] = []
    plain_articles: set[int] = set()
    code = 0
    lowered = None

    def end_block(gap: int = 0) -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                lines.append(Line(text, articles > 0))
                if open_marks:  # the marks around it get it when this one ends
                    open_marks[-1][1].size += len(text)
                    open_marks[-1][1].in_article += len(text) if articles else 0
            parts.clear()
        # Elements that are left out one after the other are one gap.
        if gap > 1 or gap and not (lines and not lines[-1].text):
            lines.extend([Line("", False)] * gap)

    def closed(depth: int) -> None:
        nonlocal code
        while open_marks and open_marks[-1][0] >= depth:
            _, mark = open_marks.pop()
            if open_marks:
                open_marks[-1][1].size += mark.size
                open_marks[-1][1].in_article += mark.in_article
        while len(open_tags) > depth:
            tag = open_tags.pop()
            places[tag].pop()
            plain_articles.discard(len(open_tags))
            code -= tag in CODE

    at = 0
    while (m := _TOKEN.search(page, at)) is not None:
        if skip_from is None and m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if places.get(name):
                depth = places[name][-1]
                if skip_from is None:
                    if name not in INLINE and name not in SPACES:
                        end_block()
                    elif name in SPACES:
                        parts.append(" ")
                    gone = sum(d not in plain_articles for d, t in enumerate(open_tags[depth:], depth) if t in ARTICLE)
                    if gone:
                        end_block(LINES)
                        articles -= gone
                    closed(depth)
                elif depth >= skip_from or depth < skip_from and name not in INLINE:
                    # An element that ends takes those along that it holds, skipped ones too.
                    if depth <= skip_from:
                        articles -= sum(d not in plain_articles for d in range(depth, skip_from) if open_tags[d] in ARTICLE)
                        skip_from = None
                        end_block(1)
                    closed(depth)
            elif skip_from is None and name not in INLINE:
                end_block()
            continue
        if name in RAW and not m["attrs"].endswith("/"):
            if lowered is None:
                lowered = page.lower()
            end = lowered.find(f"</{name}", at)
            at = len(page) if end < 0 else end
            if end >= 0 and (close := page.find(">", end)) >= 0:
                at = close + 1
            continue
        if skip_from is None:
            if name in SPACES:
                parts.append(" ")
            elif name not in INLINE:
                end_block()
        if name in VOID or m["attrs"].endswith("/"):
            continue
        mark = _marked(name, m["attrs"]) if skip_from is None and not code else False
        if skip_from is None and (name in SKIPPED or mark is True or skipped is not None and m.start() in skipped):
            skip_from = len(open_tags)
        if name == "p" and open_tags and open_tags[-1] == "p" and skip_from != len(open_tags):
            closed(len(open_tags) - 1)
        if skip_from is None and name in ARTICLE:
            end_block(LINES)
            if skipped is None and mark:
                plain_articles.add(len(open_tags))
            else:
                articles += 1
        if skipped is None and skip_from is None and mark:
            marks[m.start()] = mark
            open_marks.append((len(open_tags), mark))
        code += name in CODE
        places.setdefault(name, []).append(len(open_tags))
        open_tags.append(name)
    if skip_from is None and at < len(page):
        parts.append(page[at:])
    end_block()
    closed(0)
    return lines


def between(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of lines between a surge and a dive of the window sums.

    A run ends where a whole window is empty. It counts if a window within reaches SURGE, or, where
    none does, the largest sum there is, so that a short article is kept as well.
    """
    sums = [sum(sizes[i : i + LINES]) for i in range(len(sizes))]
    need = min(SURGE, max(sums, default=0))
    if not need:
        return []
    runs, start, peak, empty = [], None, 0, 0
    for i, size in enumerate(sizes):
        if size:
            start, empty = (i if start is None else start), 0
        else:
            empty += 1
        if start is not None:
            peak = max(peak, sum(sizes[max(start, i - LINES + 1) : i + 1]))
            if empty == LINES or i == len(sizes) - 1:
                if peak >= need:
                    runs.append((start, i + 1 - empty))
                start, peak = None, 0
    return runs


def weights(lines: list[Line]) -> list[int]:
    """What each line counts in a window: its length. Where articles hold the running text of the page
    their lines count as much as a surge besides, and all others as empty."""
    sizes = [len(line.text) for line in lines]
    inside = sum(n for n, line in zip(sizes, lines) if line.inside)
    if not inside:
        return sizes
    around = [0 if line.inside else n for n, line in zip(sizes, lines)]
    running = sum(sum(around[a:b]) for a, b in between(around))
    if running >= FLOOR and running > inside:
        return sizes
    return [n + SURGE if line.inside and n else 0 for n, line in zip(sizes, lines)]


def main_text(page: str | None) -> str:
    """The blocks between a surge and a dive of the window sums, two line feeds between them."""
    lines = lines_of(page or "")
    counts = weights(lines)
    return "\n\n".join(lines[i].text for a, b in between(counts) for i in range(a, b) if counts[i])


@F.arrow_udf(StringType())
def extracted(column: pa.Array) -> pa.Array:
    return pa.array([main_text(page) for page in column.to_pylist()], pa.string())


def main_texts(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, url, text (empty if there is none), n_chars.

    A null page is empty. Other columns are not read.
    """
    found = pages.select(id_col, url_col, extracted(F.col(html_col)).alias("text"))
    return found.withColumn("n_chars", F.length("text").cast("bigint"))
