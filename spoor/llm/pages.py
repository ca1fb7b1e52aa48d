"""Main text of web pages by the distribution of text over line blocks.

A page is read as lines: the stretches of text between block-level tags, markup stripped. Lines
of navigation, adverts, forms and the like count as empty, and so do lines that are mostly links,
unless such a line is a paragraph among others. A form with most of a page's text is the page.
The sum of text lengths over a window of neighbouring lines shows where the page's text lies: it
starts where the sum surges and ends where it dives to nothing. The text between is kept whole.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from spoor.llm.common import over_batches

#: Lines in a window: a gap of fewer empty lines does not end a region.
WINDOW = 5
#: Window sum at which text surges, in code points.
SURGE = 80
#: Least share of the largest region that another region needs to be kept.
SHARE = 0.2
#: Share of a line's text inside links from which it counts as a menu.
LINKS = 0.6
#: Share of a page's text from which a form around it is no form of a page, but around the page.
WRAPPED = 0.75

#: Elements whose content is no text, elements around a text, elements that end a
#: line, and words in class, id or role that name surroundings.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object",
       "canvas", "math", "select", "option"}
AROUND = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "label",
          "fieldset", "video", "audio"}
BLOCKS = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div",
          "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "head", "hgroup",
          "hr", "html", "legend", "li", "main", "ol", "p", "pre", "search", "section", "summary",
          "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"} | AROUND
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source",
        "track", "wbr"}
#: Elements without text that a block-level tag ends: always, or if nothing else does.
SHORT, UNCLOSED = {"option", "title"}, {"object", "select", "iframe", "canvas", "svg", "math"}
FORMS = {"form", "fieldset"}
#: Elements that the start of another block ends.
OPEN_ENDED = {"p", "li", "dd", "dt", "td", "th", "tr", "option"}
NAMES = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs",
         "comment", "comments", "complementary", "consent", "contentinfo", "cookie", "cookies",
         "disqus", "footer", "gdpr", "header", "masthead", "menu", "menubar", "modal", "nav",
         "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
         "promoted", "related", "replies", "reply", "respond", "search", "share", "sharing",
         "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
#: Parts of a class name that stand beside such a word without another meaning.
PARTS = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "column",
         "container", "content", "form", "global", "group", "icons", "inner", "item", "items",
         "left", "link", "links", "list", "main", "outer", "page", "panel", "primary", "right",
         "row", "secondary", "section", "site", "slot", "text", "thread", "title", "top", "unit",
         "user", "wrap", "wrapper"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")
_ENDS = re.compile(r"<(?=/?(?:%s|option|datalist|select)\b)" % "|".join(sorted(BLOCKS)), re.I)
_SPACE = re.compile(r"\s+")


def _names_surroundings(name: str) -> bool:
    """Whether a class, id or role is a word of ``NAMES``, alone or with parts that add no sense."""
    parts = [part for part in _SPLIT.split(name.lower()) if part and not part.isdigit()]
    return any(part in NAMES for part in parts) and all(
        part in NAMES or part in PARTS for part in parts
    )


def _form_sizes(html: str) -> tuple[dict[int, int], int]:
    """Code points of text inside each closed form, by the place after its tag, and in all."""
    sizes: dict[int, int] = {}
    opened: list[tuple[str, int, int]] = []
    total = at = 0
    for tag in _TAG.finditer(html):
        total += len(html[at : tag.start()].strip())
        at = tag.end()
        name = (tag[2] or "").lower()
        if name in FORMS:
            if not tag[1]:
                opened.append((name, at, total))
            elif opened and opened[-1][0] == name:
                _, place, before = opened.pop()
                sizes[place] = total - before
    return sizes, total + len(html[at:].strip())


def _surrounds(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in AROUND and not (tag == "header" and in_article):
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for groups in _NAMED.findall(attributes):
        if any(map(_names_surroundings, "".join(groups).split())):
            return not (in_article and tag in ("h1", "h2", "h3", "header"))
    return False


def lines_of(html: str) -> list[tuple[str, int, int]]:
    """The lines of a page outside of its surroundings, in page order.

    Each is (text, code points inside links, place): the place is 2 for a paragraph of an article,
    1 for one elsewhere, else 0. An empty text stands for a block of surroundings outside of
    articles; inside of them such a block is no gap.
    """
    lines: list[tuple[str, int, int]] = []
    parts: list[str] = []
    links = article = anchor = at = 0
    skip, depth, block = "", 0, ""
    forms, total = _form_sizes(html) if "<form" in html.lower() or "<fieldset" in html.lower() else ({}, 0)
    never_closed: set[str] = set()

    def end_line() -> None:
        nonlocal links
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            lines.append((text, links, (1 + (article > 0)) * (block == "p")))
        parts.clear()
        links = 0

    def take(text: str) -> None:
        nonlocal links
        if text and not skip:
            parts.append(text)
            if anchor:
                links += len(unescape(text).strip())

    while True:
        tag = _TAG.search(html, at)
        take(html[at : tag.start() if tag else len(html)])
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            if tag[0].startswith("<![CDATA["):
                take(tag[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        closing, name = bool(tag[1]), tag[2].lower()
        if name in RAW and not closing:
            if tag[3].rstrip().endswith("/") and name not in ("script", "style", "title"):
                continue
            end = None
            if name not in never_closed:
                end = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(html, at)
                if not end:
                    never_closed.add(name)
            after = end.end() if end else len(html)
            if name in SHORT or not end and name in UNCLOSED:
                block_at = _ENDS.search(html, at, after)
                after = block_at.start() if block_at and not (end and block_at.start() >= end.start()) else after
            at = after
            continue
        if name in BLOCKS:
            end_line()
            block = "" if closing else name
        if skip:
            # An article ends what was left open; an open-ended element ends with the next block.
            over = not closing and (
                name in ("article", "main") and skip not in ("article", "main")
                or skip in OPEN_ENDED and name in BLOCKS
            )
            if not over:
                if name == skip:
                    depth += -1 if closing else 1
                elif closing and skip in OPEN_ENDED and name in BLOCKS:
                    depth = 0
                if depth <= 0:
                    skip = ""
                continue
            skip = ""
        if name in ("article", "main"):
            article = max(0, article + (-1 if closing else 1))
        elif name == "a":
            anchor = 0 if closing else 1
        elif name == "br":
            parts.append(" ")
        around = name in FORMS and forms.get(at, 0) > WRAPPED * total
        if not closing and not around and name not in VOID and _surrounds(name, tag[3], article > 0):
            end_line()
            if not article:
                lines.append(("", 0, 0))
            skip, depth = name, 1
            anchor = 0
    end_line()
    return lines


def kept_lines(lines: list[tuple[str, int, int]]) -> list[str]:
    """The lines between the surges and dives of the distribution."""
    sizes = np.array([len(t) for t, _, _ in lines], np.int64)
    if not sizes.sum():
        return []
    menu = np.array([n > LINKS * max(len(t), 1) for t, n, _ in lines])
    # A link alone among text is part of it: a paragraph between two lines of text, or, in an
    # article, one without another link beside it.
    text = np.concatenate([[False], (sizes > 0) & ~menu, [False]])
    near = np.concatenate([[False], menu, [False]])
    place = np.array([p for _, _, p in lines])
    both, none = text[:-2] & text[2:], ~near[:-2] & ~near[2:]
    menu &= ~(((place == 1) & both) | ((place == 2) & none))
    sizes[menu] = 0
    if not sizes.sum():
        return []
    # The sum at a line is that of the lines around it: zero means that text is far away.
    half = WINDOW // 2
    sums = np.convolve(sizes, np.ones(WINDOW, np.int64))[half : half + len(sizes)]
    steps = np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]]))
    regions = list(zip(np.flatnonzero(steps == 1), np.flatnonzero(steps == -1)))
    totals = [int(sizes[a:b].sum()) for a, b in regions]
    most = max(totals)
    kept = []
    for (a, b), total in zip(regions, totals):
        surges = sums[a:b].max() >= SURGE and total >= SHARE * most
        if surges or total == most:
            kept += [lines[i][0] for i in range(a, b) if sizes[i]]
    return kept


def main_text(html: str | None) -> str:
    """The main text of a page, its blocks joined by an empty line; empty if there is none."""
    return "\n\n".join(kept_lines(lines_of(html or "")))


def extract_pages(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """``key, url, text, n_chars``, one row per page; a null or empty page has an empty text.

    Pages are read one by one, so repeated rows and null ids give rows like others. An empty
    table gives no rows.
    """
    names = [pages.schema[c] for c in (key, url)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in names)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        htmls = batch.column(2)
        texts = [main_text(htmls[i].as_py()) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
             pa.array(map(len, texts), pa.int64())],
            names=[key, url, "text", "n_chars"],
        )

    return over_batches(pages.select(key, url, html), work, f"{schema}, text string, n_chars long")
