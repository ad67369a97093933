"""Main text of web pages by the distribution of text over blocks of lines.

Markup is stripped into lines, one per block element; what lies in menus, forms and the like becomes blank lines.  Text
lengths are summed over sliding windows of lines.  A surge, a window with enough text behind windows without, begins the
main text, a dive to windows without any text ends it, and what lies between is kept.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablescope.llm.common import by_text

WINDOW = 3
#: Characters in a window that make a surge; inside an article element any text does.
SURGE = 80

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
WORDS = re.compile(r"[a-z]+")

#: Elements whose content is not markup.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
#: Elements that hold no main text.
ASIDE = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "select", "button", "svg", "canvas", "object", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "menu", "menubar"}
#: Words of class and id values that mark such elements.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav",
    "navbar", "navigation", "newsletter", "notice", "pagination", "pager", "popup", "promo", "related", "replies", "reply",
    "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "nobr", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr", "input", "br",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}


def _aside(name: str, attributes: str, in_article: bool) -> bool:
    if name in ASIDE or (name == "header" and not in_article):
        return True
    if "=" not in attributes and "hidden" not in attributes:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        value = "".join(values).lower()
        key = key.lower()
        if key == "role" and value in ROLES or key == "aria-hidden" and value == "true":
            return name not in ("html", "body", "article", "main")
        if key in ("class", "id") and not MARKS.isdisjoint(WORDS.findall(value)):
            return name not in ("html", "body", "main")
        if key == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", attributes))


@lru_cache(maxsize=None)
def _raw_end(name: str) -> re.Pattern:
    """The closing tag of a raw-text element, ASCII letters in any case."""
    return re.compile(rf"</{re.escape(name)}", re.IGNORECASE | re.ASCII)


def lines_of(page: str) -> list[tuple[str, int, bool]]:
    """(text, characters outside links, in an article) of every line; an empty text is a blank line."""
    lines: list[tuple[str, int, bool]] = []
    held: list[str] = []
    linked = links = articles = 0
    stack: list[tuple[str, bool]] = []  # open block elements, and whether they hold no main text
    shut = 0  # open elements without main text
    at, end = 0, len(page)

    def close_line() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text:
            lines.append((text, len(text) - min(linked, len(text)), articles > 0))
        held.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not shut:
            held.append(text)
            if links:
                linked += len(" ".join(text.split()))

    while at < end:
        tag = TAG.search(page, at)
        if tag is None:
            rest = page[at:]
            cut = re.search(r"<[/A-Za-z!][^<]*\Z", rest)  # a tag that the page's end cuts off
            add(rest[: cut.start()] if cut else rest)
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                if name == "br":
                    add(" ")
                continue
            close_line()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                for gone, closed in stack[depth:]:
                    shut -= closed
                    articles -= gone in ("article", "main")
                del stack[depth:]
                if not shut:
                    lines.append(("", 0, articles > 0))
            continue
        if name in RAW:
            found = _raw_end(name).search(page, at)  # on the page itself: lower-casing may change its length
            close_line()
            if found is None:
                break
            stop = found.start()
            after = page.find(">", stop)
            at = after + 1 if after >= 0 else end
            continue
        if name == "br":
            add(" ")
            continue
        if name == "a":
            links += 1
        if name == "body":  # nothing of the head is open any more
            close_line()
            stack.clear()
            shut = articles = 0
        aside = _aside(name, tag[3], articles > 0)
        if name in INLINE:
            if not aside or name in VOID or tag[3].endswith("/"):
                continue
        if name in VOID or tag[3].endswith("/"):
            close_line()
            continue
        close_line()
        if name == "p" and stack and stack[-1][0] == "p" or name == "li" and stack and stack[-1][0] == "li":
            shut -= stack.pop()[1]
        if aside and not shut:
            lines += [("", 0, articles > 0)] * WINDOW
        stack.append((name, aside))
        shut += aside
        articles += name in ("article", "main") and not shut
        if name in ("article", "main") and shut:
            stack[-1] = (name + "-shut", aside)
    close_line()
    return lines


def main_text(page: str) -> str:
    """The kept lines joined by line breaks; empty if there are none."""
    lines = lines_of(page)
    if not lines:
        return ""
    inside = np.array([a for _, _, a in lines])
    # outside articles, lines that are mostly links weigh nothing
    size = np.array([len(t) if a or 2 * free >= len(t) else 0 for t, free, a in lines])
    # element ends are blank lines of no height; blank lines of dropped parts come in whole windows
    heavy = np.array([bool(t) for t, _, _ in lines])
    gap = np.zeros(len(lines), np.int64)
    run = 0
    for i, h in enumerate(heavy.tolist()):
        run = 0 if h else run + 1
        gap[i] = run
    dive = np.flatnonzero(gap >= WINDOW)
    borders = np.zeros(len(lines) + 1, np.int64)
    borders[dive] = 1
    region = np.cumsum(borders[:-1])
    kept: list[str] = []
    best, best_sum = -1, 0
    spans = []
    for r in np.unique(region):
        rows = np.flatnonzero((region == r) & heavy)
        if not len(rows):
            continue
        sums = np.convolve(size[rows], np.ones(WINDOW, np.int64))
        surge = bool((sums >= SURGE).any() or (inside[rows] & (size[rows] > 0)).any())
        spans.append((rows, surge, bool(inside[rows].any())))
        if size[rows].sum() > best_sum:
            best, best_sum = len(spans) - 1, int(size[rows].sum())
    any_article = any(s[2] and s[1] for s in spans)
    for k, (rows, surge, article) in enumerate(spans):
        if any_article:
            rows = rows[inside[rows]]
        elif not surge and not (k == best and not any(s[1] for s in spans)):
            continue
        if any_article and not article:
            continue
        # from the first line that carries the surge to the last before the dive
        weights = np.flatnonzero(size[rows] > 0)
        if len(weights):
            kept += [lines[i][0] for i in rows[weights[0] : weights[-1] + 1] if size[i] > 0 or inside[i]]
    return "\n".join(kept)


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """Key, address, text and n_chars (code points) of every page; null and empty pages give an empty text.

    Every input row gives a row, other columns are not read.  One pass, no shuffle.
    """
    both = pages.select(F.struct(F.col(key).alias("k"), F.col(url).alias("u")).alias("_both"), F.col(page).alias("_page"))

    def work():
        def act(texts: list[str]) -> dict[str, list]:
            found = [main_text(t) for t in texts]
            return {"text": found, "n_chars": [len(t) for t in found]}

        return act

    out = by_text(both, "_both", "_page", work, "text string, n_chars long")
    return out.select(F.col("_both.k").alias(key), F.col("_both.u").alias(url), "text", "n_chars")
