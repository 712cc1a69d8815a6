"""Operator 4: main text of web pages by line-block distribution.

The markup is stripped into lines, one per block element, in page order. Every
line has a weight: its characters outside links, or 0 when it lies in page
furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader
comments; told by element, role, class and id). The weights are summed over
sliding windows of ``WINDOW`` lines, on every page. A text begins at the line
where the sums surge and ends where they dive to nothing; what lies between is
kept, lines that are all link included. Lines that no window reaches, link
lists above all, are dropped.

Marks of articles and of a main part are weighed against that. Where the marked
parts hold more than the stretches outside them, they are the text, link lines
included; else (a small marked card beside a body without marks) both are kept.

The time is linear in the page, whatever its markup: tags end at the next "<",
open elements are found by name, and what an element lies in is a shared chain.
"""

from __future__ import annotations

import html as entities
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrubsearch.llm.common import as_text, fresh, map_rows

WINDOW = 3

# Fixed: elements by their role in a page.
SKIPPED = {"script", "style", "noscript", "template", "textarea", "select", "svg", "math", "iframe",
           "object", "canvas", "title", "audio", "video"}
FURNITURE = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog",
          "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
          "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav",
          "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead",
          "tr", "ul", *SKIPPED}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
# An element ends one of the first kind that is open inside the second.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
        "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
        "th": ({"td", "th"}, {"tr", "table"})}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog",
         "form", "menu", "menubar", "toolbar"}
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb",
         "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disclaimer", "disqus", "footer",
         "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice",
         "notices", "notification", "overlay", "pager", "pagination", "popup", "promo", "promoted", "recommended",
         "related", "replies", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
         "subscribe", "toolbar", "widget"}
COMMENTS = {"comment", "comments", "disqus", "replies"}
# A class name that begins so tells of a state or a topic of an element, not what it is;
# one that ends so is told by the word before.
STATES = {"has", "with", "no", "without", "is", "not", "js", "tag", "category", "cat", "type", "format", "status"}
TAILS = {"list", "links", "buttons", "posts", "items", "slot", "unit", "area", "box", "block", "form", "bar"}

_TAG = re.compile(
    r"<!--(?:.*?-->|.*)|<[!?][^<>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.DOTALL)
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def class_word(value: str) -> str | None:
    """The word of ``NAMES`` that a class or id names an element by.

    That is a whole name or its last part: ``sidebar`` and ``post-comments``,
    but not ``has-sidebar`` or ``tag-related``.
    """
    for one in value.split():
        parts = [w.lower() for w in _PARTS.findall(one)]
        if not parts or len(parts) > 1 and parts[0] in STATES:
            continue
        while len(parts) > 1 and parts[-1] in TAILS:
            parts.pop()
        if parts[-1] in NAMES:
            return parts[-1]
    return None


def is_furniture(name: str, attrs: str) -> tuple[bool, str | None]:
    """Whether an element is no part of the text by its name, role or hidden mark; its word by class or id."""
    if name in FURNITURE:
        return True, None
    word = None
    if "=" in attrs:
        for m in _ATTR.finditer(attrs):
            key = m[1].lower()
            if key in ("class", "id", "role"):
                value = m[2] or m[3] or m[4] or ""
                if key == "role" and value.strip().lower() in ROLES:
                    return True, None
                if key != "role":
                    word = word or class_word(value)
    return re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", attrs) is not None if "hidden" in attrs else False, word


Line = tuple[str, int, bool, int, int]


def page_lines(page: str) -> list[Line]:
    """(text, weight, furniture, article, main) of each line of a page, in order.

    article and main are the running number of the outermost one, 0 outside.
    Class words never make furniture of an article or main (reader comments
    apart), nor of what holds main, nor of what holds the only articles.
    """
    lines, around_main, around = _lines(page, frozenset())
    if around_main:
        lines, _, more = _lines(page, around_main)
        around |= more
    if around and not any((article or main) and weight for _, weight, _, article, main in lines):
        lines, _, _ = _lines(page, around_main | around)
    return lines


def _lines(page: str, spared: frozenset[int]) -> tuple[list[Line], frozenset[int], frozenset[int]]:
    """Lines with the elements at ``spared`` not judged by class; where elements
    that are so judged begin, around or at a main, and an article."""
    lines: list[Line] = []
    # Open elements: name, furniture, article, main, and the chain (where, outer chain) of those
    # judged by class around its text. Where each name is open: places in the stack, ascending.
    stack: list[tuple[str, bool, int, int, tuple | None]] = []
    places: dict[str, list[int]] = {}
    around_main: set[int] = set()
    around: set[int] = set()
    words: list[str] = []
    chars = articles = mains = 0
    in_link = hidden_p = False
    at, end, lower = 0, len(page), page.lower()

    def flush() -> None:
        nonlocal words, chars
        text = " ".join("".join(words).split())
        words = []
        if text:
            _, furniture, article, main, _ = stack[-1] if stack else ("", False, 0, 0, None)
            furniture = furniture or hidden_p
            lines.append((text, 0 if furniture else chars, furniture, article, main))
        chars = 0

    def add(piece: str) -> None:
        nonlocal chars
        if piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            words.append(piece)
            if not in_link:
                chars += len(piece.strip())

    def close(k: int) -> None:
        """Close the element at place k and all inside it."""
        while len(stack) > k:
            places[stack.pop()[0]].pop()

    def innermost(names: set[str]) -> int:
        return max((places[n][-1] for n in names if places.get(n)), default=-1)

    def mark(found: set[int], chain: tuple | None) -> None:
        while chain is not None and chain[0] not in found:  # what is in it has its outer ones in it
            found.add(chain[0])
            chain = chain[1]

    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at: m.start()])
        at = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing, attrs = name.lower(), bool(m[1]), m[3]
        if name == "br":
            words.append(" ")
            continue
        if name == "a":
            in_link = not closing
        block = name in BLOCKS
        if block:
            flush()
            hidden_p = in_link = False
        if closing:
            if places.get(name):
                close(places[name][-1])
            continue
        if name in SKIPPED:
            if not attrs.rstrip().endswith("/"):
                over = lower.find(f"</{name}", at)
                at = end if over < 0 else over
                stop = page.find(">", at)
                at = end if stop < 0 else stop + 1
            continue
        if name in VOID:
            continue
        furniture, word = is_furniture(name, attrs)
        is_main = name == "main" or "main" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs) is not None
        if word and (m.start() in spared or (is_main or name == "article") and word not in COMMENTS):
            word = None
        hard, furniture = furniture, furniture or word is not None
        if name == "p":
            hidden_p = furniture
        elif block or furniture:
            if name in ENDS:
                which, inside = ENDS[name]
                if innermost(which) > innermost(inside):
                    close(innermost(which))
            _, outer, article, main, judged = stack[-1] if stack else ("", False, 0, 0, None)
            if word and not hard:
                judged = (m.start(), judged)
            if is_main:
                mark(around_main, judged)
            if name == "article":
                mark(around, judged)
            if name == "article" and not outer:
                articles += 1
                article = article or articles  # an article inside another is part of it
            if is_main and not outer:
                mains += 1
                main = main or mains
            if name != "body" and name != "html":
                places.setdefault(name, []).append(len(stack))
                stack.append((name, outer or furniture, article, main, judged))
    flush()
    return lines, frozenset(around_main), frozenset(around)


def stretches(weights: np.ndarray) -> list[tuple[int, int]]:
    """[first, last) of the runs of lines between a surge and a dive.

    A window is the sum of ``WINDOW`` lines around a line. A stretch reaches from
    where the windows rise above nothing to where they dive to nothing, and is
    trimmed to lines with weight."""
    n = len(weights)
    if not n:
        return []
    half = WINDOW // 2
    total = np.concatenate([[0], np.cumsum(weights)])
    first, last = np.maximum(np.arange(n) - half, 0), np.minimum(np.arange(n) + half + 1, n)
    window = total[last] - total[first]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], window > 0, [0]])))
    out = []
    for begin, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        full = np.flatnonzero(weights[begin:stop])
        out.append((begin + int(full[0]), begin + int(full[-1]) + 1))
    return out


def main_text(page: str) -> str:
    """The main text of a page, lines joined by one line feed; "" if there is none."""
    lines = [line for line in page_lines(page) if not line[2]]
    if not lines:
        return ""
    weights = np.array([line[1] for line in lines], np.int64)
    between, marked = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    for begin, stop in stretches(weights):
        between[begin:stop] = True
    for column in (3, 4):
        # inside an article or main part with text, lines that are all link are text, not a menu
        owner = np.array([line[column] for line in lines], np.int64)
        marked |= (owner > 0) & (np.bincount(owner, weights=weights) > 0)[owner]
    outside = weights[between & ~marked].sum()
    kept = marked if weights[marked].sum() > outside else between | marked
    return "\n".join(line[0] for line, k in zip(lines, kept, strict=True) if k)


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] = ()) -> DataFrame:
    """The columns ``keep`` of every row, text and n_chars (its code points).

    One row per input row, repeated ones included; no shuffle. A null or empty
    html, or a page without text, gives the empty text. Markup may be broken or
    cut off. Other columns of ``pages`` are ignored.
    """
    kept = [c for c in keep if c not in ("text", "n_chars")]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        texts = [main_text(as_text(h)) for h in frame[source]]
        return frame[kept].assign(text=texts, n_chars=[len(t) for t in texts])

    source, = fresh(pages, "_html")
    cols = pages.select(*[pages[c] for c in kept], F.col(html).alias(source))
    schema = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in kept),
                        "text string", "n_chars long"])
    return map_rows(cols, run, schema)
