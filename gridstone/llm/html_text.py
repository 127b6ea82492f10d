"""HTML main text: flat text blocks classified by a decision tree over their own and their neighbours' figures.

A page is cut into flat blocks at block-level tags. Each block has its word count and its link
density; with the same figures of the blocks before and after it goes through a small decision
tree, trained here on the labelled table below. Two more figures say what the page itself
declares: whether the block stands in an article, in page furniture by tag (menu, footer and the
like), in something that only its class, id or role calls furniture, or in none of these; and how
much of the page stands beside it where that matters.

Names are weak. Only a name that is furniture as a whole counts ("sidebar", "comment-list", not
"with-sidebar" or "comments-open"); what is called furniture but holds the page's only article is
none; and where all of a page's text is in what names call furniture, words and links decide.
A form is judged like a name, since some sites put a form around the page.
"""

from __future__ import annotations

import html as htmllib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S)
_PLAIN_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_SPACE = re.compile(r"\s+")

RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "math", "object", "select", "canvas", "xmp", "noframes"}
BLOCK_TAGS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
PARAGRAPH_ENDS = BLOCK_TAGS - {"body", "html", "head"}
#: Furniture by tag. A form or fieldset is one only until it turns out to hold the page.
BAD_TAGS = {"nav", "footer", "aside", "menu", "button", "dialog", "label"}
FORMS = {"form", "fieldset"}
#: Names that are furniture by themselves or as the last word of a name, unless a word of STATES stands before.
BAD_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "promo", "promotion", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "alert",
    "popup", "modal", "overlay", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "side", "widget", "widgets", "related", "recommended", "share", "sharing", "social",
    "footer", "header", "masthead", "topbar", "toolbar", "comment", "comments", "disqus", "replies", "newsletter", "subscribe", "signup", "login", "search", "pagination", "pager", "skip", "complementary", "contentinfo",
}
#: Of these an article may have its own.
HEADS = {"header", "masthead"}
STATES = {"with", "no", "has", "without", "hide", "show", "is", "not", "type", "layout", "theme"}
#: What may follow a furniture word in the name of a part of it.
PARTS = {
    "area", "bar", "block", "body", "box", "button", "buttons", "container", "content", "form", "inner", "item", "items", "label", "link", "links", "list", "message", "outer", "panel", "posts", "articles", "stories",
    "reply", "row", "section", "slot", "text", "thread", "title", "top", "bottom", "left", "right", "unit", "wrap", "wrapper",
}
GOOD_TAGS = {"article", "main"}
GOOD_NAMES = {"article", "story", "post", "entry", "main"}
#: Tags that a name can make an article; on others (a heading, a span) names say nothing about what is around.
CONTAINERS = {"div", "section", "td", "table", "ul", "ol", "body"}
#: Marks: nothing declared, in an article, in furniture by tag, in what is furniture by name.
OPEN, INSIDE, SHUT, NAMED = 0, 1, 2, 3


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    mark: int
    beside: float = 0.0


class _Part:
    """An element that tag, name or style calls furniture, with what stands in it."""

    __slots__ = ("kind", "final", "parent", "articles", "inside")

    def __init__(self, kind: int, final: bool, parent: int, articles: int):
        self.kind, self.final, self.parent, self.articles, self.inside = kind, final, parent, articles, 0


def _names(attributes: str) -> list[list[str]]:
    """Words of each name in class, id and role."""
    return [w for m in _NAMED.finditer(attributes) for token in (m[1] or m[2] or m[3] or "").lower().split() if (w := _WORD.findall(token))]


def bad_name(words: list[str], inside: bool) -> bool:
    """Whether a name as a whole means furniture; in an article a header is none."""
    bad = BAD_NAMES - HEADS if inside else BAD_NAMES
    if words[-1] in bad:
        return not STATES & set(words[:-1])
    return len(words) > 1 and words[0] in bad and all(w in PARTS or w.isdigit() for w in words[1:])


def _kind(name: str, attributes: str, inside: bool) -> tuple[int, bool]:
    """What an element is called: (OPEN, SHUT or NAMED, whether that is final)."""
    if name == "head" or attributes and _HIDDEN.search(attributes):
        return SHUT, True
    if name in BAD_TAGS or name == "header" and not inside:
        return SHUT, False
    if name in FORMS:
        return NAMED, False
    if attributes and name not in ("html", "body", "main") and any(bad_name(w, inside) for w in _names(attributes)):
        return NAMED, False
    return OPEN, False


def _is_article(name: str, attributes: str) -> bool:
    return name in GOOD_TAGS or bool(attributes) and name in CONTAINERS and any(GOOD_NAMES & set(w) for w in _names(attributes))


def blocks_of(page: str | None) -> list[Block]:
    """Flat text blocks of a page in order. Unclosed, crossed and cut-off tags are tolerated."""
    page = page or ""
    found: list[Block] = []
    where: list[tuple[bool, int]] = []  # of each block: in an article, the part it is in
    parts: list[_Part] = []
    articles: list[int] = []  # the part that each article or main is in
    texts: list[str] = []
    linked = 0
    open_tags: list[tuple[str, bool, int]] = []  # name, in an article, part
    places: dict[str, list[int]] = defaultdict(list)  # where in open_tags each name stands
    block_places: list[int] = []  # where block-level tags stand
    here, links, at = (False, -1), 0, 0
    last_end = page.rfind(">")  # beyond it nothing can be a whole tag

    def flush() -> None:
        nonlocal linked
        if texts:
            text = _SPACE.sub(" ", "".join(texts)).strip()
            if text:
                chars = max(1, sum(len(t) for t in text.split()))
                found.append(Block(text, text.count(" ") + 1, min(1.0, linked / chars), OPEN))
                where.append(here)
            texts.clear()
        linked = 0

    def say(piece: str) -> None:
        nonlocal linked
        if piece:
            piece = htmllib.unescape(piece) if "&" in piece else piece
            texts.append(piece)
            if links:
                linked += sum(map(len, piece.split()))

    def close_to(k: int) -> None:
        nonlocal here, links
        while len(open_tags) > k:
            name, _, part = open_tags.pop()
            links -= name == "a"
            places[name].pop()
            if name in BLOCK_TAGS:
                block_places.pop()
            if part >= 0 and (not open_tags or open_tags[-1][2] != part):
                parts[part].inside = len(articles) - parts[part].articles
        here = open_tags[-1][1:] if open_tags else (False, -1)

    while True:
        m = (_TAG if at <= last_end else _PLAIN_TAG).search(page, at)
        if m is None:
            tail = page[at:]
            cut = tail.rfind("<")
            if cut >= 0 and re.match(r"</?[a-zA-Z!]", tail[cut:]):
                tail = tail[:cut]  # a tag that the page's end cuts off
            say(tail)
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if not m[1]:
            if name in RAW and not m[3].endswith("/"):
                if name in ("textarea", "iframe", "title"):
                    flush()
                raw_end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
                at = raw_end.end() if raw_end else len(page)
                continue
            if name == "br":
                texts.append(" ")
            if name in BLOCK_TAGS:
                flush()
                # a block ends an open paragraph, with what is open inside it
                if name in PARAGRAPH_ENDS and block_places and open_tags[block_places[-1]][0] == "p":
                    close_to(block_places[-1])
            if name in VOID or m[3].endswith("/"):
                continue
            if name == "a":
                links += 1
            inside, part = here
            kind, final = _kind(name, m[3], inside)
            if kind != OPEN:
                parts.append(_Part(kind, final, part, len(articles)))
                part = len(parts) - 1
            elif name in GOOD_TAGS:
                articles.append(part)
            ahead = inside or kind == OPEN and _is_article(name, m[3]), part
            if ahead != here:
                flush()
                here = ahead
            places[name].append(len(open_tags))
            if name in BLOCK_TAGS:
                block_places.append(len(open_tags))
            open_tags.append((name, *here))
        else:
            if name in BLOCK_TAGS:
                flush()
            if places[name] and (name in BLOCK_TAGS or not block_places or places[name][-1] > block_places[-1]):
                k = places[name][-1]
                if (open_tags[k - 1][1:] if k else (False, -1)) != here:
                    flush()
                close_to(k)
    flush()
    close_to(0)
    _judge(found, where, parts, articles)
    return found


def _judge(found: list[Block], where: list[tuple[bool, int]], parts: list[_Part], articles: list[int]) -> None:
    """Sets each block's mark and what stands beside it, now that the whole page is known."""
    state: list[int] = []  # of each part, with what it stands in; parents come first
    for p in parts:
        holds_page = p.inside and p.inside == len(articles) and not p.final
        above = state[p.parent] if p.parent >= 0 else OPEN
        state.append(SHUT if SHUT in (above, OPEN if holds_page else p.kind) else NAMED if NAMED in (above, OPEN if holds_page else p.kind) else OPEN)
    for b, (inside, part) in zip(found, where):
        called = state[part] if part >= 0 else OPEN
        b.mark = called or (INSIDE if inside else OPEN)
    read = sum(b.words for b in found if b.mark in (OPEN, INSIDE))
    within = sum(b.words for b in found if b.mark == INSIDE)
    named = sum(b.words for b in found if b.mark == NAMED)
    rest = 1.0 if any(part < 0 or state[part] == OPEN for part in articles) else read / (read + named) if read + named else 0.0
    for b in found:
        if b.mark == OPEN:
            b.beside = within / read
        elif b.mark == NAMED:
            b.beside = rest


#: The labelled table, of typical blocks: words and link density of the block before, the block and the block after
#: (0 words: there is none; LONG words: so many or more), mark (0 nothing declared, 1 article, 3 furniture by name; what is furniture by tag is never content),
#: what stands beside: of mark 0 the share of the page's words that stand in articles, of mark 3 the share that stands outside
#: of what names call furniture (1: the page has an article there); content or not.
LONG = 20
LABELLED = [
    # articles: text of any length and among any neighbours
    (0, 0.0, 12, 0.0, 20, 0.0, 1, 0.0, 1), (9, 0.0, 20, 0.0, 20, 0.0, 1, 0.0, 1), (20, 0.0, 2, 0.0, 20, 0.1, 1, 0.0, 1), (20, 0.0, 1, 0.0, 0, 0.0, 1, 0.0, 1), (5, 1.0, 9, 0.0, 3, 0.0, 1, 0.0, 1),
    (3, 1.0, 20, 0.1, 20, 0.0, 1, 0.0, 1), (20, 0.2, 20, 0.3, 20, 0.0, 1, 0.0, 1), (0, 0.0, 5, 0.4, 0, 0.0, 1, 0.0, 1), (20, 0.0, 20, 0.0, 8, 0.0, 1, 0.0, 1), (4, 0.0, 4, 0.0, 4, 0.0, 1, 0.0, 1),
    (2, 1.0, 3, 0.0, 4, 1.0, 1, 0.0, 1), (3, 1.0, 7, 0.0, 2, 1.0, 1, 0.0, 1), (6, 1.0, 5, 0.1, 3, 1.0, 1, 0.0, 1), (4, 1.0, 6, 0.0, 0, 0.0, 1, 0.0, 1), (2, 1.0, 2, 0.2, 0, 0.0, 1, 0.0, 1), (5, 1.0, 12, 0.0, 9, 1.0, 1, 0.0, 1),
    # and single links, but no lists of links between links
    (20, 0.0, 6, 1.0, 20, 0.0, 1, 0.0, 1), (12, 0.0, 3, 1.0, 20, 0.0, 1, 0.0, 1), (6, 0.0, 6, 1.0, 2, 0.0, 1, 0.0, 1), (0, 0.0, 20, 0.7, 20, 0.0, 1, 0.0, 1), (20, 0.0, 4, 1.0, 0, 0.0, 1, 0.0, 1), (20, 0.0, 5, 1.0, 9, 0.2, 1, 0.0, 1),
    (4, 1.0, 4, 1.0, 4, 1.0, 1, 0.0, 0), (6, 1.0, 5, 1.0, 7, 1.0, 1, 0.0, 0), (3, 1.0, 3, 0.9, 3, 1.0, 1, 0.0, 0), (8, 1.0, 9, 1.0, 6, 1.0, 1, 0.0, 0), (5, 0.9, 8, 0.9, 9, 0.9, 1, 0.0, 0), (12, 1.0, 12, 1.0, 12, 1.0, 1, 0.0, 0),
    # called furniture, with a page beside it
    (0, 0.0, 2, 1.0, 2, 1.0, 3, 1.0, 0), (2, 1.0, 14, 0.0, 9, 0.0, 3, 1.0, 0), (20, 0.0, 12, 0.0, 0, 0.0, 3, 0.9, 0), (20, 0.0, 20, 0.0, 20, 0.0, 3, 1.0, 0), (20, 0.0, 20, 0.2, 5, 0.0, 3, 0.3, 0), (8, 0.0, 20, 0.0, 20, 0.0, 3, 0.5, 0),
    (1, 0.0, 1, 0.0, 1, 0.0, 3, 0.2, 0), (0, 0.0, 20, 0.0, 0, 0.0, 3, 1.0, 0), (20, 0.0, 20, 0.0, 20, 0.1, 3, 0.15, 0), (9, 0.0, 9, 0.0, 9, 0.0, 3, 0.7, 0), (0, 0.0, 5, 0.0, 20, 0.0, 3, 1.0, 0), (3, 1.0, 20, 0.0, 4, 0.0, 3, 0.4, 0),
    # called furniture, but all that the page has: text, not links or single lines
    (20, 0.0, 20, 0.0, 20, 0.0, 3, 0.0, 1), (0, 0.0, 20, 0.0, 20, 0.0, 3, 0.02, 1), (3, 1.0, 20, 0.1, 20, 0.0, 3, 0.03, 1), (20, 0.0, 20, 0.2, 0, 0.0, 3, 0.0, 1), (2, 1.0, 20, 0.0, 3, 1.0, 3, 0.04, 1), (9, 0.0, 20, 0.0, 9, 0.0, 3, 0.0, 1), (0, 0.0, 20, 0.0, 0, 0.0, 3, 0.0, 1),
    (0, 0.0, 6, 0.0, 20, 0.0, 3, 0.0, 1), (20, 0.0, 9, 0.0, 20, 0.0, 3, 0.03, 1), (20, 0.0, 12, 0.0, 0, 0.0, 3, 0.0, 1), (3, 1.0, 7, 0.0, 20, 0.0, 3, 0.0, 1),
    (0, 0.0, 4, 0.0, 0, 0.0, 3, 0.0, 0), (3, 1.0, 9, 0.0, 2, 1.0, 3, 0.0, 0), (0, 0.0, 3, 1.0, 3, 1.0, 3, 0.0, 0), (20, 0.0, 12, 0.9, 4, 1.0, 3, 0.02, 0), (20, 0.0, 20, 0.8, 20, 0.0, 3, 0.0, 0), (6, 1.0, 12, 0.0, 0, 0.0, 3, 0.0, 0), (3, 1.0, 3, 1.0, 20, 0.0, 3, 0.0, 0),
    (5, 0.0, 8, 0.0, 4, 0.0, 3, 0.0, 0), (2, 0.0, 3, 0.0, 6, 0.0, 3, 0.01, 0),
    # beside an article that holds a good part of the page
    (0, 0.0, 9, 0.0, 20, 0.0, 0, 0.9, 0), (20, 0.0, 20, 0.0, 0, 0.0, 0, 0.8, 0), (3, 1.0, 20, 0.0, 9, 0.0, 0, 0.7, 0), (0, 0.0, 3, 1.0, 12, 0.0, 0, 0.95, 0), (20, 0.0, 20, 0.4, 20, 0.5, 0, 0.6, 0), (20, 0.0, 20, 0.0, 20, 0.0, 0, 0.5, 0),
    (20, 0.0, 20, 0.0, 0, 0.0, 0, 0.6, 0), (2, 1.0, 12, 0.0, 20, 0.0, 0, 0.9, 0), (20, 0.0, 20, 0.0, 20, 0.0, 0, 0.75, 0), (9, 0.0, 5, 0.0, 0, 0.0, 0, 0.5, 0), (0, 0.0, 6, 0.0, 9, 0.0, 0, 0.55, 0), (12, 0.0, 9, 0.0, 20, 0.0, 0, 0.8, 0),
    # beside a marked part that holds little of it: a heading, a teaser
    (8, 0.0, 20, 0.0, 20, 0.0, 0, 0.05, 1), (20, 0.0, 20, 0.0, 20, 0.0, 0, 0.1, 1), (20, 0.0, 20, 0.1, 3, 1.0, 0, 0.02, 1), (20, 0.0, 9, 0.0, 20, 0.0, 0, 0.2, 1),
    # pages that declare nothing: link lists, linked teasers, mostly linked text
    (0, 0.0, 3, 1.0, 3, 1.0, 0, 0.0, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0, 0.0, 0), (3, 1.0, 8, 0.8, 20, 0.0, 0, 0.0, 0), (20, 0.0, 12, 0.9, 4, 1.0, 0, 0.0, 0), (4, 1.0, 20, 0.6, 4, 1.0, 0, 0.0, 0), (2, 0.0, 3, 0.6, 0, 0.0, 0, 0.0, 0),
    (20, 0.0, 20, 0.7, 20, 0.0, 0, 0.0, 0), (20, 0.0, 15, 0.8, 20, 0.0, 0, 0.0, 0), (9, 0.0, 5, 1.0, 0, 0.0, 0, 0.0, 0), (0, 0.0, 5, 1.0, 0, 0.0, 0, 0.0, 0), (20, 0.0, 6, 1.0, 20, 0.0, 0, 0.0, 0), (20, 0.0, 3, 1.0, 0, 0.0, 0, 0.0, 0),
    # short text amid links, or after the last of them: a label of a menu, a notice under it
    (3, 1.0, 4, 0.0, 3, 1.0, 0, 0.0, 0), (2, 1.0, 7, 0.0, 2, 1.0, 0, 0.0, 0), (5, 1.0, 9, 0.2, 4, 0.9, 0, 0.0, 0), (4, 1.0, 2, 0.0, 6, 1.0, 0, 0.0, 0), (3, 1.0, 12, 0.0, 9, 1.0, 0, 0.0, 0), (9, 0.9, 11, 0.1, 3, 1.0, 0, 0.0, 0),
    (3, 1.0, 8, 0.0, 0, 0.0, 0, 0.0, 0), (2, 1.0, 6, 0.0, 0, 0.0, 0, 0.0, 0), (6, 1.0, 12, 0.0, 0, 0.0, 0, 0.0, 0), (1, 1.0, 3, 0.0, 0, 0.0, 0, 0.0, 0), (4, 0.9, 10, 0.2, 0, 0.0, 0, 0.0, 0),
    # long text amid links
    (2, 1.0, 20, 0.0, 2, 1.0, 0, 0.0, 1), (4, 1.0, 20, 0.0, 5, 1.0, 0, 0.0, 1), (3, 1.0, 20, 0.1, 0, 0.0, 0, 0.0, 1), (6, 1.0, 18, 0.1, 3, 1.0, 0, 0.0, 1), (5, 1.0, 17, 0.2, 0, 0.0, 0, 0.0, 1), (3, 1.0, 20, 0.0, 9, 1.0, 0, 0.0, 1),
    # headings and paragraphs
    (3, 1.0, 9, 0.0, 20, 0.0, 0, 0.0, 1), (2, 1.0, 4, 0.0, 20, 0.0, 0, 0.0, 1), (4, 1.0, 7, 0.0, 12, 0.0, 0, 0.0, 1), (2, 1.0, 12, 0.0, 20, 0.1, 0, 0.0, 1), (3, 1.0, 5, 0.0, 9, 0.0, 0, 0.0, 1), (1, 1.0, 3, 0.0, 3, 0.0, 0, 0.0, 1),
    (9, 0.0, 20, 0.0, 20, 0.0, 0, 0.0, 1), (20, 0.0, 20, 0.1, 20, 0.0, 0, 0.0, 1), (20, 0.0, 6, 0.0, 20, 0.0, 0, 0.0, 1), (20, 0.0, 20, 0.2, 3, 1.0, 0, 0.0, 1), (20, 0.0, 18, 0.1, 0, 0.0, 0, 0.0, 1), (20, 0.0, 9, 0.0, 3, 1.0, 0, 0.0, 1), (20, 0.0, 5, 0.0, 0, 0.0, 0, 0.0, 1),
    # short pages of text alone
    (0, 0.0, 3, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0.0, 1, 0.0, 0, 0.0, 0, 0.0, 1), (0, 0.0, 8, 0.0, 0, 0.0, 0, 0.0, 1), (3, 0.0, 4, 0.0, 3, 0.0, 0, 0.0, 1), (0, 0.0, 1, 0.0, 1, 0.0, 0, 0.0, 1), (1, 0.0, 1, 0.0, 0, 0.0, 0, 0.0, 1),
    (0, 0.0, 5, 0.0, 6, 0.0, 0, 0.0, 1), (6, 0.0, 4, 0.0, 9, 0.0, 0, 0.0, 1), (9, 0.0, 3, 0.0, 2, 1.0, 0, 0.0, 1), (0, 0.0, 9, 0.0, 2, 1.0, 0, 0.0, 1), (6, 0.0, 6, 0.1, 0, 0.0, 0, 0.0, 1),
]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12):
    """A classification tree by Gini impurity: nested (feature, threshold, low, high), leaves 0 or 1 (ties: content)."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (2.0, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] <= t]
            high = y[x[:, f] > t]
            p, q = low.mean(), high.mean()
            best = min(best, (round(float(len(low) * p * (1 - p) + len(high) * q * (1 - q)) / len(y), 12), f, float(t)))
    if best[0] > 1:
        return int(2 * y.sum() >= len(y))
    _, f, t = best
    side = x[:, f] <= t
    return f, t, grow(x[side], y[side], depth - 1), grow(x[~side], y[~side], depth - 1)


def trained_tree(labelled=LABELLED):
    table = np.array(labelled, dtype=float)
    return grow(table[:, :-1], table[:, -1].astype(int))


def main_text(page: str | None, tree) -> str:
    """Content blocks of a page, joined by an empty line."""
    found = blocks_of(page)
    kept = []
    flat = [(min(b.words, LONG), b.link_density) for b in found]
    around = [(0, 0.0), *flat, (0, 0.0)]
    for k, b in enumerate(found):
        if b.mark == SHUT:
            continue
        figures = (*around[k], *flat[k], *around[k + 2], b.mark, b.beside)
        node = tree
        while isinstance(node, tuple):
            f, t, low, high = node
            node = low if figures[f] <= t else high
        if node:
            kept.append(b.text)
    return "\n\n".join(kept)


def extracted(page: Column) -> Column:
    """Main text of an HTML column; null and empty pages give an empty text."""
    tree = trained_tree()

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p, tree) for p in pages], dtype=object)

    return run(page)


def extract_pages(pages: DataFrame) -> DataFrame:
    """One row per page row: page_id, url, text, n_chars.

    Null html is empty and gives an empty text. Nulls in page_id or url stay; repeated rows each
    get their row; an empty table gives none. Pages of any length are read whole.
    """
    return pages.select("page_id", "url", extracted(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridstone.llm.common import table

    return extract_pages(table(spark, sf_dir, "pages"))
