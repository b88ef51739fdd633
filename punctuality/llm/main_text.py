"""Main text of web pages from flat text blocks and a decision tree (operator 9).

The page is cut into flat blocks at block-level tags. A block is described by its words and
link density, those of its neighbours, and what encloses it (an article, or page furniture by
tag, class or role). A decision tree, trained on the small labelled table below, tells content
from the rest. Nothing is cut off or capped; malformed markup (open tags, stray end tags) is
read as browsers do, leniently, in time that grows with the page's length.

Furniture and comments win over an article inside them. Only where a page so has less than a
tenth of the words that it has when articles win (a form around all of it, a first article named
like a comment), the article wins.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from punctuality.llm.texts import map_rows

#: Elements whose content is never text of the page.
_SILENT = frozenset("script style noscript template svg math textarea select iframe object canvas audio video title".split())
_SILENT_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _SILENT}
_TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: The rest of a tag; a scan never passes the next "<".
_REST = re.compile(r"(?>[^<>\"']+|\"[^\"<]*\"|'[^'<]*')*+>")
_BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
_HOLDERS = frozenset(
    "article aside blockquote body button details dialog div dl fieldset figure footer form header label li main menu nav ol "
    "section table td th tr ul span p".split()
)
#: Furniture by tag; by a word of class, id or role.
_FURNITURE = frozenset("nav footer aside form menu button dialog label fieldset".split())
_HINT = re.compile(
    r"(?<![a-z])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"newsletter|subscri\w*|signup|sidebar|widgets?|menus?|nav\w*|breadcrumbs?|share|sharing|social|related|recommend\w*|"
    r"footer|toolbar|pagination|pager|login|search|hidden|legal|copyright|complementary|contentinfo)(?![a-z])",
    re.I,
)
_HEADER = re.compile(r"(?<![a-z])(?:header|masthead|topbar)(?![a-z])", re.I)
#: A whole name of a comment container; names of a state ("comments-open", "no-comments") are none.
_COMMENT = re.compile(
    r"(?<!\S)(?:(?!(?:no|has|have|with|without|show|hide|allow)[-_])[a-z0-9]+[-_]+)*(?:comments?|comment-?lists?|disqus|repl(?:y|ies)|respond|discussion)"
    r"(?:[-_]+(?:[a-z]?\d+|area|author|block|body|box|container|content|feed|form|inner|item|list|main|meta|reply|respond|root|section|"
    r"text|thread|title|widget|wrap|wrapper))*(?!\S)",
    re.I,
)
_NAMES = re.compile(r"(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
_CLOSE_P = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 section article aside nav footer header form blockquote pre".split())

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "main", "furniture", "heading", "marked"
)
#: Labelled blocks (in the order of FEATURES, then 1 for content): a table made for this tree. Pages
#: that mark no main element come first: long and short text, headings and links beside nothing, short
#: text, prose and lists of links; then main elements, furniture, and what lies outside a marked main.
LABELLED = (
    # words, links, before (words, links), after (words, links), main, furniture, heading, marked, content
    (60, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (9, 0.2, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (60, 0.2, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1),
    (9, 0.2, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 0, 0.0, 4, 0.0, 0, 0, 0, 0, 0),
    (5, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1, 0, 1), (60, 0.2, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 1), (20, 0.0, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 1),
    (2, 0.0, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 1), (9, 0.2, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 1), (3, 1.0, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 0),
    (25, 0.8, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 45, 0.1, 0, 0, 1, 0, 1), (60, 0.2, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (20, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (9, 0.2, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (25, 0.8, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 1, 0, 0),
    (60, 0.2, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 1),
    (9, 0.2, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 4, 0.0, 0, 0.0, 0, 0, 0, 0, 0),
    (60, 0.2, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 1),
    (9, 0.2, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 4, 0.0, 4, 0.0, 0, 0, 0, 0, 0),
    (5, 0.0, 4, 0.0, 4, 0.0, 0, 0, 1, 0, 1), (60, 0.2, 4, 0.0, 45, 0.1, 0, 0, 0, 0, 1), (20, 0.0, 4, 0.0, 45, 0.1, 0, 0, 0, 0, 1),
    (2, 0.0, 4, 0.0, 45, 0.1, 0, 0, 0, 0, 1), (9, 0.2, 4, 0.0, 45, 0.1, 0, 0, 0, 0, 1), (3, 1.0, 4, 0.0, 45, 0.1, 0, 0, 0, 0, 0),
    (25, 0.8, 4, 0.0, 45, 0.1, 0, 0, 0, 0, 0), (5, 0.0, 4, 0.0, 45, 0.1, 0, 0, 1, 0, 1), (60, 0.2, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 1),
    (20, 0.0, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 1), (2, 0.0, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (9, 0.2, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 1.0, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (25, 0.8, 4, 0.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 4, 0.0, 3, 1.0, 0, 0, 1, 0, 0),
    (60, 0.2, 45, 0.1, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 45, 0.1, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 45, 0.1, 0, 0.0, 0, 0, 0, 0, 1),
    (9, 0.2, 45, 0.1, 0, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 45, 0.1, 0, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 45, 0.1, 0, 0.0, 0, 0, 0, 0, 0),
    (60, 0.2, 45, 0.1, 4, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 45, 0.1, 4, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 45, 0.1, 4, 0.0, 0, 0, 0, 0, 1),
    (9, 0.2, 45, 0.1, 4, 0.0, 0, 0, 0, 0, 1), (3, 1.0, 45, 0.1, 4, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 45, 0.1, 4, 0.0, 0, 0, 0, 0, 0),
    (5, 0.0, 45, 0.1, 4, 0.0, 0, 0, 1, 0, 1), (60, 0.2, 45, 0.1, 45, 0.1, 0, 0, 0, 0, 1), (20, 0.0, 45, 0.1, 45, 0.1, 0, 0, 0, 0, 1),
    (2, 0.0, 45, 0.1, 45, 0.1, 0, 0, 0, 0, 1), (9, 0.2, 45, 0.1, 45, 0.1, 0, 0, 0, 0, 1), (3, 1.0, 45, 0.1, 45, 0.1, 0, 0, 0, 0, 1),
    (25, 0.8, 45, 0.1, 45, 0.1, 0, 0, 0, 0, 1), (5, 0.0, 45, 0.1, 45, 0.1, 0, 0, 1, 0, 1), (60, 0.2, 45, 0.1, 3, 1.0, 0, 0, 0, 0, 1),
    (20, 0.0, 45, 0.1, 3, 1.0, 0, 0, 0, 0, 1), (2, 0.0, 45, 0.1, 3, 1.0, 0, 0, 0, 0, 1), (9, 0.2, 45, 0.1, 3, 1.0, 0, 0, 0, 0, 1),
    (3, 1.0, 45, 0.1, 3, 1.0, 0, 0, 0, 0, 0), (25, 0.8, 45, 0.1, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 45, 0.1, 3, 1.0, 0, 0, 1, 0, 0),
    (60, 0.2, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (9, 0.2, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 3, 1.0, 0, 0.0, 0, 0, 0, 0, 0),
    (60, 0.2, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 1), (20, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
    (9, 0.2, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 0), (3, 1.0, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 0), (25, 0.8, 3, 1.0, 4, 0.0, 0, 0, 0, 0, 0),
    (5, 0.0, 3, 1.0, 4, 0.0, 0, 0, 1, 0, 1), (60, 0.2, 3, 1.0, 45, 0.1, 0, 0, 0, 0, 1), (20, 0.0, 3, 1.0, 45, 0.1, 0, 0, 0, 0, 1),
    (2, 0.0, 3, 1.0, 45, 0.1, 0, 0, 0, 0, 1), (9, 0.2, 3, 1.0, 45, 0.1, 0, 0, 0, 0, 1), (3, 1.0, 3, 1.0, 45, 0.1, 0, 0, 0, 0, 0),
    (25, 0.8, 3, 1.0, 45, 0.1, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 45, 0.1, 0, 0, 1, 0, 1), (60, 0.2, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 1),
    (20, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 1), (2, 0.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (9, 0.2, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0),
    (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (25, 0.8, 3, 1.0, 3, 1.0, 0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 3, 1.0, 0, 0, 1, 0, 0),
    (6, 0.0, 0, 0.0, 45, 0.0, 1, 0, 1, 1, 1), (80, 0.0, 9, 0.0, 60, 0.0, 1, 0, 0, 1, 1), (3, 0.0, 45, 0.1, 2, 0.0, 1, 0, 0, 1, 1),
    (1, 0.0, 300, 0.0, 12, 0.0, 1, 0, 0, 1, 1), (120, 0.2, 1, 0.0, 20, 0.3, 1, 0, 0, 1, 1), (4, 1.0, 120, 0.0, 90, 0.0, 1, 0, 0, 1, 1),
    (2, 0.0, 5, 1.0, 30, 0.0, 1, 0, 0, 1, 1), (5, 0.0, 3, 1.0, 3, 1.0, 1, 0, 0, 1, 1), (1, 1.0, 2, 1.0, 2, 1.0, 1, 0, 0, 1, 1),
    (30, 0.7, 4, 1.0, 8, 0.8, 1, 0, 0, 1, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1, 1), (5, 1.0, 60, 0.0, 5, 1.0, 0, 1, 0, 0, 0),
    (30, 0.0, 60, 0.0, 45, 0.0, 0, 1, 0, 1, 0), (3, 0.0, 30, 0.0, 80, 0.0, 0, 1, 0, 0, 0), (14, 0.4, 50, 0.0, 8, 0.0, 0, 1, 1, 1, 0),
    (160, 0.0, 40, 0.0, 40, 0.0, 0, 1, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 1, 0), (25, 0.0, 2, 1.0, 9, 0.0, 0, 1, 0, 0, 0),
    (200, 0.0, 60, 0.0, 90, 0.0, 0, 1, 0, 1, 0), (9, 0.2, 70, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (8, 0.0, 25, 0.0, 40, 0.0, 0, 1, 1, 1, 0),
    (2, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 0, 0), (60, 0.0, 3, 1.0, 45, 0.0, 0, 0, 0, 1, 0), (5, 0.0, 0, 0.0, 40, 0.0, 0, 0, 1, 1, 0),
    (12, 0.0, 80, 0.0, 0, 0.0, 0, 0, 0, 1, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0, 1, 0), (30, 0.1, 45, 0.0, 50, 0.1, 0, 0, 0, 1, 0),
    (1, 0.0, 0, 0.0, 2, 0.0, 0, 0, 0, 1, 0), (200, 0.0, 40, 0.0, 3, 1.0, 0, 0, 0, 1, 0),
)


@dataclass
class Node:
    share: float
    feature: int = -1
    at: float = 0.0
    low: Node | None = None
    high: Node | None = None

    def says(self, x: tuple) -> bool:
        node = self
        while node.feature >= 0:
            node = node.low if x[node.feature] <= node.at else node.high
        return node.share >= 0.5


def grow(rows: np.ndarray, depth: int = 12) -> Node:
    """A binary tree by Gini impurity; the last column is the label."""
    x, y = rows[:, :-1], rows[:, -1]
    node = Node(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or node.share in (0.0, 1.0):
        return node
    best = (len(y) * node.share * (1 - node.share) - 1e-9, -1, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for at in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= at
            loss = sum(part.sum() * (1 - part.mean()) for part in (y[low], y[~low]))
            if loss < best[0]:
                best = (loss, f, float(at))
    if best[1] >= 0:
        _, node.feature, node.at = best
        low = x[:, node.feature] <= node.at
        node.low, node.high = grow(rows[low], depth - 1), grow(rows[~low], depth - 1)
    return node


def _kind(tag: str, rest: str, first: bool = False) -> str:
    """What an element means for its text: main, comment, furniture or nothing.

    Names say nothing of a body, a main or the ``first`` article where articles win.
    """
    if tag == "body":
        return ""
    marked = tag in ("article", "main")
    if rest and (_HIDDEN.search(_QUOTED.sub("''", rest) if marked else rest) or marked and "none" in rest and _HIDDEN.search(rest[rest.find("style") :])):
        return "furniture"
    if tag == "main" or tag == "article" and first:
        return "main"
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)) if "=" in rest else ""
    if _COMMENT.search(names):
        return "comment"
    if tag in _FURNITURE:
        return "furniture"
    if marked or names == "main":
        return "main"
    if names and _HINT.search(names):
        return "furniture"
    return "header" if tag == "header" or names and _HEADER.search(names) else ""


def tokens(page: str) -> Iterator[tuple[str | None, bool, str]]:
    """(tag in lower case, whether it ends, its attributes) or (None, False, text), in page order.

    Comments and silent elements are left out; so is a tag that the page breaks off in.
    """
    at, end, closes = 0, len(page), page.rfind(">")
    while at < end:
        if page[at] != "<":
            to = page.find("<", at)
            to = end if to < 0 else to
            yield None, False, page[at:to]
            at = to
            continue
        if page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = end if to < 0 else to + 3
            continue
        name = _TAG.match(page, at)
        if name is None and page[at + 1 : at + 2] not in ("/", "!", "?"):
            yield None, False, "<"
            at += 1
            continue
        if at > closes:
            return
        if name is None:
            at = page.find(">", at) + 1
            continue
        whole = _REST.match(page, name.end())
        to = whole.end() if whole else page.find(">", name.end()) + 1
        if not to:
            return
        tag, rest, ends = name[1].lower(), page[name.end() : to - 1], page[at + 1] == "/"
        at = to
        if tag in _SILENT and not ends:
            if not rest.endswith("/"):
                close = _SILENT_END[tag].search(page, at)
                at = close.end() if close else end
            continue
        yield tag, ends, rest


#: Where text stands: nothing known, in a main element, in furniture that an inner main may undo, in furniture for good.
_PLAIN, _MAIN, _LOOSE, _SHUT = range(4)


def _inside(where: int, kind: str, articles_win: bool) -> int:
    if where == _SHUT or not kind:
        return where
    if kind == "comment":
        return _SHUT
    if kind == "main":
        return _MAIN
    if kind == "furniture":
        return _LOOSE if articles_win else _SHUT
    return where if where == _MAIN else _LOOSE


def blocks(page: str, articles_win: bool = False) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, in main, in furniture, heading) of each flat block."""
    out, parts, linked = [], [], []
    holders: list[tuple[str, bool, int]] = []  # open elements: tag, whether it means something, where its text stands
    opened: Counter[str] = Counter()
    link = heading = False
    where = _PLAIN
    articles = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                inside = len(html.unescape(" ".join(linked)).split()) if linked else 0
                words = text.count(" ") + 1
                out.append((text, words, min(inside, words), where == _MAIN, where >= _LOOSE, heading))
        parts, linked = [], []

    def close() -> None:
        nonlocal where
        opened[holders.pop()[0]] -= 1
        where = holders[-1][2] if holders else _PLAIN

    for tag, ends, rest in tokens(page):
        if tag is None:
            parts.append(rest)
            if link:
                linked.append(rest)
            continue
        if tag == "a":
            link = not ends
        elif tag in ("br", "img", "input"):
            parts.append(" ")
        if tag in _BLOCKS:
            flush()
            link = False
            heading = len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" and not ends
        if tag not in _HOLDERS:
            continue
        if ends:
            if not opened[tag]:
                continue
            at = len(holders) - 1
            while holders[at][0] != tag:
                at -= 1
            if any(meant for _, meant, _ in holders[at:]):
                flush()
            while len(holders) > at:
                close()
            continue
        if tag in _CLOSE_P and holders and holders[-1][0] == "p":
            close()
        if rest.endswith("/"):
            continue
        articles += tag == "article"
        kind = ""
        if rest or tag in _FURNITURE or tag in ("article", "main", "header"):
            kind = _kind(tag, rest, articles_win and articles == 1)
        if kind:
            flush()
        where = _inside(where, kind, articles_win)
        holders.append((tag, bool(kind), where))
        opened[tag] += 1
    flush()
    return out


def _kept(found: list[tuple], tree: Node) -> list[tuple[str, int]]:
    marked = int(any(b[3] for b in found))
    sizes = [(0, 0.0), *[(b[1], b[2] / b[1]) for b in found], (0, 0.0)]
    kept = []
    for k, (text, words, _, main, furniture, heading) in enumerate(found):
        x = (words, sizes[k + 1][1], *sizes[k], *sizes[k + 2], int(main), int(furniture), int(heading), marked)
        if tree.says(x):
            kept.append((text, words))
    return kept


def content(page: str | None, tree: Node) -> str:
    page = page or ""
    found = blocks(page)
    kept = _kept(found, tree)
    size = sum(words for _, words in kept)
    if any(b[4] for b in found) and 10 * size < sum(b[1] for b in found):
        other = _kept(blocks(page, articles_win=True), tree)
        if 10 * size < sum(words for _, words in other):
            kept = other
    return "\n".join(text for text, _ in kept)


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page; a null or empty page has an empty text.

    Repeated rows and null ids come out one for one; extra columns are ignored.
    """
    tree = grow(np.array(LABELLED, float))

    def start():
        def each(page_id, url, page):
            text = content(page, tree)
            yield page_id, url, text, len(text)

        return each

    return map_rows(pages.select("page_id", "url", "html"), start, "page_id long, url string, text string, n_chars long")
