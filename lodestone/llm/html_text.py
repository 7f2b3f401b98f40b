"""Main text of web pages by shallow features of flat text blocks.

A page is cut at block-level tags into a flat row of text blocks.  Each has a number of
words and a link density; with those of its two neighbours they are the features of a
decision tree, which is grown from a small labelled table when it is needed.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("words_before", "links_before", "words", "links", "words_after", "links_after")
#: Labelled blocks: the features in that order, and 1 for content.  Written by hand after
#: what news pages, blogs, documentation, shops and forums look like.
LABELLED = (
    # navigation, menus, breadcrumbs, tag clouds
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 2, 1, 1, 1, 0), (2, 1, 3, 1, 2, 1, 0), (1, 1, 1, 1, 8, 0, 0), (1, 1, 6, 1, 5, 1, 0), (3, 1, 12, 0.9, 4, 1, 0), (5, 1, 9, 1, 30, 0, 0),
    (12, 1, 40, 0.95, 10, 1, 0), (2, 1, 25, 0.8, 3, 1, 0), (0, 0, 18, 1, 2, 1, 0), (1, 1, 2, 1, 60, 0, 0), (4, 0.5, 7, 0.7, 5, 0.8, 0), (3, 1, 4, 0.5, 3, 1, 0), (2, 1, 1, 1, 12, 0, 0),
    # advertisements, teasers, share and login lines between lists of links
    (1, 1, 5, 0, 1, 1, 0), (1, 1, 8, 0, 2, 1, 0), (2, 1, 9, 0, 8, 0.4, 0), (1, 1, 6, 0, 12, 0, 0), (1, 1, 9, 0, 10, 0, 0), (3, 0.7, 7, 0.3, 6, 1, 0), (1, 1, 10, 0.4, 1, 1, 0), (6, 1, 14, 0.6, 3, 1, 0),
    # footers, copyright, cookie notes
    (40, 0, 8, 0, 0, 0, 0), (90, 0, 10, 0, 0, 0, 0), (60, 0, 12, 0.2, 0, 0, 0), (30, 0, 5, 0.4, 2, 1, 0), (3, 1, 12, 0, 0, 0, 0), (120, 0.02, 9, 0, 0, 0, 0), (2, 1, 14, 0, 0, 0, 0), (12, 0, 6, 0, 0, 0, 0),
    (80, 0, 14, 0, 0, 0, 0), (25, 0, 13, 0, 0, 0, 0), (8, 0, 4, 0, 0, 0, 0), (70, 0, 3, 1, 3, 1, 0), (50, 0, 2, 1, 1, 1, 0), (110, 0, 6, 0.8, 7, 0.9, 0), (45, 0, 4, 0, 2, 1, 0),
    # headlines and short lines within text
    (2, 1, 9, 0, 40, 0, 1), (8, 0, 10, 0, 60, 0, 1), (10, 0, 12, 0, 90, 0, 1), (40, 0, 4, 0, 50, 0, 1), (80, 0, 3, 0, 60, 0, 1), (7, 0, 13, 0, 120, 0, 1), (60, 0, 6, 0, 45, 0, 1), (10, 0, 15, 0, 35, 0, 1),
    (5, 0, 8, 0, 30, 0, 1), (30, 0, 8, 0, 28, 0, 1), (50, 0, 12, 0, 40, 0, 1), (90, 0, 9, 0, 70, 0.05, 1), (70, 0, 14, 0, 90, 0, 1), (12, 0, 5, 0, 80, 0, 1),
    # paragraphs
    (10, 0, 40, 0, 50, 0, 1), (12, 0, 80, 0.05, 60, 0, 1), (60, 0, 90, 0, 70, 0, 1), (90, 0, 120, 0.02, 80, 0, 1), (80, 0, 35, 0, 60, 0, 1), (50, 0, 25, 0, 40, 0, 1), (70, 0, 60, 0, 8, 0, 1), (90, 0, 45, 0, 3, 1, 1),
    (40, 0, 30, 0.1, 9, 0, 1), (9, 0, 28, 0, 10, 0, 1), (8, 0, 22, 0, 0, 0, 1), (30, 0, 150, 0.1, 12, 0, 1), (3, 1, 55, 0.05, 40, 0, 1), (1, 1, 70, 0, 1, 1, 1), (12, 0, 32, 0.2, 30, 0.1, 1), (100, 0, 20, 0, 12, 0, 1),
    (0, 0, 45, 0, 0, 0, 1), (0, 0, 120, 0.02, 0, 0, 1), (0, 0, 30, 0, 60, 0, 1), (5, 0, 260, 0, 10, 0, 1), (40, 0, 18, 0, 30, 0, 1), (60, 0, 17, 0, 70, 0, 1), (35, 0, 21, 0.1, 14, 0, 1), (14, 0, 24, 0, 6, 0, 1),
)
#: The tree's largest depth, and least rows of a leaf.
DEPTH, LEAF = 5, 2


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = DEPTH, leaf: int = LEAF) -> tuple:
    """A decision tree by Gini impurity: (share of content,) or (feature, bound, left, right),
    left for values up to the bound."""
    share = float(labels.mean())
    if depth == 0 or share in (0.0, 1.0):
        return (share,)
    best = None
    for f in range(rows.shape[1]):
        order = np.argsort(rows[:, f], kind="stable")
        x, y = rows[order, f], labels[order]
        n = np.arange(1, len(y))
        a = np.cumsum(y)[:-1]
        b = y.sum() - a
        impurity = a * (n - a) / n + b * (len(y) - n - b) / (len(y) - n)
        allowed = (x[1:] > x[:-1]) & (n >= leaf) & (len(y) - n >= leaf)
        if allowed.any():
            k = int(np.argmin(np.where(allowed, impurity, np.inf)))
            if best is None or impurity[k] < best[0] - 1e-12:
                best = (impurity[k], f, (x[k] + x[k + 1]) / 2)
    if best is None or best[0] >= len(labels) * share * (1 - share) - 1e-12:
        return (share,)
    left = rows[:, best[1]] <= best[2]
    return (best[1], float(best[2]), grow(rows[left], labels[left], depth - 1, leaf), grow(rows[~left], labels[~left], depth - 1, leaf))


@lru_cache(maxsize=1)
def default_tree() -> tuple:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def classify(tree: tuple, rows: np.ndarray) -> np.ndarray:
    """True for content, for rows of features."""
    if len(tree) == 1:
        return np.full(len(rows), tree[0] >= 0.5)
    left = rows[:, tree[0]] <= tree[1]
    out = np.zeros(len(rows), bool)
    out[left], out[~left] = classify(tree[2], rows[left]), classify(tree[3], rows[~left])
    return out


#: Elements whose text is read raw, up to their end tag.  Without one, the first two run to
#: the end of the page, and of the others only the tag goes.
_RAW = frozenset(("script", "style", "textarea", "iframe", "noscript", "title"))
_TO_THE_END = frozenset(("script", "style"))
#: Elements that are hidden with all that is in them, where they are closed.
_NESTED = frozenset(("svg", "template", "select"))
#: What may be in a head; its end tag is optional, and any other tag or text ends it.
_IN_HEAD = frozenset(("meta", "link", "base", "script", "style", "noscript", "template", "title", "!"))
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9]*)")
_STOP = re.compile("[>\"']")
_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_WITHIN = {name: re.compile(rf"<{name}\b", re.I) for name in _RAW - _TO_THE_END}


class _Scanner:
    """One pass over a page.  Whatever isn't there is looked for once, so that markup of any
    kind takes time in proportion to its length."""

    def __init__(self, page: str):
        self.page = page
        self.next: dict[str, int] = {}
        self.ends: dict[str, re.Match | None] = {}
        self.quotes = True

    def find(self, what: str, at: int) -> int:
        """Where ``what`` comes next, -1 for nowhere.  It is looked for again only after its last place."""
        k = self.next.get(what, 0)
        if 0 <= k < at or what not in self.next:
            k = self.next[what] = self.page.find(what, at)
        return k

    def closing(self, name: str, at: int) -> re.Match | None:
        m = self.ends.get(name)
        if name not in self.ends or m and m.start() < at:
            m = self.ends[name] = _END[name].search(self.page, at)
        return m

    def end_of_tag(self, at: int) -> int:
        """After the tag's > outside quotes; if all that come are in quotes, after the first."""
        first = self.find(">", at)
        if first < 0 or not self.quotes:
            return first + 1
        k = at
        while m := _STOP.search(self.page, k):
            k = m.end()
            if m[0] == ">":
                return k
            other = self.find(m[0], k)
            k = other + 1 if other >= 0 else k
        self.quotes = False  # the rest of the page has quotes in it that don't close as they should
        return first + 1

    def tokens(self) -> Iterator[tuple[str, int, int, int]]:
        """(name, start, end, kind) of text ("", kind 0), opening and closing tags (1 and -1), and
        what is hidden (2): comments ("!"), and raw elements by their name."""
        page, at, text = self.page, 0, 0
        while (i := page.find("<", at)) >= 0:
            m = _NAME.match(page, i + 1)
            name, kind = (m[1].lower(), -1 if page[i + 1] == "/" else 1) if m else ("", 0)
            if m:
                end = self.end_of_tag(m.end())
                if kind == 1 and name in _RAW and end and not (name not in _TO_THE_END and page[end - 2] == "/"):
                    close = self.closing(name, end)
                    again = name in _WITHIN and close and _WITHIN[name].search(page, end, close.start())
                    if close and not again:
                        end, kind = close.end(), 2
                    elif name in _TO_THE_END:
                        end, kind = len(page), 2
            elif page.startswith("!--", i + 1):
                close = self.find("-->", i + 4)
                end, name, kind = close + 3 if close >= 0 else len(page), "!", 2
            elif page.startswith("![CDATA[", i + 1) and (close := self.find("]]>", i + 9)) >= 0:
                end, name, kind = close + 3, "!", 2
            elif page[i + 1 : i + 2] in ("!", "/", "?"):
                end, name = self.find(">", i + 1) + 1, "?"
            else:
                end = 0
            if not end:  # no tag: a sign as any other
                at = i + 1
                continue
            if i > text:
                yield "", text, i, 0
            yield name, i, end, kind
            at = text = end
        if text < len(page):
            yield "", text, len(page), 0


def _visible(page: str) -> Iterator[tuple[str, int, int, int]]:
    """The tokens of what is shown; each part that isn't is one of kind 2."""
    found = list(_Scanner(page).tokens())
    hidden: list[tuple[int, int]] = []
    opened: dict[str, list[int]] = {}
    for k, (name, a, b, kind) in enumerate(found):
        if name in _NESTED and kind == 1 and not (name == "svg" and page[b - 2] == "/"):
            opened.setdefault(name, []).append(k)
        elif name in _NESTED and kind == -1 and opened.get(name):
            start = opened[name].pop()
            while hidden and hidden[-1][0] >= start:
                hidden.pop()
            hidden.append((start, k + 1))
    spans, k, head = iter(hidden), 0, False
    gone = next(spans, None)
    while k < len(found):
        while gone and gone[1] <= k:
            gone = next(spans, None)
        if gone and gone[0] <= k:
            yield "!", found[k][1], found[gone[1] - 1][2], 2
            k = gone[1]
            continue
        name, a, b, kind = found[k]
        k += 1
        if name == "head":
            head = kind == 1
            yield "!", a, b, 2
        elif head and (name in _IN_HEAD or name == "?" or not name and not page[a:b].strip()):
            yield "!", a, b, 2
        else:
            head = False
            yield name, a, b, kind


def blocks(page: str) -> list[tuple[str, int, float]]:
    """(text, words, link density) of the page's text blocks, in order; none is empty."""
    out: list[tuple[str, int, float]] = []
    parts: list[str] = []
    linked, depth = 0, 0

    def close() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            out.append((text, words, min(1.0, linked / words)))
        parts.clear()
        linked = 0

    for name, a, b, kind in _visible(page):
        if kind == 2:
            parts.append(" ")
        elif not name:
            parts.append(page[a:b])
            if depth:
                linked += len(page[a:b].split())
        elif name == "a":
            depth = kind == 1
        elif name != "?" and name not in _INLINE:
            close()
    close()
    return out


def features(found: list[tuple[str, int, float]]) -> np.ndarray:
    """Words and link density of the block before, of each block, and of the one after; 0 beyond the ends."""
    x = np.array([(0, 0.0), *((w, d) for _, w, d in found), (0, 0.0)], float)
    return np.concatenate([x[:-2], x[1:-1], x[2:]], 1)


def extract_text(page: str, tree: tuple | None = None) -> tuple[str, int, int]:
    """(text of the content blocks, one a line; blocks; content blocks)."""
    found = blocks(page)
    good = classify(tree or default_tree(), features(found)) if found else np.zeros(0, bool)
    return "\n".join(b[0] for b, x in zip(found, good) if x), len(found), int(good.sum())


def title(page: str) -> str | None:
    """What the first title element that is closed has; null where there is none."""
    for name, a, b, kind in _Scanner(page).tokens():
        if name == "title" and kind == 2:
            inner = page[_Scanner(page).end_of_tag(a + 6) : page.rindex("</", a, b)]
            return " ".join(html.unescape(inner).split())
    return None


def extract(pages: DataFrame, tree: tuple | None = None, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, title, text, n_blocks, n_content) of every row.

    A null page has null title and text and no blocks; an empty one, or one without text,
    an empty text; broken markup is read as far as it goes: a tag that isn't closed is
    text; a script, style or comment that isn't runs to the end; of other elements only
    the tag goes, and a head ends where something comes that can't be in it.  Very long
    pages are read whole, in time in proportion to their length.  Null ids and urls pass
    through; repeated rows each give a row; an empty table gives an empty one; other
    columns are ignored.
    """
    grown = tree or default_tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            rows = [(None, 0, 0) if x is None else extract_text(x, grown) for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([None if x is None else title(x) for x in raw], pa.string()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int32())],
                ["page_id", "url", "title", "text", "n_blocks", "n_content"],
            )

    given = pages.select(F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(page).alias("html"))
    return given.mapInArrow(run, "page_id bigint, url string, title string, text string, n_blocks int, n_content int")
