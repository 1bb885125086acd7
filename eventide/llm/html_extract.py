"""Main text of web pages from flat text blocks.

A page is read once as a stream of tags and character data and becomes a flat
list of text blocks.  Each block has few numbers: words, share of words inside
links, the same of the blocks before and after it, its place in the page, whether
its tag or class names say what it is, and whether an ancestor does.  A decision
tree, trained here on the small table of labelled blocks below, says which blocks
are text of the article.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from eventide.llm.columns import Rows, map_rows, only

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</?[a-zA-Z][^\s>/]*(?:[^>\"']|\"[^\"]*\"|'[^']*')*(?:>|\Z)|[^<]+|<", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s>/]*)")
_HINT = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"\shidden(?=[\s=>/])|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")
_WORD = re.compile(r"[A-Za-z]+")

# HTML elements by what they mean for the text inside or around them.
UNREAD = set("script style noscript template svg math head title iframe object embed canvas audio video "
             "map select option optgroup datalist button textarea".split())
RAW = set("script style title textarea iframe noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q "
             "rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
FRAME = set("nav header footer aside form menu dialog fieldset".split())
MAIN = set("article main".split())
# Words in class, id and role attributes that name parts beside the article.
BESIDE = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie "
             "cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
             "subscription signup nav navbar navigation menu breadcrumb breadcrumbs sidebar side widget widgets "
             "footer header masthead topbar toolbar comment comments commentlist reply replies respond disqus "
             "discussion share sharing social related recommended recommendations teaser teasers outbrain taboola "
             "copyright legal disclaimer login search form pagination pager tags tagcloud byline skip complementary "
             "contentinfo".split())
TEXT = set("article content main post story entry body text".split())


class Block:
    __slots__ = ("text", "words", "linked", "frame", "beside", "main", "heading", "item")

    def __init__(self, text, words, linked, frame, beside, main, heading, item):
        self.text, self.words, self.linked = text, words, linked
        self.frame, self.beside, self.main, self.heading, self.item = frame, beside, main, heading, item


def blocks(page: str | None) -> list[Block]:
    """Text blocks of a page in order, with character references decoded."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # tag, unread, frame, beside, main
    parts: list[str] = []
    state = {"words": 0, "linked": 0, "link": 0}
    heading = item = False
    raw_until: str | None = None

    def flush() -> None:
        nonlocal parts
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                words = max(1, len(text.split()))
                out.append(Block(text, words, min(1.0, state["linked"] / words),
                                 any(s[2] for s in stack), any(s[3] for s in stack),
                                 any(s[4] for s in stack), heading, item))
        parts = []
        state["words"] = state["linked"] = 0

    for token in _TOKEN.finditer(page or ""):
        s = token.group()
        if raw_until is not None:
            if s.startswith("</") and (m := _NAME.match(s)) and m[1].lower() == raw_until:
                raw_until = None
                if stack:
                    stack.pop()
            continue
        name = _NAME.match(s) if s[0] == "<" and len(s) > 1 else None
        if name is None:
            if s.startswith("<!") or s.startswith("<?"):
                continue
            if any(x[1] for x in stack):
                continue
            text = html.unescape(s)
            parts.append(text)
            if state["link"]:
                state["linked"] += len(text.split())
            continue
        tag = name[1].lower()
        if tag not in INLINE:
            flush()
        if s[1] == "/":
            if tag == "a":
                state["link"] = max(0, state["link"] - 1)
            open_at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if open_at is not None:
                del stack[open_at:]
            if tag[0] == "h" and tag[1:].isdigit():
                heading = False
            if tag == "li":
                item = False
            continue
        if tag == "a":
            state["link"] += 1
        if tag in VOID or s.endswith("/>") and tag not in RAW:
            continue
        if tag == "p":  # an open paragraph ends where the next begins
            while stack and stack[-1][0] == "p":
                stack.pop()
        if tag[0] == "h" and tag[1:].isdigit():
            heading = True
        if tag == "li":
            item = True
        hints = {w.lower() for m in _HINT.finditer(s) for w in _WORD.findall(m[1])}
        body = tag in ("html", "body")
        stack.append((tag, tag in UNREAD or bool(_HIDDEN.search(s)), tag in FRAME,
                      not body and bool(hints & BESIDE), tag in MAIN or not body and bool(hints & TEXT)))
        if tag in RAW:
            raw_until = tag
    flush()
    return out


FEATURES = ("words", "linked", "words_before", "linked_before", "words_after", "linked_after",
            "frame", "beside", "main", "heading", "page_has_main")


def features(page: list[Block]) -> np.ndarray:
    edge = Block("", 0, 0.0, False, False, False, False, False)
    has_main = any(b.main and not b.frame and not b.beside for b in page)
    return np.array([
        (b.words, b.linked, p.words, p.linked, n.words, n.linked, b.frame, b.beside, b.main, b.heading, has_main)
        for p, b, n in zip([edge, *page[:-1]], page, [*page[1:], edge])], np.float64).reshape(-1, len(FEATURES))


# Labelled blocks.  Columns are FEATURES, then 1 for text of the article.
LABELLED = """
 9 0.0   0 0.0  60 0.0  0 0 1 1 1  1
 3 0.0   6 1.0  45 0.0  0 0 1 1 1  1
60 0.0   9 0.0  42 0.0  0 0 1 0 1  1
42 0.1  60 0.0   5 0.0  0 0 1 0 1  1
 5 0.0  42 0.1  80 0.0  0 0 1 0 1  1
 1 0.0  30 0.0  12 1.0  0 0 1 0 1  1
80 0.0   5 0.0   8 0.0  0 0 1 0 1  1
12 0.0  80 0.0   9 0.6  0 0 1 0 1  1
25 0.4  44 0.0  31 0.0  0 0 1 0 1  1
 4 1.0  38 0.0  52 0.0  0 0 1 0 1  1
 2 1.0  20 0.0   3 1.0  0 0 1 0 1  1
 7 0.0   4 0.0  66 0.0  0 0 1 1 1  1
90 0.0   7 0.0   0 0.0  0 0 1 0 1  1
33 0.0  12 0.5  28 0.0  0 0 0 0 0  1
28 0.1  33 0.0  40 0.0  0 0 0 0 0  1
55 0.0   8 0.0  61 0.0  0 0 0 0 0  1
16 0.0  55 0.0  47 0.0  0 0 0 0 0  1
 8 0.0   3 1.0  55 0.0  0 0 0 1 0  1
 6 0.0  40 0.0  35 0.0  0 0 0 1 0  1
 9 0.0  48 0.0  52 0.0  0 0 0 0 0  1
 7 0.0  70 0.0   4 1.0  0 0 0 0 0  0
70 0.2  20 0.0   7 0.0  0 0 0 0 0  1
 1 1.0   0 0.0   1 1.0  1 0 0 0 1  0
 1 1.0   1 1.0   1 1.0  1 0 0 0 1  0
 2 1.0   1 1.0   9 0.0  1 0 0 0 1  0
 2 1.0   2 1.0   2 1.0  0 0 0 0 0  0
 3 1.0   0 0.0   3 1.0  0 0 0 0 0  0
 4 0.9   3 1.0   4 1.0  0 0 0 0 0  0
12 0.8  33 0.0  10 0.9  0 0 0 0 0  0
 8 0.0   1 1.0   9 0.0  0 1 0 0 1  0
30 0.0   2 1.0   7 0.0  0 1 0 0 1  0
14 0.0  60 0.0  22 0.0  0 1 1 0 1  0
22 0.0  14 0.0  70 0.0  0 1 1 0 1  0
 4 0.0  70 0.0   9 0.0  0 1 1 1 1  0
45 0.0   4 0.0  50 0.0  0 1 1 0 1  0
50 0.1  30 0.0  40 0.0  0 1 0 0 0  0
18 0.0  90 0.0   0 0.0  1 0 0 0 1  0
40 0.0  20 0.0   0 0.0  1 0 0 0 1  0
35 0.2  10 0.0  12 0.0  1 0 1 0 1  0
12 0.0  35 0.2  60 0.0  1 0 1 0 1  0
26 0.0  11 0.0  13 0.0  1 0 0 0 0  0
 9 0.0  26 0.0   0 0.0  1 0 0 1 0  0
20 0.0   3 1.0   9 0.0  0 0 0 0 1  0
48 0.0  15 0.0  11 0.0  0 0 0 0 1  0
 5 0.0   0 0.0  10 0.0  0 0 0 0 1  0
 6 0.0  44 0.0   5 0.0  0 0 0 1 1  0
 5 0.0   0 0.0   3 1.0  0 0 0 0 0  0
 3 0.0   4 1.0   5 0.0  0 0 0 0 0  0
 6 0.3   5 0.0   2 1.0  0 0 0 0 0  0
 7 0.0   6 0.3   0 0.0  0 0 0 0 0  0
"""


class Tree:
    """Binary decision tree by Gini impurity; leaves hold the share of ones."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 7):
        self.share, self.feature = float(y.mean()), None
        best = (self._gini(y) * len(y) - 1e-9, None, None)
        if depth and 0 < self.share < 1:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for at in (values[:-1] + values[1:]) / 2:
                    low = x[:, f] <= at
                    cost = self._gini(y[low]) * low.sum() + self._gini(y[~low]) * (~low).sum()
                    if cost < best[0] - 1e-12:
                        best = (cost, f, at)
        if best[1] is not None:
            _, self.feature, self.at = best
            low = x[:, self.feature] <= self.at
            self.low, self.high = Tree(x[low], y[low], depth - 1), Tree(x[~low], y[~low], depth - 1)

    @staticmethod
    def _gini(y: np.ndarray) -> float:
        p = y.mean()
        return 2 * p * (1 - p)

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.feature is None or not len(x):
            return np.full(len(x), self.share)
        low = x[:, self.feature] <= self.at
        out = np.empty(len(x))
        out[low], out[~low] = self.low.predict(x[low]), self.high.predict(x[~low])
        return out


@lru_cache(maxsize=1)
def classifier() -> Tree:
    rows = np.array([[float(v) for v in line.split()] for line in LABELLED.strip().splitlines()])
    return Tree(rows[:, :-1], rows[:, -1])


def main_text(page: str | None) -> tuple[str, int, int]:
    """Text of the article, number of blocks and number of blocks kept."""
    found = blocks(page)
    if not found:
        return "", 0, 0
    keep = classifier().predict(features(found)) > 0.5
    text = "\n\n".join(b.text for b, k in zip(found, keep) if k)
    return text, len(found), int(keep.sum())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks and n_kept of every row of ``pages``.

    ``pages`` has page_id, url and html; other columns are ignored.  A null or empty
    page, and one without text of an article, has an empty text.  Rows that repeat a
    page_id are read each; no rows give no rows.  Pages are read where they lie: no
    shuffle.
    """

    def run(rows: Rows) -> Rows:
        for page_id, url, page in rows:
            text, n, kept = main_text(page)
            yield page_id, url, text, len(text), n, kept

    return map_rows(only(pages, page_id="bigint", url="string", html="string"), run, 512,
                    page_id="bigint", url="string", text="string", n_chars="bigint",
                    n_blocks="bigint", n_kept="bigint")
