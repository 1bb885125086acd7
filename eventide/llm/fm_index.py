"""Bidirectional FM-index over a delimited vocabulary, searched for words at one error, in numpy.

The text is ``$w1$w2$...$wm$`` in code-point order of the words.  It is indexed as it is
and backwards; a pattern is an interval of suffix ranks in each of the two, and stepping to
the left in the one keeps the interval of the other in step, so a search may change its
direction.  Burrows-Wheeler texts are held as wavelet matrices: one walk over seven levels
counts a symbol and all smaller ones before a rank.

All functions work on arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np

BITS = 7
DELIMITER = 1  # 0 ends the text


def symbols(word: str) -> np.ndarray:
    """Symbols from 2: a-z, then the code points U+00C0 to U+00FF."""
    points = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(points < 128, points - 95, points - 164)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes by prefix doubling, eight symbols in the first round."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(8):
        key = (key << BITS) | padded[i:i + n]
    width = 8
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[:n - width] = rank[width:] + 1
        key = rank * (n + 1) + follow
        width *= 2


class Ranks:
    """One direction: suffix ranks of a text and the wavelet matrix of the symbols before them."""

    def __init__(self, text: np.ndarray):
        self.suffixes = suffix_array(text)
        before = text[self.suffixes - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << BITS))])
        self.zeros, self.totals = [], []
        start = np.zeros(1 << BITS, np.int64)
        every = np.arange(1 << BITS)
        for b in range(BITS - 1, -1, -1):
            bit = (before >> b) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - bit)])
            total = int(zeros[-1])
            self.zeros.append(zeros)
            self.totals.append(total)
            start = np.where((every >> b) & 1, total + start - zeros[start], zeros[start])
            before = np.concatenate([before[bit == 0], before[bit == 1]])
        self.shift = self.first[:-1] - start  # from a place at the last level to a suffix rank

    def step(self, low: np.ndarray, high: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Intervals with the symbol in front, and how many suffixes had a smaller one there."""
        smaller = np.zeros(len(low), np.int64)
        for b, zeros, total in zip(range(BITS - 1, -1, -1), self.zeros, self.totals):
            one = ((symbol >> b) & 1).astype(bool)
            a, z = zeros[low], zeros[high]
            smaller += np.where(one, z - a, 0)
            low, high = np.where(one, total + low - a, a), np.where(one, total + high - z, z)
        return low + self.shift[symbol], high + self.shift[symbol], smaller

    def children(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, symbol, low, high) of every symbol that stands in front of an interval."""
        origin, symbol = np.arange(len(low)), np.zeros(len(low), np.int64)
        for zeros, total in zip(self.zeros, self.totals):
            a, z = zeros[low], zeros[high]
            low, high = np.concatenate([a, total + low - a]), np.concatenate([z, total + high - z])
            origin, symbol = np.concatenate([origin, origin]), np.concatenate([symbol * 2, symbol * 2 + 1])
            some = high > low
            origin, symbol, low, high = origin[some], symbol[some], low[some], high[some]
        return origin, symbol, low + self.shift[symbol], high + self.shift[symbol]


class Vocabulary:
    """Index of distinct words, ``words`` sorted by code points."""

    def __init__(self, words: list[str]):
        parts = [np.array([DELIMITER])]
        for w in words:
            parts += (symbols(w), parts[0])
        body = np.concatenate(parts)
        end = np.zeros(1, np.int64)
        self.ahead, self.back = Ranks(np.concatenate([body, end])), Ranks(np.concatenate([body[::-1], end]))
        # Number of the word that follows a delimiter, in either direction.
        marks = np.cumsum(body == DELIMITER) - 1
        self.after, self.before = marks, (len(words) - 1) - (np.cumsum(body[::-1] == DELIMITER) - 1)

    def near(self, words: list[np.ndarray], exact: np.ndarray, longer: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, number of a word) of words with exactly one error behind the exact part.

        A query is the symbols of a word; its first ``exact`` ones (the last ones if
        ``backwards``) have to match.  ``longer`` says whether found words have one symbol
        more (1), as many (0) or one less (-1).
        """
        away, onward = (self.back, self.ahead) if backwards else (self.ahead, self.back)
        number = self.after if backwards else self.before
        length = np.array([len(w) for w in words], np.int64)
        q = np.full((len(words), (int(length.max()) if len(words) else 0) + 1), DELIMITER, np.int64)
        for i, w in enumerate(words):
            q[i, :len(w)] = w[::-1] if backwards else w
        # The exact part from its inner end to the delimiter; the interval of the other direction follows.
        size = len(away.suffixes)
        low, high, other = np.zeros(len(q), np.int64), np.full(len(q), size), np.zeros(len(q), np.int64)
        live = np.arange(len(q))
        for s in range(int(exact.max()) + 1 if len(q) else 0):
            on = live[exact[live] >= s]
            if not len(on):
                break
            at = exact[on] - 1 - s
            symbol = np.where(at >= 0, q[on, at], DELIMITER)
            low[on], high[on], smaller = away.step(low[on], high[on], symbol)
            other[on] += smaller
            live = live[high[live] > low[live]]
        # Now the other way, through the part with the error.
        who, place, low, high = live, exact[live], other[live], other[live] + high[live] - low[live]
        found = []
        erred = [np.empty(0, np.int64)] * 4
        while len(who) or len(erred[0]):
            new = [erred]
            kind, inside = longer[who], place < length[who]
            branch = np.flatnonzero((kind == 1) | ((kind == 0) & inside))
            if len(branch):
                origin, symbol, a, z = onward.children(low[branch], high[branch])
                origin = branch[origin]
                changed = (symbol > DELIMITER) & ((kind[origin] == 1) | (symbol != q[who[origin], place[origin]]))
                origin, a, z = origin[changed], a[changed], z[changed]
                new.append([who[origin], place[origin] + (kind[origin] == 0), a, z])
            skip = np.flatnonzero((kind == -1) & inside)
            new.append([who[skip], place[skip] + 1, low[skip], high[skip]])
            # Patterns without an error so far match on.
            on = np.flatnonzero(inside)
            who, place, low, high = who[on], place[on], low[on], high[on]
            low, high, _ = onward.step(low, high, q[who, place])
            place = place + 1
            some = high > low
            who, place, low, high = who[some], place[some], low[some], high[some]
            # Those with one do too, to the delimiter behind the word.
            ew, ep, ea, ez = (np.concatenate(c) for c in zip(*new))
            ea, ez, _ = onward.step(ea, ez, q[ew, ep])
            some = ez > ea
            ew, ep, ea, ez = ew[some], ep[some], ea[some], ez[some]
            done = ep == length[ew]
            found.append(np.stack([ew[done], number[onward.suffixes[ea[done]]]], 1))
            erred = [ew[~done], ep[~done] + 1, ea[~done], ez[~done]]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
        return pairs[:, 0], pairs[:, 1]
