"""Byte-level BPE by dynamic programming over byte prefixes.

Every prefix of a piece has exactly one token that its encoding can end with.
Storing that token per prefix is enough: the encoding is read backwards from the
last prefix, a byte that is appended needs one more step, and an edit needs the
steps from the edited byte on.

A token ``t`` ends the prefix ``p`` when the text before ``t`` has an encoding
that ends with some token ``s``, and merging the bytes of ``s + t`` by ranks
yields exactly ``s, t``.  Since merges are local, checking neighbours pairwise
checks the whole encoding.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from functools import lru_cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.llm.columns import Rows, map_rows, only
from eventide.llm.words import MEMORY


class Vocabulary:
    """Ranks of byte strings, and the merges by which each token arises."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.reachable: dict[bytes, int] = {}
        parts: dict[int, tuple[int, int]] = {}
        for raw, token in ranks.items():
            steps = self._merge(raw)
            if len(steps[-1]) == 1:
                self.reachable[raw] = token
            if len(steps) > 1 and len(steps[-2]) == 2:
                parts[token] = (ranks[steps[-2][0]], ranks[steps[-2][1]])
        #: Tokens that lie at the end (start) of a token while it is built: bytes,
        #: rank that makes them and rank that takes them up, from the token inwards.
        self.right = {t: self._spine(t, parts, 1) for t in self.reachable.values()}
        self.left = {t: self._spine(t, parts, 0) for t in self.reachable.values()}
        #: Lengths of the tokens with the same last bytes (three at most), longest first.
        self.lengths: dict[bytes, list[int]] = {}
        for raw in self.reachable:
            for n in range(1, min(3, len(raw)) + 1):
                if n == 3 or n == len(raw):
                    self.lengths.setdefault(raw[-n:], []).append(len(raw))
        self.lengths = {k: sorted(set(v), reverse=True) for k, v in self.lengths.items()}
        self._pairs: dict[tuple[int, int], bool] = {}

    def _merge(self, piece: bytes) -> list[list[bytes]]:
        """The states of a piece while neighbours merge by rank, the last two at least."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        states = [parts]
        while len(parts) > 1:
            found = [(self.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                     if a + b in self.ranks]
            if not found:
                break
            i = min(found)[1]
            parts = parts[:i] + [parts[i] + parts[i + 1]] + parts[i + 2:]
            states = [states[-1], parts]
        return states

    def merged(self, piece: bytes) -> list[int]:
        """Ids after merging neighbours by rank, lowest first, leftmost among equals."""
        return [self.ranks[p] for p in self._merge(piece)[-1]]

    def _spine(self, token: int, parts: dict, side: int) -> list[tuple[bytes, int, float]]:
        out, taken = [], float("inf")
        while token is not None:
            made = token if token in parts else -1
            out.append((self.bytes[token], made, taken))
            taken = token
            token = parts[token][side] if token in parts else None
        return out

    def follows(self, first: int, second: int) -> bool:
        """Whether the bytes of both tokens together encode as these two tokens.

        They don't when a part at the end of the first and a part at the start of
        the second exist together and merge before either is taken up.  Of equal
        ranks the leftmost merges first, which is the one inside the first token.
        """
        known = self._pairs.get((first, second))
        if known is None:
            if len(self._pairs) >= 4 * MEMORY:
                self._pairs.clear()
            known = self._pairs[first, second] = self._apart(self.right[first], self.left[second])
        return known

    def _apart(self, right: list, left: list) -> bool:
        i = j = 0
        while True:
            a, made_a, taken_a = right[i]
            b, made_b, taken_b = left[j]
            rank = self.ranks.get(a + b)
            if rank is not None and rank < taken_a and rank <= taken_b:
                return False
            # Go back in time: the younger of the two parts is taken apart.
            if made_a < 0 and made_b < 0:
                return True
            if made_a > made_b:
                i += 1
            else:
                j += 1


class Prefixes:
    """A piece of text under construction: the last token of each of its byte prefixes."""

    def __init__(self, vocabulary: Vocabulary, text: bytes = b""):
        self.vocabulary = vocabulary
        self.text = bytearray()
        self.last: list[int] = [-1]  # of the empty prefix
        self.append(text)

    def append(self, more: bytes) -> Prefixes:
        self.text += more
        v, text, last = self.vocabulary, bytes(self.text), self.last
        token_of, lengths = v.reachable.get, v.lengths.get
        for end in range(len(last), len(text) + 1):
            token = self._longest(lengths(text[max(0, end - 3):end], ()) if end > 2 else (), end, text, token_of)
            if token is None:
                token = self._longest((2, 1), end, text, token_of)
            if token is None:
                raise ValueError(f"byte {text[end - 1]} has no token")
            last.append(token)
        return self

    def _longest(self, lengths, end: int, text: bytes, token_of) -> int | None:
        last, follows = self.last, self.vocabulary.follows
        for n in lengths:
            start = end - n
            if start >= 0:
                token = token_of(text[start:end])
                if token is not None and (start == 0 or follows(last[start], token)):
                    return token
        return None

    def replace(self, start: int, end: int, new: bytes) -> Prefixes:
        """Edit the text; prefixes before the edit keep their tokens."""
        tail = bytes(self.text[end:])
        del self.text[start:], self.last[start + 1:]
        return self.append(new + tail)

    def ids(self) -> list[int]:
        out, at = [], len(self.text)
        while at:
            out.append(self.last[at])
            at -= len(self.vocabulary.bytes[self.last[at]])
        return out[::-1]


class _Odd(Exception):
    """White space beside a blank: the text can't be taken apart at its blanks."""


class _Spaced(dict):
    """Packed ids of a blank and the characters up to the next one."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, part: str) -> bytes:
        if not part or part[0].isspace() or part[-1].isspace():
            raise _Odd
        if len(self) >= MEMORY:
            self.clear()
        packed = self[part] = self.encode(" " + part)
        return packed


class Codec:
    """Encodes and decodes texts; what was seen before is remembered, up to a bound."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pieces = regex.compile(pattern).findall
        self._spaced = _Spaced(self._whole)

    def _piece(self, piece: str) -> bytes:
        word = piece[1:] if piece[0] == " " and len(piece) > 1 else None
        known = self._spaced.get(word)
        if known is not None:
            return known
        raw = piece.encode("utf-8", "replace")
        whole = self.vocabulary.ranks.get(raw)
        ids = [whole] if whole is not None else Prefixes(self.vocabulary, raw).ids()
        packed = array("I", ids).tobytes()
        if word is not None and not word[0].isspace():
            self._spaced[word] = packed  # words with marks behind them have it as a part
        return packed

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.pieces(text)))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers.

        No match of the pattern crosses the place before a blank that stands alone
        between other characters, so what lies between such places is encoded apart.
        """
        first, *rest = (text or "").split(" ")
        try:
            if rest and (not first or first[-1].isspace()):
                raise _Odd
            return self._whole(first) + b"".join(map(self._spaced.__getitem__, rest))
        except _Odd:
            return self._whole(text)

    def decode(self, packed: bytes) -> bytes:
        ids = array("I", packed)
        return b"".join(map(self.vocabulary.bytes.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """From a rank file: a line holds base64 bytes, a blank and the rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(b): int(i) for b, i in (line.split() for line in lines if line.strip())}
    return Codec(ranks, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, digests of ids and of the decoded bytes, and the ids of every row.

    ``docs`` has doc_id and text; other columns are ignored.  A null text counts as
    empty, and an empty text has no tokens.  Rows that repeat a doc_id are encoded
    each; no rows give no rows.  No shuffle: every row is encoded where it is read.
    """

    def run(rows: Rows) -> Rows:
        c = codec(path, pattern)
        for doc_id, text in rows:
            packed = c.encode(text)
            out = (doc_id, len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                   hashlib.sha256(c.decode(packed)).hexdigest())
            yield (*out, list(array("I", packed))) if with_ids else out

    kinds = {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}
    if with_ids:
        kinds["ids"] = "array<bigint>"
    return map_rows(only(docs, doc_id="bigint", text="string"), run, 256 if with_ids else 4096, **kinds)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give a null text."""

    def run(rows: Rows) -> Rows:
        c = codec(path, pattern)
        for doc_id, ids in rows:
            yield doc_id, None if ids is None else c.decode(array("I", ids).tobytes()).decode("utf-8", "replace")

    return map_rows(encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<bigint>")),
                    run, 256, doc_id="bigint", text="string")
