"""Hierarchical packing of tokenised documents into windows of several lengths.

Windows come in tiers of 2048, 1024, 512, ... tokens.  A document is first cut
into full longest windows; what remains is routed to the smallest tier that
holds it.  Each tier packs its pieces in arrival order; the gap that a piece
leaves in a long window is filled by pieces of the shorter tiers, longest first,
and the last of them is cut where the window ends.  What is left when a task has
read all its documents is split into windows whose lengths are powers of two, so
no window needs padding.

A task packs the documents of its own input partition: no shuffle, and the state
is the open pieces of the tiers, bounded by ``len(TIERS) * WINDOW`` tokens.  The
window ids of a task are numbered from (partition id << 32), so a task that runs
again writes the same ids.

Step groups are balanced by tokens: every group of a tier holds ``step_tokens``
tokens (64 windows of 2048 or 128 of 1024 and so on); only a task's last group of
each tier may hold less.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import deque
from functools import lru_cache
from itertools import islice

from pyspark import TaskContext
from pyspark.sql import DataFrame

from eventide.llm.columns import Rows, map_rows, only
from eventide.llm.words import MEMORY, utf8

WINDOW = 2048
END_ID = 1
STEP_TOKENS = 64 * WINDOW
#: Lengths of windows, longest first.
TIERS = tuple(WINDOW >> i for i in range(WINDOW.bit_length()))

_MARKS = frozenset(bytes([c]) for c in b".,;:!?")

PIECE = dict.fromkeys(
    ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window",
     "step_group"), "bigint")


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    # One thread a task: the scheduler deals out the cores.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


class WordIds:
    """Token ids of white-space separated words, as little-endian 32-bit integers.

    White space never belongs to a token, so a text's ids are its words' ids.
    Words seen before are remembered, up to a bound.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        self.known: dict[bytes, bytes] = {}

    def learn(self, texts: list[list[bytes]]) -> None:
        """Words that end with a mark behind an ASCII letter or digit are two pieces to
        the tokenizer, so only what stands before the mark has to be encoded."""
        if len(self.known) >= MEMORY:
            self.known.clear()
        known = self.known
        new = set().union(*texts).difference(known)
        marked = {w for w in new if len(w) > 1 and w[-1:] in _MARKS and w[-2:-1].isalnum()}
        new.difference_update(marked)
        new.update({w[:-1] for w in marked}.difference(known), {w[-1:] for w in marked}.difference(known))
        new = list(new)
        encoded = self.tokenizer.encode_batch_fast(
            [w.decode("utf-8", "replace") for w in new], add_special_tokens=False)
        known.update((w, array("I", e.ids).tobytes()) for w, e in zip(new, encoded))
        known.update((w, known[w[:-1]] + known[w[-1:]]) for w in marked)

    def encode(self, texts: list[str | None], end_id: int = END_ID) -> list[bytes]:
        """Ids of each text, with the end id behind them."""
        split = [utf8(t).lower().split() for t in texts]  # the tokenizer lower-cases too
        self.learn(split)
        end = array("I", [end_id]).tobytes()
        return [b"".join(map(self.known.__getitem__, w)) + end for w in split]


_memory: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    if path not in _memory:
        _memory[path] = WordIds(path)
    return _memory[path]


def _tier(n: int) -> int:
    """Smallest tier that holds ``n`` tokens, as a power of two."""
    return 1 << (n - 1).bit_length()


class Packer:
    """Packs pieces (doc, start, ids) of one task into windows."""

    def __init__(self, first_id: int, window: int = WINDOW, step_tokens: int = STEP_TOKENS):
        if window & (window - 1):
            raise ValueError("the window length must be a power of two")
        self.window, self.step_tokens = window, step_tokens
        self.next_id = first_id
        self.first_id = first_id
        self.waiting = {window >> i: deque() for i in range(window.bit_length())}
        self.total = 0
        self.packed: dict[int, int] = {}
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n = len(ids) // 4
        start = 0
        while n - start >= self.window:
            self._window(self.window, [(doc_id, start, self.window, ids, n)])
            start += self.window
        if start < n:
            self.waiting[_tier(n - start)].append((doc_id, start, n - start, ids[4 * start:], n, start))
            self.total += n - start
        while self.total >= 2 * self.window:
            self._fill(self.window)

    def finish(self) -> None:
        while self.total:
            length = min(self.window, 1 << (self.total.bit_length() - 1))
            self._fill(length)

    def _take(self, most: int) -> tuple:
        """The first waiting piece of the longest tier that fits, else the shortest that is longer."""
        tiers = sorted(self.waiting, reverse=True)
        fit = next((t for t in tiers if self.waiting[t] and self.waiting[t][0][2] <= most), None)
        if fit is None:
            fit = next(t for t in reversed(tiers) if self.waiting[t])
        piece = self.waiting[fit].popleft()
        self.total -= piece[2]
        return piece

    def _fill(self, length: int) -> None:
        gap, pieces = length, []
        while gap:
            doc_id, start, n, ids, whole, base = self._take(gap)
            used = min(n, gap)
            at = 4 * (start - base)
            pieces.append((doc_id, start, used, ids[at:at + 4 * used], whole))
            if used < n:
                rest = n - used
                self.waiting[_tier(rest)].appendleft((doc_id, start + used, rest, ids, whole, base))
                self.total += rest
            gap -= used
        self._window(length, pieces)

    def _window(self, length: int, pieces: list[tuple]) -> None:
        done = self.packed.get(length, 0)
        step = done // self.step_tokens
        self.packed[length] = done + length
        offset = 0
        for doc_id, start, n, ids, whole in pieces:
            part = ids if len(ids) == 4 * n else ids[4 * start:4 * (start + n)]
            self.rows.append((doc_id, start, n, zlib.crc32(part), whole, self.next_id, offset, length,
                              self.first_id + step * self.window.bit_length() + length.bit_length() - 1))
            offset += n
        self.next_id += 1

    def drain(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID,
         step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in its window.

    ``docs`` has doc_id and text; other columns are ignored.  A null or empty text
    is the end id alone, so every row of ``docs`` gives at least one piece; rows
    that repeat a doc_id are packed each.  Longer texts than a window are cut.  No
    rows give no pieces.
    """

    def run(rows: Rows) -> Rows:
        ids = encoder(tokenizer_path)
        packer = Packer(TaskContext.get().partitionId() << 32, window, step_tokens)
        while some := list(islice(rows, 64)):
            for (doc_id, _), packed in zip(some, ids.encode([t for _, t in some], end_id)):
                packer.add(doc_id, packed)
            yield from packer.drain()
        packer.finish()
        yield from packer.drain()

    return map_rows(only(docs, doc_id="bigint", text="string"), run, **PIECE)
