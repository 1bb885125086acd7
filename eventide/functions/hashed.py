"""Random draws that depend only on their labels.

A draw is the MD5 of its label read as a fraction of [0, 1).  Task order,
retries and partitioning cannot change it, and any SQL engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 48


def label(*parts: Column | str | int) -> Column:
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws("|", *[c.cast("string") for c in cols])


def uniform(*parts: Column | str | int) -> Column:
    """Uniform draw in [0, 1) from the first 48 bits of the MD5."""
    digits = F.substring(F.md5(label(*parts).cast("binary")), 1, _BITS // 4)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**_BITS))


def index_below(n: Column, *parts: Column | str | int) -> Column:
    """Uniform integer in ``0 .. n - 1``."""
    return F.least(F.floor(uniform(*parts) * n).cast("bigint"), n.cast("bigint") - 1)


def session_seed(seed: int, *identity: Column) -> Column:
    """First eight SHA-256 bytes of ``seed|identity...``, little endian, as text."""
    digest = F.substring(F.sha2(label(seed, *identity), 256), 1, 16)
    pairs = [F.substring(digest, 2 * k + 1, 2) for k in reversed(range(8))]
    return F.conv(F.concat(*pairs), 16, 10)


# ------------------------------------------------------------ the same draws for whole grids of labels

_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_SINES = [int(abs(np.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MASK = 0xFFFFFFFF
#: Labels that are hashed side by side.
_SIDE_BY_SIDE = 32768
#: Indices that are handed over at a time, unless one b has more.
_HELD = 1 << 20


def _compressed(state: tuple, words: list[int | np.ndarray]) -> tuple:
    """MD5 state after one more block; state and words are numbers where all messages agree, else arrays of one shape."""
    shapes = [x.shape for x in (*state, *words) if isinstance(x, np.ndarray)]
    if not shapes:
        return tuple((x + y) & _MASK for x, y in zip(_steps(state, words, 64), state))
    # Steps until the first word that differs are taken once, as numbers.
    differs = 0 if any(isinstance(x, np.ndarray) for x in state) else next(i for i in range(16) if isinstance(words[i], np.ndarray))
    at = _steps(state, words, differs)
    a, b, c, d = (x.copy() if isinstance(x, np.ndarray) else np.full(shapes[0], x, np.uint32) for x in at)
    f, t = np.empty(shapes[0], np.uint32), np.empty(shapes[0], np.uint32)
    for i in range(differs, 64):
        kind = i // 16
        if kind == 0:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif kind == 1:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif kind == 2:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        word = words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]
        np.add(f, a, out=f)
        if isinstance(word, np.ndarray):
            np.add(f, np.uint32(_SINES[i]), out=f)
            np.add(f, word, out=f)
        else:
            np.add(f, np.uint32((_SINES[i] + word) & _MASK), out=f)
        s = _SHIFTS[kind][i % 4]
        np.left_shift(f, np.uint32(s), out=t)
        np.right_shift(f, np.uint32(32 - s), out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, b, c, d, f = d, f, b, c, a
    for own, before in zip((a, b, c, d), state):
        np.add(own, before if isinstance(before, np.ndarray) else np.uint32(before), out=own)
    return a, b, c, d


def _steps(state: tuple, words: list[int], n: int) -> tuple:
    """The first ``n`` steps of a block whose words are numbers."""
    a, b, c, d = state
    for i in range(n):
        kind = i // 16
        f = (d ^ (b & (c ^ d)), c ^ (d & (b ^ c)), b ^ c ^ d, c ^ (b | (~d & _MASK)))[kind]
        f = (f + a + _SINES[i] + words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16]) & _MASK
        s = _SHIFTS[kind][i % 4]
        a, b, c, d = d, (b + ((f << s) | (f >> (32 - s)))) & _MASK, b, c
    return a, b, c, d


def _placed(chars: np.ndarray, place: int) -> dict[int, np.ndarray]:
    """Rows of characters, written from byte ``place`` on, as words by their number."""
    words: dict[int, np.ndarray] = {}
    for at, char in enumerate(chars.T, place):
        part = char.astype(np.uint32) << np.uint32(8 * (at % 4))
        words[at // 4] = words[at // 4] | part if at // 4 in words else part
    return words


@lru_cache(maxsize=64)
def _digit_words(first: int, count: int, digits: int, place: int) -> dict[int, np.ndarray]:
    """The digits of ``first .. first + count - 1`` from byte ``place`` on."""
    values = np.arange(first, first + count, dtype=np.uint32)
    return _placed(np.stack([values // 10 ** (digits - 1 - k) % 10 + 48 for k in range(digits)], axis=1), place)


def _by_digits(first: int, last: int) -> Iterator[tuple[int, int, int]]:
    """Ranges of ``first .. last - 1`` whose numbers have equally many digits."""
    while first < last:
        digits = len(str(first))
        stop = min(last, 10**digits)
        yield first, stop, digits
        first = stop


def _grid_bits(message: bytes, rows: dict[int, np.ndarray], columns: list[dict[int, np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """First 48 bits of the MD5 of messages: ``message`` with what its rows and columns write on zero bytes."""
    size = len(message)
    padded = message + b"\x80" + bytes(-(size + 9) % 64) + (8 * size).to_bytes(8, "little")
    words: list[int | np.ndarray] = np.frombuffer(padded, "<u4").tolist()
    for written, side in ((rows, (-1, 1)), *((c, (1, -1)) for c in columns)):
        for at, part in written.items():
            word = words[at] if isinstance(words[at], np.ndarray) else np.uint32(words[at])
            words[at] = np.bitwise_or(word, part.reshape(side))
    state: tuple = _START
    for first in range(0, len(words), 16):
        state = _compressed(*_alike(state, words[first:first + 16], shape))
    high, low = (x.byteswap().astype(np.uint64) for x in state[:2])
    return np.broadcast_to((high << np.uint64(16)) | (low >> np.uint64(16)), shape)


def _alike(state: tuple, words: list, shape: tuple[int, int]) -> tuple[tuple, list]:
    """Numbers where there is one value, else arrays of the rows and columns by which this block differs."""
    every = [x for x in (*state, *words) if isinstance(x, np.ndarray) and x.size > 1]
    own = np.broadcast_shapes(*[x.shape for x in every]) if every else (1, 1)

    def one(x):
        if not isinstance(x, np.ndarray):
            return x
        if x.size == 1 and own == (1, 1) != shape:
            return int(x.item())
        return np.ascontiguousarray(np.broadcast_to(x, own))

    return tuple(map(one, state)), [one(w) for w in words]


def indices(prefix: str, n: int, first: int, last: int) -> Iterator[tuple[int, np.ndarray]]:
    """``index_below(n, prefix, b, slot)`` for b in ``first .. last - 1`` and all n slots, some b at a time.

    Gives the first b and a matrix with a row per b.
    """
    text = prefix.encode()
    step = max(1, min(128, _HELD // max(1, n)))
    for start, stop, b_digits in _by_digits(first, last):
        for b0 in range(start, stop, step):
            b = range(b0, min(stop, b0 + step))
            out = np.empty((len(b), n), np.int64)
            for s0, s1, digits in _by_digits(0, n):
                for at in range(s0, s1, _SIDE_BY_SIDE):
                    slot = range(at, min(s1, at + _SIDE_BY_SIDE))
                    rows = max(1, _SIDE_BY_SIDE // len(slot))
                    for r in range(0, len(b), rows):
                        some, place = b[r:r + rows], len(text) + 1
                        bits = _grid_bits(text + b"|" + bytes(b_digits) + b"|" + bytes(digits),
                                          _digit_words(some.start, len(some), b_digits, place),
                                          [_digit_words(slot.start, len(slot), digits, place + b_digits + 1)], (len(some), len(slot)))
                        u = bits.astype(np.float64) / float(2**_BITS)
                        out[r:r + rows, at:at + len(slot)] = np.minimum(np.floor(u * n), n - 1)
            yield b0, out


def uniforms(heads: list[bytes], first: int, last: int, tails: list[bytes]) -> np.ndarray:
    """``uniform`` of the labels ``head|b`` + tail: a row per head and its tail, a column per b in ``first .. last - 1``."""
    out = np.empty((last - first, len(heads)))
    sizes = np.array([(len(h), len(t)) for h, t in zip(heads, tails)]).reshape(-1, 2)
    for before, after in np.unique(sizes, axis=0).tolist():
        own = np.flatnonzero((sizes == (before, after)).all(axis=1))
        chars = [np.frombuffer(b"".join(part[i] for i in own), np.uint8).reshape(len(own), -1) for part in (heads, tails)]
        for start, stop, digits in _by_digits(first, last):
            step = max(1, _SIDE_BY_SIDE // (stop - start))
            for at in range(0, len(own), step):
                columns = [_placed(c[at:at + step], place) for c, place in zip(chars, (0, before + 1 + digits))]
                some = own[at:at + step]
                bits = _grid_bits(bytes(before) + b"|" + bytes(digits + after), _digit_words(start, stop - start, digits, before + 1),
                                  columns, (stop - start, len(some)))
                out[start - first:stop - first, some] = bits / float(2**_BITS)
    return out.T
