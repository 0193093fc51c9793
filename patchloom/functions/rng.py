"""Counter-based randomness: a pure function of its key, so it does not change with partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key(*parts: Column | str | int) -> Column:
    """The parts as text, joined by ``|``; strings name columns, integers are literals."""
    return F.concat_ws(
        "|", *[F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts],
    )


def bits(*parts: Column | str | int) -> Column:
    """An integer from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(key(*parts)), 1, 8), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return bits(*parts) / F.lit(4294967296.0)


def bits_sql(*parts: str | int) -> str:
    """:func:`bits` for a second SQL engine; parts are SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(str(p) if isinstance(p, str) else f'{p}' for p in parts)})), 1, 8))::UBIGINT::BIGINT"


def uniform_sql(*parts: str | int) -> str:
    return f"({bits_sql(*parts)} / 4294967296.0::DOUBLE)"


# As arrays of one element, which numpy need not convert at each use.
_ONE = [np.full(1, i, np.uint32) for i in range(33)]
_K = [np.full(1, int(abs(math.sin(i + 1)) * 4294967296), np.uint32) for i in range(64)]
_TURN = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def _block(state: list[np.ndarray], words: np.ndarray) -> list[np.ndarray]:
    """MD5's state after one more block of many texts at once; ``words`` has a row for each of its 16 words."""
    (a, b, c, d), f = (x.copy() for x in state), np.empty_like(state[0])
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, f)
            np.bitwise_and(f, b, f)
            np.bitwise_xor(f, d, f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, f)
            np.bitwise_and(f, d, f)
            np.bitwise_xor(f, c, f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, f)
            np.bitwise_xor(f, d, f)
        else:
            g = 7 * i % 16
            np.invert(d, f)
            np.bitwise_or(f, b, f)
            np.bitwise_xor(f, c, f)
        turn = _TURN[i // 16][i % 4]
        np.add(a, f, a)
        np.add(a, words[g], a)
        np.add(a, _K[i], a)
        np.left_shift(a, _ONE[turn], f)
        np.right_shift(a, _ONE[32 - turn], a)
        np.bitwise_or(a, f, a)
        np.add(a, b, a)
        a, b, c, d = d, a, b, c
    return [x + y for x, y in zip(state, (a, b, c, d), strict=True)]


def bits_of(parts: list, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """:func:`bits` of ``parts`` and many pairs of numbers, from 0 to 2^31 - 1, inside a task: the digests of all pairs side by side."""
    start = "".join(f"{p}|" for p in parts).encode()
    before = len(start) // 64 * 64
    state = [np.full(1, s, np.uint32) for s in _START]
    for i in range(0, before, 64):
        state = _block(state, np.frombuffer(start, "<u4", 16, i)[:, None])
    rest = np.frombuffer(start, np.uint8, offset=before)
    powers = 10 ** np.arange(1, 10)
    wide, high = (np.searchsorted(powers, v, "right") + 1 for v in (x, y))
    # Pairs with equally many digits lie together, so that each digit is one run of bytes; those that fill as many blocks are hashed at once.
    kind = (wide * 16 + high).astype(np.uint16)
    order = np.argsort(kind, kind="stable")
    x, y, ends = x[order].astype(np.uint32), y[order].astype(np.uint32), np.cumsum(np.bincount(kind, minlength=256))
    size = len(rest) + 1 + wide[order] + high[order]
    blocks = (size + 8) // 64 + 1
    text = np.zeros((blocks.max(initial=1) * 64, len(x)), np.uint8)
    text[: len(rest)] = rest[:, None]
    for k in np.unique(kind).tolist():
        at, (w, h) = slice(ends[k - 1], ends[k]), divmod(k, 16)
        for v, end, digits in ((x[at], len(rest) + w, w), (y[at], len(rest) + w + 1 + h, h)):
            for i in range(1, digits + 1):
                tens = v // np.uint32(10)
                text[end - i, at] = v - tens * np.uint32(10) + np.uint32(48)
                v = tens
        text[len(rest) + w, at], text[len(rest) + w + 1 + h, at] = 124, 128
    words = text[::4].astype(np.uint32)
    for i in (1, 2, 3):
        words |= text[i::4].astype(np.uint32) << np.uint32(8 * i)
    out = np.empty(len(x), np.uint32)
    for n in np.unique(blocks).tolist():
        own = blocks == n
        own = slice(None) if own.all() else np.flatnonzero(own)
        part = words[: 16 * n, own]
        part[16 * n - 2] = (before + size[own]) * 8
        s = [np.repeat(v, part.shape[1]) for v in state]
        for i in range(0, 16 * n, 16):
            s = _block(s, part[i : i + 16])
        out[order[own]] = s[0].byteswap()
    return out
