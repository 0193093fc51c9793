"""Rolling hashes over whole batches of text, in numpy.

Texts are laid end to end as code points; one prefix sum gives the hash of any
window of any length in constant time.  Positions are chosen by content
(winnowing, Schleimer et al. 2003): of every ``span`` neighbouring windows the
one with the smallest hash, so that two texts that share a long enough stretch
choose the same places in it whatever stands around it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1 << 20  #: code points hashed at once; positions in a chunk fit in 20 bits
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK + 1)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b)])) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _B
    x ^= x >> np.uint64(29)
    return x


class Hasher:
    """Hash of any window of a sequence of code points."""

    def __init__(self, codes: np.ndarray):
        value = codes.astype(np.uint64)
        value += np.uint64(1)
        value *= _A
        value ^= value >> np.uint64(32)
        power, self.inverse = _tables(len(codes) + 1)
        value *= power[:-1]
        self.sums = np.zeros(len(codes) + 1, np.uint64)
        np.add.accumulate(value, out=self.sums[1:])

    def all(self, width: int) -> np.ndarray:
        """The windows of one width, at every start."""
        x = self.sums[width:] - self.sums[:-width]
        x *= self.inverse[: len(x)]
        return mix(x)

    def some(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        a = np.minimum(a[:-done], a[done:])
        done *= 2
    return np.minimum(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def smallest(hashes: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of each ``width`` neighbouring hashes, the leftmost among equals."""
    low = np.uint64(CHUNK - 1)
    packed = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    return (sliding_min(packed, width) & low).astype(np.int64)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def pieces(texts: Iterable[tuple[int, str | None]], need: int) -> Iterator[
    tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]
]:
    """Texts packed into chunks, long ones cut with an overlap of ``need - 1``.

    Yields the chunk's code points, and for each piece its place in the chunk,
    the index of its text, its place in that text, and the piece itself.
    Texts shorter than ``need`` hold no window and are passed over.
    """
    step = CHUNK // 2
    held: list[tuple[int, int, str]] = []
    size = 0
    for i, text in texts:
        if text is None:
            continue
        for at in range(0, len(text) - need + 1, step):
            piece = text[at : at + step + need - 1]
            if held and size + len(piece) > CHUNK:
                yield _packed(held)
                held, size = [], 0
            held.append((i, at, piece))
            size += len(piece)
    if held:
        yield _packed(held)


def _packed(held: list[tuple[int, int, str]]):
    texts = [p for _, _, p in held]
    length = np.array([len(p) for p in texts], np.int64)
    place = np.concatenate([[0], np.cumsum(length)[:-1]])
    return codes_of("".join(texts)), place, np.array([i for i, _, _ in held], np.int64), np.array([a for _, a, _ in held], np.int64), texts
