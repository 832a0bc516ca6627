"""Sets of hashed word shingles, for many texts at a time, in numpy.

A word's hash is a polynomial over its bytes modulo 2**64, mixed; a shingle's hash combines the
hashes of its words by place and is mixed again. Sets are compared by these 64-bit values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
CHUNK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PLACES = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(SIZE)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as longer chunks come."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))


_POWERS = Powers()


def _chunk(raws: list[bytes]) -> Iterator[np.ndarray]:
    data = np.frombuffer(b"\n".join([*raws, b""]).translate(_LOWER), np.uint8)
    _POWERS.need(len(data) + 1)
    edges = np.diff(np.concatenate(([0], (~_BLANK[data]).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * _POWERS.down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raws])))
    first = np.searchsorted(starts, bounds)
    n = len(words)
    whole = np.zeros(max(0, n - SIZE + 1), np.uint64)
    for i in range(SIZE if len(whole) else 0):
        whole += words[i : i + len(whole)] * _PLACES[i]
    whole = mix(whole + np.uint64(SIZE))
    for lo, hi in zip(first[:-1], first[1:]):
        if hi - lo >= SIZE:
            yield np.unique(whole[lo : hi - SIZE + 1])
        elif hi > lo:
            short = sum(int(words[lo + i]) * int(_PLACES[i]) for i in range(hi - lo)) + int(hi - lo)
            yield mix(np.array([short & (2**64 - 1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order; chunks bound what is held at once.

    Five words in a row make a shingle; a text of one to four words is one shingle; a text without
    words, or null, has none.
    """
    pending, held = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        pending.append(raw)
        held += len(raw) + 1
        if held >= CHUNK_BYTES:
            yield from _chunk(pending)
            pending, held = [], 0
    if pending:
        yield from _chunk(pending)
