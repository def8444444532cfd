"""Vectorised hashing of words and word runs, for use inside tasks."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the public-domain splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    """1, B, B^2, ... modulo 2^64, at least n of them."""
    global _powers
    if len(_powers) < n:
        with np.errstate(over="ignore"):
            size = max(4096, 1 << (n - 1).bit_length())
            _powers = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE, dtype=np.uint64))))
    return _powers


class Words(NamedTuple):
    """The words of several texts laid end to end; text i has words first[i]:first[i + 1]."""

    raw: bytes
    start: np.ndarray  # byte positions in raw
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray


def words(texts: list[bytes]) -> Words:
    """Split at the six ASCII white-space bytes and hash every word; 64 bits each."""
    raw = b"\n".join(texts) + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    space = _SPACE[data]
    ends = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not space[0]:
        starts = np.concatenate(([0], starts))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    first = np.searchsorted(starts, bounds)
    if not len(starts):
        return Words(raw, starts, ends, np.zeros(0, np.uint64), first)
    with np.errstate(over="ignore"):
        # within a word, byte j counts with B^j; white space counts nothing
        value = _BYTE[data[starts[0] :]]
        value[space[starts[0] :]] = 0
        offset = np.arange(len(value)) - np.repeat(starts - starts[0], np.diff(np.append(starts, len(data))))
        value *= powers(int(offset.max()) + 1)[offset]
        h = mix(np.add.reduceat(value, starts - starts[0]) + (ends - starts).astype(np.uint64))
    return Words(raw, starts, ends, h, first)


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive words, by the run's first word; len(h) - k + 1 of them."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    p = powers(k)
    with np.errstate(over="ignore"):
        out = h[:n] * p[0]
        for j in range(1, k):
            out += h[j : j + n] * p[j]
        return mix(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every window of ``width`` entries, by doubling."""
    n, have = len(x) - width + 1, 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[:n], x[width - have : width - have + n])
