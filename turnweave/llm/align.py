"""Banded alignment of two word sequences by bit vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence


def within(a: Sequence, b: Sequence, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and substitutions turn a into b.

    Only the diagonal band of half-width ``most`` is computed. A column of the band is held as
    two bit vectors (where the distance rises and falls from row to row; Myers 1999, Hyyrö 2003),
    so a step costs a few operations on integers of 2 * most + 1 bits.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    lo, hi = 0, 0
    while lo < len(b) and a[lo] == b[lo]:
        lo += 1
    while hi < len(b) - lo and a[len(a) - 1 - hi] == b[len(b) - 1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    m, n, t = len(a), len(b), most
    if m <= t or not n:
        return m <= t
    if m - sum((Counter(a) & Counter(b)).values()) > t:
        return False
    rows_of: dict = {}
    for i, x in enumerate(a):
        rows_of[x] = rows_of.get(x, 0) | 1 << i
    full = (1 << 2 * t + 1) - 1
    bottom = 1 << 2 * t
    up, down = (full >> t) << t, 0  # bit i: row j - t + i of column j
    distance = t
    for j in range(1, n + 1):
        x = rows_of.get(b[j - 1], 0)
        x = (x >> j - t - 1 if j > t else x << t + 1 - j) & full
        same = (((x & up) + up) ^ up | x | down) & full
        right_up, right_down = down | full ^ (same | up), same & up
        if j <= m - t:
            distance += not same & bottom
        else:
            row = 1 << m - j + t
            distance += bool(right_up & row) - bool(right_down & row)
        up = right_down | full ^ (same >> 1 | right_up)
        down = same >> 1 & right_up
    return distance <= t


def similar(a: bytes, b: bytes, least: float) -> bool:
    """1 - edits / longer length, over words, is at least ``least``; two wordless texts are alike."""
    return Texts(least).similar(a, b)


class Texts:
    """Compares texts and remembers the words of those it has met, up to a bound."""

    def __init__(self, least: float, most_bytes: int = 30_000_000):
        self.least, self.most_bytes, self.known, self.size = least, most_bytes, {}, 0

    def _words(self, text: bytes) -> tuple[list[bytes], Counter]:
        got = self.known.get(text)
        if got is None:
            words = text.split()
            got = (words, Counter(words))
            if self.size > self.most_bytes:
                self.known.clear()
                self.size = 0
            self.known[text] = got
            self.size += len(text)
        return got

    def similar(self, a: bytes, b: bytes) -> bool:
        (x, in_x), (y, in_y) = self._words(a), self._words(b)
        longer = max(len(x), len(y))
        most = int((1 - self.least) * longer + 1e-9)
        # words that have no partner at all are edits
        return abs(len(x) - len(y)) <= most and longer - (in_x & in_y).total() <= most and within(x, y, most)
