"""Edit distances of many pairs of texts at once, in numpy: bit-parallel (Myers, in the blocks of Hyyro), exact, without a bound on length.

A column of the distance table is kept as two bits a row, 64 rows to a word. All pairs of a chunk go forward together, and of a pair with several
words, word ``b`` stands ``b`` characters behind the first, so that what it carries up is there in the next step. A pair costs one word operation for
64 cells; a chunk holds at most ``ITEMS`` numbers in each of its tables.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

ITEMS, PAIRS = 1 << 21, 1 << 13
_ONE, _TOP = np.uint64(1), np.uint64(63)


def codes(texts: Sequence[str]) -> np.ndarray:
    """Code points of all texts, one after the other, numbered from 1 in the order of their values."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return points.astype(np.int64)
    used = np.zeros(int(points.max()) + 1, bool)
    used[points] = True
    return np.cumsum(used)[points]


def _words(m: np.ndarray) -> np.ndarray:
    return (m + 63) >> 6


def distances(text: np.ndarray, at: np.ndarray, m: np.ndarray, to: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Insertions, removals and replacements of one character between ``text[at:at + m]`` and ``text[to:to + n]``, pair by pair."""
    swap = _words(n) * m < _words(m) * n  # the cheaper of the two as the pattern
    at, m, to, n = np.where(swap, to, at), np.where(swap, n, m), np.where(swap, at, to), np.where(swap, m, n)
    out = np.maximum(m, n)
    words = _words(m)
    order = np.lexsort((-n, words))
    order = order[(m[order] > 0) & (n[order] > 0)]
    letters = int(text.max()) + 1 if len(text) else 1
    start = 0
    while start < len(order):
        w, longest = int(words[order[start]]), int(n[order[start]])
        most = max(1, min(PAIRS, ITEMS // max(w * letters, longest)))
        some = order[start:start + most]
        some = some[:np.searchsorted(words[some], w, side="right")]
        out[some] = _chunk(text, letters, w, at[some], m[some], to[some], n[some])
        start += len(some)
    return out


def nearest(pattern: np.ndarray, text: np.ndarray) -> np.ndarray:
    """After each number of characters of the text, from none to all, the least distance of the pattern from a stretch that ends there."""
    both, zero = np.concatenate([pattern, text]), np.zeros(1, np.int64)
    m, n = zero + len(pattern), zero + len(text)
    out = np.full(len(text) + 1, len(pattern), np.int64)
    if len(pattern) and len(text):
        _chunk(both, int(both.max()) + 1, int(_words(m)[0]), zero, m, m, n, out[1:])
    return out


def _chunk(text: np.ndarray, letters: int, words: int, at: np.ndarray, m: np.ndarray, to: np.ndarray, n: np.ndarray,
           ends: np.ndarray | None = None) -> np.ndarray:
    """Distances of pairs whose patterns have equally many words, longest text first. With ``ends``, of one pair and with any beginning of the text left out, written
    there for each end."""
    pairs, longest, end = len(at), int(n[0]), len(text) - 1
    place = np.arange(words * pairs).reshape(words, pairs) * letters
    equal = np.zeros(words * pairs * letters, np.uint64)  # by word, pair and letter: the rows with that letter
    for k in range(int(m.max())):
        letter = np.where(k < m, text[np.minimum(at + k, end)], 0)  # 0 is no letter, what it marks lies above the last row
        equal[place[k >> 6] + letter] |= np.uint64(1 << (k & 63))
    columns = np.zeros((longest, pairs), np.int64)
    left = np.searchsorted(-n, -np.arange(longest + 1), side="left")  # pairs with more than j characters
    for j in range(longest):
        columns[j, :left[j]] = text[to[:left[j]] + j]
    up, down = np.full((words, pairs), ~np.uint64(0)), np.zeros((words, pairs), np.uint64)
    more, less = np.zeros((words + 1, pairs), np.uint64), np.zeros((words + 1, pairs), np.uint64)  # carried from word to word
    more[0] = ends is None
    last, found = ((m - 1) & 63).astype(np.uint64), m.astype(np.int64)
    for step in range(longest + words - 1):
        low, high = max(0, step - longest + 1), min(words, step + 1)
        on = left[step - high + 1]
        same = equal[place[low:high, :on] + columns[step - high + 1:step - low + 1, :on][::-1]]
        p, d, grown, shrunk = up[low:high, :on], down[low:high, :on], more[low:high, :on].copy(), less[low:high, :on].copy()
        vertical = same | d
        same |= shrunk
        across = same & p
        across += p
        across ^= p
        across |= same
        plus = across | p
        np.invert(plus, out=plus)
        plus |= d
        across &= p  # from here the places where it shrinks
        more[low + 1:high + 1, :on] = plus >> _TOP
        less[low + 1:high + 1, :on] = across >> _TOP
        if high == words:
            done = left[step - words + 1]
            found[:done] += ((plus[-1, :done] >> last[:done]) & _ONE).astype(np.int64)
            found[:done] -= ((across[-1, :done] >> last[:done]) & _ONE).astype(np.int64)
            if ends is not None:
                ends[step - words + 1] = found[0]
        plus <<= _ONE
        plus |= grown
        across <<= _ONE
        across |= shrunk
        np.bitwise_and(plus, vertical, out=d)
        plus |= vertical
        np.invert(plus, out=plus)
        np.bitwise_or(plus, across, out=p)
    return found
