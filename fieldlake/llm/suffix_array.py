"""Suffix arrays of shards by induced sorting, and permuted common prefixes, as NumPy kernels.

The text is an array of byte codes with separators between its strings. All
scans run bucket by bucket, and inside a bucket in waves, one for each place of
a run of equal symbols: a wave induces all its predecessors at once.
"""

from __future__ import annotations

import numpy as np

from . import text as T

#: The separator's symbol; bytes are 1 to 256, so that it sorts first.
SEPARATOR, SYMBOLS = 0, 257


def classify(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(smaller, leftmost): which suffixes are smaller than the next one, and the positions where a run of these begins. The last suffix is larger than the empty one."""
    n = len(s)
    change = np.flatnonzero(s[1:] != s[:-1])  # the last place of each run but the last
    rises = np.zeros(len(change) + 1, dtype=bool)
    rises[:-1] = s[change] < s[change + 1]
    lengths = np.diff(np.concatenate([[-1], change, [n - 1]]))
    smaller = np.repeat(rises, lengths)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    return smaller, leftmost


def _deal(found: np.ndarray, s: np.ndarray, buckets: list[list[np.ndarray]], own: int) -> np.ndarray:
    """Append suffixes to their symbols' buckets in order; those of `own` are returned."""
    symbol = s[found]
    order = np.argsort(symbol, kind="stable")
    found, ends = found[order], np.cumsum(np.bincount(symbol, minlength=SYMBOLS))
    same = found[:0]
    for c in np.flatnonzero(np.diff(ends, prepend=0)):
        part = found[(ends[c - 1] if c else 0) : ends[c]]
        if c == own:
            same = part
        else:
            buckets[c].append(part)
    return same


def induce(s: np.ndarray, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """The order of all suffixes, given the leftmost smaller ones in order (or in any order, for a sort by their substrings)."""
    symbol = s[leftmost]
    by_symbol = leftmost[np.argsort(symbol, kind="stable")]
    ends = np.cumsum(np.bincount(symbol, minlength=SYMBOLS))
    larger: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    larger[s[-1]].append(np.array([len(s) - 1]))
    for c in range(SYMBOLS):  # left to right: larger suffixes from what stands before them
        wave, done = (np.concatenate(larger[c]) if larger[c] else by_symbol[:0]), []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            wave = _deal(before[~smaller[before]], s, larger, c)
        larger[c] = done
        seeds = by_symbol[(ends[c - 1] if c else 0) : ends[c]] - 1
        _deal(seeds, s, larger, -1)
    smallers: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    for c in reversed(range(SYMBOLS)):  # right to left: smaller suffixes, last first
        wave, done = (np.concatenate(smallers[c]) if smallers[c] else by_symbol[:0]), []
        while len(wave):
            done.append(wave)
            before = wave[wave > 0] - 1
            wave = _deal(before[smaller[before]], s, smallers, c)
        smallers[c] = done
        for part in reversed(larger[c]):
            before = part[::-1]
            before = before[before > 0] - 1
            _deal(before[smaller[before]], s, smallers, -1)
    out = []
    for c in range(SYMBOLS):
        out += larger[c] + [part[::-1] for part in reversed(smallers[c])]
    return np.concatenate(out)


def _ranked(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string of names, each level on names of pairs of the level before."""
    n, reach, rank = len(names), 1, names.astype(np.int64)
    while n > 1:
        after = np.zeros(n, dtype=np.int64)
        after[:-reach] = rank[reach:] + 1
        values, rank = np.unique(rank * (n + 2) + after, return_inverse=True)
        if len(values) == n:
            break
        reach *= 2
        if reach >= n:
            break
    return np.argsort(rank, kind="stable")


def suffix_array(s: np.ndarray) -> np.ndarray:
    """The suffixes of s (symbols 0 to 256) in order."""
    if len(s) < 2:
        return np.arange(len(s))
    smaller, leftmost = classify(s)
    if len(leftmost) < 2:
        return induce(s, smaller, leftmost)
    # The leftmost smaller suffixes in the order of their substrings (up to the next such place).
    seen = np.zeros(len(s), dtype=bool)
    seen[leftmost] = True
    rough = induce(s, smaller, leftmost)
    rough = rough[seen[rough]]
    number = np.zeros(len(s), dtype=np.int64)
    number[leftmost] = np.arange(len(leftmost))
    stop = np.append(leftmost[1:] + 1, len(s))
    prints = T.range_hash(T.prefix_hash(s.astype(np.uint64) * T.MULTIPLIERS[0] + T.MULTIPLIERS[1]), leftmost, stop)
    prints = prints[number[rough]]
    names = np.zeros(len(leftmost), dtype=np.int64)
    names[number[rough]] = np.cumsum(np.concatenate([[0], prints[1:] != prints[:-1]]))
    return induce(s, smaller, leftmost[_ranked(names)])


def permuted_prefixes(s: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp): for each place of the text the suffix that sorts before it (or -1), and how long a prefix the two share.

    No prefix crosses a separator. Only places whose preceding symbols differ
    are measured, by hashes; each other place has one less than the place
    before it.
    """
    n = len(s)
    before = np.full(n, -1, dtype=np.int64)
    before[order[1:]] = order[:-1]
    codes = s.astype(np.uint64) * T.MULTIPLIERS[0] + T.MULTIPLIERS[1]
    cuts = np.flatnonzero(s == SEPARATOR)
    codes[cuts] = T.mix(cuts.astype(np.uint64) + T.MULTIPLIERS[2])  # no two separators are equal
    prefix = T.prefix_hash(codes)
    places = np.arange(n)
    left, other = s[np.maximum(places - 1, 0)], s[np.maximum(before - 1, 0)]
    measured = (places == 0) | (before <= 0) | (left != other) | (left == SEPARATOR)
    i = np.flatnonzero(measured & (before >= 0))
    j = before[i]
    end = np.append(cuts, n)
    low, high = np.zeros(len(i), dtype=np.int64), end[np.searchsorted(end, i)] - i
    high = np.minimum(high, end[np.searchsorted(end, j)] - j)
    while len(todo := np.flatnonzero(low < high)):
        middle = (low[todo] + high[todo] + 1) // 2
        a, b = i[todo], j[todo]
        same = T.range_hash(prefix, a, a + middle) == T.range_hash(prefix, b, b + middle)
        low[todo] = np.where(same, middle, low[todo])
        high[todo] = np.where(same, high[todo], middle - 1)
    plcp = np.zeros(n, dtype=np.int64)
    plcp[i] = low
    source = np.maximum.accumulate(np.where(measured, places, 0))
    plcp = np.maximum(0, plcp[source] - (places - source))
    plcp[before < 0] = 0
    return before, plcp


def repeated(s: np.ndarray, length: int) -> np.ndarray:
    """The places where a string of `length` symbols without separators starts that starts elsewhere too."""
    if len(s) < length:
        return np.zeros(len(s), dtype=bool)
    order = suffix_array(s)
    before, plcp = permuted_prefixes(s, order)
    out = plcp >= length
    out[before[out]] = True
    return out
