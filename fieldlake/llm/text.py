"""Vectorised text kernels shared by the corpus operators.

Everything here works on one Arrow batch at a time, as flat NumPy arrays over
the batch's UTF-8 bytes: no Python loop runs per word or per byte.

Hashes are 64-bit polynomial hashes read off one prefix sum, so that the hash
of any byte range costs two gathers. Byte values go through a fixed random
table first, and a finaliser scrambles the low bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)
_BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_random = np.random.Generator(np.random.PCG64(20240607))
BYTE_CODES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
MULTIPLIERS = _random.integers(1, 1 << 63, 8, dtype=np.uint64) * U(2) + U(1)

#: Bytes of text handled at once inside a batch; a longer text is a piece of its own.
PIECE_BYTES = 2 << 20

_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        _powers = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, _BASE))])
        _inverses = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, _BASE_INVERSE))])
    return _powers[:n], _inverses[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """p with p[j] - p[i] = the hash of codes[i:j] times base^i."""
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers(len(codes))[0], out=out[1:])
    return out


def range_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """A well mixed hash of each [start, stop); equal contents give equal values anywhere."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[stop] - prefix[start]) * inverse[start] + (stop - start).astype(np.uint64) * MULTIPLIERS[7])


def pieces(texts: pa.Array, most_bytes: int = PIECE_BYTES, most_rows: int = 2048) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive slices of a text column as (first row, row after, bytes, offsets); null is empty.

    offsets has one entry more than the slice has rows and starts at 0.
    """
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if not pa.types.is_large_binary(texts.type):
        texts = texts.cast(pa.large_binary() if pa.types.is_binary(texts.type) else pa.large_string())
    if texts.null_count:
        texts = texts.fill_null(b"" if pa.types.is_large_binary(texts.type) else "")
    n = len(texts)
    if not n:
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, side="right")) - 1
        to = min(max(to, at + 1), at + most_rows, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, stop, first): byte ranges of all words [^\\x20\\x09-\\x0D]+ and each row's first word, one entry more at the end."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(len(data) + 1, dtype=bool)
    first[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | first[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    stop = np.flatnonzero(inside & (~after | first[1:])) + 1
    return start, stop, np.searchsorted(start, offsets)


def shingle_keys(data: np.ndarray, offsets: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Sorted distinct (row << bits | shingle hash) of a slice's texts.

    A row's shingles are its runs of `width` words; a row with fewer words has
    its whole sequence as the one shingle, a row without words none.
    """
    start, stop, first = words(data, offsets)
    if not len(start):
        return np.zeros(0, dtype=np.uint64)
    word = range_hash(prefix_hash(BYTE_CODES[data]), start, stop)
    count = np.diff(first)
    row_of = np.repeat(np.arange(len(count)), count)
    n = len(word)
    full = np.flatnonzero(np.arange(n) + width <= np.repeat(first[1:], count))
    h = np.zeros(len(full), dtype=np.uint64)
    for k in range(width):
        h += word[full + k] * MULTIPLIERS[k % 7] * powers(width)[0][k]
    rows = row_of[full]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        own = np.zeros(len(short), dtype=np.uint64)
        for k in range(width - 1):
            there = count[short] > k
            own[there] += word[first[short][there] + k] * MULTIPLIERS[k % 7] * powers(width)[0][k]
        own += count[short].astype(np.uint64) * MULTIPLIERS[7]
        h, rows = np.concatenate([h, own]), np.concatenate([rows, short])
    keys = (rows.astype(np.uint64) << U(bits)) | (mix(h) >> U(64 - bits))
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType | None = None) -> pa.ListArray:
    """A list column from flat values and each row's number of them."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values) if kind is None else pa.array(values, type=kind))
