"""Token ids of whole texts by a public byte-level BPE, at array speed.

A byte-level BPE splits a text by a fixed pattern first and merges inside each
piece only, so a piece's ids never depend on its neighbours. Here the split is
done on class arrays (letter, number, space, other), each distinct piece goes
through the tokenizer once, and all others are looked up by hash.
"""

from __future__ import annotations

import sys
import unicodedata

import numpy as np
import pyarrow as pa

from . import text as T

#: Distinct pieces that a worker remembers; beyond that it starts afresh with the next slice (same ids, more work).
MOST_PIECES = 1 << 20

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
_CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")
_classes: np.ndarray | None = None
_codes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point, as the pattern's \\s, \\p{L} and \\p{N} see it."""
    global _classes
    if _classes is None:
        out = np.full(sys.maxunicode + 1, _OTHER, dtype=np.uint8)
        for c in range(sys.maxunicode + 1):
            kind = unicodedata.category(chr(c))[0]
            if kind == "L":
                out[c] = _LETTER
            elif kind == "N":
                out[c] = _NUMBER
        out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
        _classes = out
    return _classes


def split(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pieces 's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+ in rows of code points."""
    n = len(points)
    kind = classes()[points]
    head = np.zeros(n + 1, dtype=bool)
    head[offsets] = True
    head = head[:n]
    run = head.copy()
    run[1:] |= kind[1:] != kind[:-1]
    last = np.ones(n, dtype=bool)  # a row's last code point
    last[:-1] = head[1:]

    # The space right before a run of another class is that run's; any other white space there is a piece of its own.
    before = np.zeros(n, dtype=bool)
    before[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE)
    before &= ~last
    start = run | before
    joined = np.flatnonzero(before & (points == 32)) + 1
    start[joined] = False

    # Contractions start at an apostrophe that starts a piece and stands alone before letters.
    quote = np.flatnonzero((points == 39) & start & ~last)
    quote = quote[kind[np.minimum(quote + 1, n - 1)] == _LETTER] if n else quote
    row_end = offsets[np.searchsorted(offsets, quote, side="right")] if len(quote) else quote
    done = np.zeros(len(quote), dtype=bool)
    for tail in _CONTRACTIONS:
        hit = ~done & (quote + len(tail) < row_end)
        for k, c in enumerate(tail):
            hit &= points[np.minimum(quote + 1 + k, n - 1)] == ord(c)
        at = quote[hit]
        start[at + 1] = False
        after = at + 1 + len(tail)
        after = after[(after < row_end[hit])]
        start[after] = True
        # A space that the contraction's letters would have taken stays as it is: only letters follow here.
        done |= hit
    return np.flatnonzero(start)


def point_codes() -> np.ndarray:
    """A fixed odd number for each code point, to hash with."""
    global _codes
    if _codes is None:
        _codes = T.mix(np.arange(sys.maxunicode + 1, dtype=np.uint64) + T.MULTIPLIERS[0]) | T.U(1)
    return _codes


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabulary files: itself where printable, else the next free code point from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = {chr(b): b for b in printable}, 256
    for b in range(256):
        if b not in printable:
            out[chr(free)] = b
            free += 1
    return out


def merger(path: str):
    """A function from pieces to their ids, for a vocabulary file of the tokenizers library.

    Where each merge's result is numbered in the order of the merges, merging
    by rank gives the same ids, and the faster of the two installed
    libraries does it with this file's vocabulary. Else the file's own library
    does it.
    """
    import json

    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    merged = [model["vocab"][a + b] for a, b in pairs]
    if merged == sorted(merged) and min(merged, default=256) >= 256:
        alphabet = _byte_alphabet()
        special = {x for x in model["vocab"] if any(c not in alphabet for c in x)} | {x for x, i in model["vocab"].items() if i >= 256 + len(merged)}
        ranks = {bytes(alphabet[c] for c in x): i for x, i in model["vocab"].items() if x not in special}
        encode = tiktoken.Encoding("file", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda pieces: [encode(x) for x in pieces]
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
    return lambda pieces: [x.ids for x in tokenizer.encode_batch(pieces, add_special_tokens=False)]


class Encoder:
    """ids of whole texts; keeps what it has learnt about distinct pieces."""

    #: Slots at first; there are always four for each piece at least.
    SLOTS = 1 << 18

    def __init__(self, path: str):
        self.encode_pieces = merger(path)
        self.clear()

    def clear(self) -> None:
        self.slots, self.number = np.zeros(self.SLOTS, dtype=np.uint64), np.zeros(self.SLOTS, dtype=np.int32)
        self.first, self.count, self.ids, self.used, self.known = np.zeros(self.SLOTS // 4, dtype=np.int64), np.zeros(self.SLOTS // 4, dtype=np.int32), np.zeros(self.SLOTS, dtype=np.uint16), 0, 0

    def _grow(self, known: int) -> None:
        """Room for so many pieces."""
        held = np.flatnonzero(self.slots)
        keys, number = self.slots[held], self.number[held]
        size = 1 << (4 * known - 1).bit_length()
        self.slots, self.number = np.zeros(size, dtype=np.uint64), np.zeros(size, dtype=np.int32)
        self.first, self.count = (np.concatenate([x, np.zeros(size // 4 - len(x), dtype=x.dtype)]) for x in (self.first, self.count))
        self._place(keys, number)

    def _place(self, keys: np.ndarray, number: np.ndarray) -> None:
        """Enter distinct, unknown keys."""
        last = len(self.slots) - 1
        slot, todo = (keys & T.U(last)).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.slots[slot[todo]] == 0]
            self.slots[slot[free]] = keys[free]  # of several that want a slot, one gets it
            placed = self.slots[slot[todo]] == keys[todo]
            self.number[slot[todo[placed]]] = number[todo[placed]]
            todo = todo[~placed]
            slot[todo] = (slot[todo] + 1) & last

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, or -1."""
        out = np.full(len(keys), -1, dtype=np.int64)
        last = len(self.slots) - 1
        slot = (keys & T.U(last)).astype(np.int64)
        held = self.slots[slot]
        hit = held == keys
        out[hit] = self.number[slot[hit]]
        more = np.flatnonzero(~hit & (held != 0))
        while len(more):
            slot[more] = (slot[more] + 1) & last
            held = self.slots[slot[more]]
            hit = held == keys[more]
            out[more[hit]] = self.number[slot[more[hit]]]
            more = more[~hit & (held != 0)]
        return out

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Add distinct, unknown keys."""
        ids = self.encode_pieces(pieces)
        count = np.fromiter(map(len, ids), dtype=np.int32, count=len(ids))
        flat = np.fromiter((i for x in ids for i in x), dtype=np.uint16, count=int(count.sum()))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        if 4 * (self.known + len(keys)) > len(self.slots):
            self._grow(self.known + len(keys))
        number = np.arange(self.known, self.known + len(keys))
        self.ids[self.used : self.used + len(flat)] = flat
        self.count[number], self.first[number] = count, self.used + np.cumsum(count) - count
        self.used, self.known = self.used + len(flat), self.known + len(keys)
        self._place(keys, number)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, id offsets) of a slice of UTF-8 texts."""
        whole = data.tobytes().decode("utf-8")
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        start = split(points, heads)
        stop = np.append(start[1:], len(points))
        keys = T.range_hash(T.prefix_hash(point_codes()[points]), start, stop) | T.U(1)
        number = self._find(keys)
        if len(unknown := np.flatnonzero(number < 0)):
            fresh, one = np.unique(keys[unknown], return_index=True)
            if self.known + len(fresh) > MOST_PIECES:
                self.clear()
                fresh, one = np.unique(keys, return_index=True)
                unknown = np.arange(len(keys))
            at = unknown[one]
            self._learn(fresh, [whole[i:j] for i, j in zip(start[at].tolist(), stop[at].tolist())])
            number[unknown] = self._find(keys[unknown])
        count = self.count[number].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.ids[np.repeat(self.first[number] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        piece_of = np.searchsorted(start, heads)
        return ids, np.concatenate([[0], ends])[piece_of]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def token_arrays(texts: pa.Array, path: str):
    """Slices of a text column as (first row, row after, ids, id offsets)."""
    for at, to, data, offsets in T.pieces(texts, 1 << 20):
        yield at, to, *encoder(path).encode(data, offsets)
