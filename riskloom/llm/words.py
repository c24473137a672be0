"""Words and word windows of whole texts, hashed block by block with numpy.

Used inside Arrow tasks. A text is cut into words at byte level: UTF-8 keeps every separator below
0x80, so cutting bytes equals cutting code points. Nothing depends on how rows are batched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 18

_P = np.uint64(0x9E3779B97F4A7C55)
_P_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = 0xD6E8FEB86659FD93
_MASK = (1 << 64) - 1
_SHORT = np.uint64(0xA0761D6478BD642F)


def _separators(kind: str) -> np.ndarray:
    """True for bytes that are no part of a word."""
    table = np.zeros(256, bool)
    if kind == "space":
        table[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":
        for low, high in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
            table[low : high + 1] = True
    else:
        raise ValueError(kind)
    return table


def _cases(lower: bool) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    if lower:
        table[ord("A") : ord("Z") + 1] += 32
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _power(k: int) -> np.uint64:
    return np.uint64(pow(_Q, k, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse, as long as the longest block so far."""

    def __init__(self) -> None:
        self.size = 0
        # a worker's first block may hold no word at all
        self.up = self.down = np.zeros(0, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.size:
            self.size = max(n, 1 << 16)
            for name, base in (("up", _P), ("down", _P_INVERSE)):
                steps = np.full(self.size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


@dataclass
class Block:
    """Texts `first` .. `first + len(bounds) - 2` of a column; words of text i are bounds[i]:bounds[i+1]."""

    first: int
    data: np.ndarray
    begins: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray
    text_begins: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def word(self, i: int) -> bytes:
        return self.data[self.begins[i] : self.ends[i]].tobytes()

    def words(self, low: int, high: int) -> list[bytes]:
        """Words low .. high - 1 of a block cut at white space, all of one text."""
        return self.data[self.begins[low] : self.ends[high - 1]].tobytes().split()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash of the `size` words from each word on, True where they lie inside one text)."""
        n = len(self.hashes)
        whole = max(0, n - size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(size if whole else 0):
            out[:whole] += self.hashes[k : k + whole] * _power(k)
        inside = np.zeros(n, bool)
        counts = np.diff(self.bounds)
        last = np.repeat(self.bounds[1:], counts)
        inside[:] = np.arange(n) + size <= last
        return mix(out), inside

    def whole(self, i: int) -> np.uint64:
        """Hash of all words of text i as one short window (never equal to a full one by design)."""
        words = self.hashes[self.bounds[i] : self.bounds[i + 1]]
        value = int(_SHORT) + len(words)
        for k, w in enumerate(words):
            value += int(w) * int(_power(k))
        return mix(np.array([value & _MASK], np.uint64))[0]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(byte offsets, bytes) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return offsets.astype(np.int64), np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def blocks(column: pa.Array, kind: str, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cuts a string column into blocks of about `block_bytes` (a longer text is one block)."""
    if not len(column):
        return
    offsets, data = text_buffers(column)
    separators, cases = _separators(kind), _cases(lower)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block_bytes, "right")) - 1)
        to = min(to, len(column))
        yield _block(at, cases[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at], separators)
        at = to


def _block(first: int, data: np.ndarray, offsets: np.ndarray, separators: np.ndarray) -> Block:
    word = ~separators[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = word[:-1]
    text_starts = offsets[:-1][offsets[:-1] < n]
    before[text_starts] = False
    begins = np.flatnonzero(word & ~before)
    after = np.zeros(n, bool)
    after[:-1] = word[1:]
    cuts = offsets[1:-1]
    after[cuts[(cuts > 0)] - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    up, down = _POWERS.upto(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    hashes = mix((sums[ends] - sums[begins]) * down[begins]) if len(begins) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(begins, offsets)
    return Block(first, data, begins, ends, bounds, hashes, offsets)
