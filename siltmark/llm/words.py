"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text is worked on alone.
BLOCK = 1 << 20

_LIBC = ctypes.CDLL(None) if sys.platform.startswith("linux") else None
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing; all bytes of characters over 0x7F belong to it.
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True


@lru_cache(maxsize=4)
def _powers(n: int, base: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    filled, step = 1, base
    while filled < n:
        more = min(filled, n - filled)
        out[filled : filled + more] = out[:more] * np.uint64(step)
        filled += more
        step = step * step % (1 << 64)
    return out


def release() -> None:
    """Gives freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None and hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidy(run):
    """run, a generator over batches, after which freed memory goes back: Python workers live on and would keep it."""

    @wraps(run)
    def inner(*args):
        try:
            yield from run(*args)
        finally:
            release()

    return inner


def _room(n: int) -> int:
    return max(BLOCK * 2, 1 << (n - 1).bit_length())


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit hashes over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


@dataclass
class Words:
    """A block of texts: first row, bytes, lower-cased bytes, where texts begin and end, and its words in order."""

    row: int
    raw: np.ndarray
    data: np.ndarray
    text_at: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    #: position in start of each text's first word, and one more
    first: np.ndarray

    def word(self, k: int) -> bytes:
        return self.data[self.start[k] : self.end[k]].tobytes()

    def text_of(self) -> np.ndarray:
        """The text of each word, counted in the block."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def block_ends(at: np.ndarray, block: int = BLOCK) -> Iterator[tuple[int, int]]:
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + block, "right")) - 1)
        yield a, b
        a = b


def words_of(column: pa.Array, block: int = BLOCK) -> Iterator[Words]:
    data, at = buffers(column)
    for a, b in block_ends(at, block):
        yield _words(data[at[a] : at[b]], at[a : b + 1] - at[a], a)


def _words(raw: np.ndarray, at: np.ndarray, row: int) -> Words:
    n = len(raw)
    low = LOWER[raw]
    inside = IS_WORD[low]
    joins = np.zeros(n + 1, bool)
    if n:
        joins[1:n] = inside[1:] & inside[:-1]
        joins[at] = False
    start = np.flatnonzero(inside & ~joins[:n])
    end = np.flatnonzero(inside & ~joins[1:]) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(_room(n), _BASE)[:n], out=sums[1:])
    h = mixed((sums[end] - sums[start]) * _powers(_room(n), _INVERSE)[start])
    return Words(row, raw, low, at, start, end, h, np.searchsorted(start, at))


def shingle_hashes(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words, and the text of each. A text of fewer words, but some, is one shingle."""
    h, first = words.hash, words.first
    count = np.diff(first)
    width = np.minimum(count, n)
    out = np.zeros(len(h), np.uint64)
    for k in range(n):
        part = np.zeros(len(h), np.uint64)
        part[: len(h) - k] = h[k:] if k else h
        used = np.repeat(width > k, count)
        out = np.where(used, out * np.uint64(0x100000001B3) + part, out)
    out = mixed(out)
    made = np.maximum(count - n + 1, np.minimum(count, 1))
    place = np.arange(len(h)) - np.repeat(first[:-1], count)
    keep = place < np.repeat(made, count)
    return out[keep], np.repeat(np.arange(len(count)), made)
