"""Vectorised work on whole texts, as the UTF-8 bytes that Arrow holds.

Words are maximal runs of bytes of a class. Both word classes used here take every byte from 0x80 up as part of a word,
so no multi-byte character is ever split, and byte runs are the code-point runs of the patterns they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: bytes handled at a time; bounds the memory of the arrays of 8 bytes a byte below
PIECE = 512 << 10
_P = 0x9E3779B97F4A7C15 | 1
_INV = pow(_P, -1, 1 << 64)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, letters a-z, everything that is not ASCII
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: [^\x20\x09-\x0D]+
SOLID = np.ones(256, dtype=bool)
SOLID[9:14] = SOLID[32] = False

_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n + 1:
        m = max(n + 1, PIECE + 1)
        with np.errstate(over="ignore"):
            out = []
            for base in (_P, _INV):
                a = np.full(m, base, dtype=U64)
                a[0] = 1
                out.append(np.multiply.accumulate(a))
        _POW[:] = out
    return _POW[0], _POW[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> U64(33))
        h = h * U64(0xFF51AFD7ED558CCD)
        h = h ^ (h >> U64(33))
        h = h * U64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> U64(33))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is the empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_string(col.type) or pa.types.is_large_string(col.type)):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, off, data = col.buffers()
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, dtype=kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return buf, off - off[0]


def row_groups(off: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of at most `most` bytes together; a longer row stands alone."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of rows: `count` per row, `first` index per row (n + 1), and per word its `hash`, `start` and `end` byte from the row's start."""

    def __init__(self, buf: np.ndarray, off: np.ndarray, kind: np.ndarray, hashes: bool = True):
        off = off - off[0]
        n = len(off) - 1
        parts = []
        for a, b in self._pieces(buf, kind):
            low = _LOWER[buf[a:b]]
            w = kind[low]
            head = np.zeros(b - a, dtype=bool)
            inside = off[(off >= a) & (off < b)] - a
            head[inside] = True
            head[0] = True
            prev = np.empty_like(w)
            prev[0] = False
            prev[1:] = w[:-1]
            start = np.flatnonzero(w & (head | ~prev))
            nxt = np.empty_like(w)
            nxt[-1] = True
            nxt[:-1] = ~w[1:] | head[1:]
            end = np.flatnonzero(w & nxt) + 1
            h = None
            if hashes:
                p, inv = _powers(b - a)
                with np.errstate(over="ignore"):
                    acc = np.empty(b - a + 1, dtype=U64)
                    acc[0] = 0
                    np.cumsum((low.astype(U64) + U64(1)) * p[: b - a], out=acc[1:])
                    h = mix((acc[end] - acc[start]) * inv[start])
            parts.append((start + a, end + a, h))
        if not parts:
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64))]
        start = np.concatenate([x[0] for x in parts])
        self.abs_start, self.abs_end = start, np.concatenate([x[1] for x in parts])
        self.hash = np.concatenate([x[2] for x in parts]) if hashes else None
        self.first = np.searchsorted(start, off)
        self.count = np.diff(self.first)
        self.off, self.n = off, n

    @staticmethod
    def _pieces(buf: np.ndarray, kind: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pieces of about PIECE bytes that end where no word is cut; one endless word makes a longer piece."""
        a, n = 0, len(buf)
        while a < n:
            b = min(n, a + PIECE)
            while b < n:
                tail = np.flatnonzero(~kind[_LOWER[buf[b : b + 65536]]])
                if len(tail):
                    b += int(tail[0])
                    break
                b = min(n, b + 65536)
            yield a, b
            a = b

    def row(self, i: int) -> np.ndarray:
        return self.hash[self.first[i] : self.first[i + 1]]


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive words, in order."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    with np.errstate(over="ignore"):
        g = np.full(n, k, dtype=U64)
        for j in range(k):
            g = g * U64(_P) + words[j : j + n]
        return mix(g)
