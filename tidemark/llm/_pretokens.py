"""Pre-tokens and their ids for whole batches of texts at once, on the UTF-8 bytes that Arrow holds.

A byte-level vocabulary splits a text into pre-tokens by a fixed pattern and encodes each on its own, so the ids of a text
are the ids of its pre-tokens, one after the other. Natural text repeats its pre-tokens. Each worker keeps the library's
answers for those that it has met in a table of numpy arrays keyed by two independent 64-bit hashes, looks a whole batch
up at once, and sends only new ones to the library, many at a time. The table is bounded; when it is full it starts again.

That is done only where it provably equals the library's answer: rows of ASCII and of the Latin letters up to U+017F,
where Unicode versions agree on classes, without control characters or the beginning of a special string. All other rows go
to the library whole.
"""

from __future__ import annotations

import os

import numpy as np

from . import _text as T

#: entries a worker keeps before it starts again
MEMO = 500_000
_SLOTS = 1 << 21
_Q = 0xD6E8FEB86659FD93
_QINV = pow(_Q, -1, 1 << 64)
_QPOW: list[np.ndarray] = []

LETTER, NUMBER, SPACE, OTHER, BAD = 0, 1, 2, 3, 4
_CLASS = np.full(256, OTHER, dtype=np.uint8)
_CLASS[65:91] = _CLASS[97:123] = LETTER
_CLASS[48:58] = NUMBER
_CLASS[[9, 10, 13, 32]] = SPACE
_CLASS[:9] = _CLASS[11:13] = _CLASS[14:32] = BAD
_CLASS[127:] = BAD
#: of U+0080 to U+00FF, by code point: as the pattern sees them, and BAD where versions of Unicode or white space could differ
_LATIN = np.full(256, OTHER, dtype=np.uint8)
_LATIN[:0xA1] = BAD
_LATIN[0xAD] = BAD
_LATIN[[0xAA, 0xB5, 0xBA]] = LETTER
_LATIN[0xC0:] = LETTER
_LATIN[[0xD7, 0xF7]] = OTHER
_LATIN[[0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE]] = NUMBER


def classes(buf: np.ndarray) -> np.ndarray:
    """The class of every byte; the bytes of a two-byte character share its class."""
    cls = _CLASS[buf]
    lead = np.flatnonzero((buf >= 0xC2) & (buf <= 0xC5))
    if len(lead):
        nxt = buf[np.minimum(lead + 1, len(buf) - 1)]
        code = ((buf[lead].astype(np.int64) & 0x1F) << 6) | (nxt & 0x3F)
        own = np.where(code < 256, _LATIN[np.minimum(code, 255)], np.where(code == 0x130, BAD, LETTER)).astype(np.uint8)
        cls[lead] = own
        cls[np.minimum(lead + 1, len(buf) - 1)] = own
    return cls


def byte_starts(buf: np.ndarray, cls: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where pre-tokens of ``'s|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^ L N]+|space+(?!solid)|space+`` start; off: row offsets."""
    n = len(buf)
    st = np.empty(n, dtype=bool)
    st[0] = True
    st[1:] = cls[1:] != cls[:-1]
    heads = off[:-1][off[:-1] < off[1:]]
    st[heads] = True
    space = cls == SPACE
    # the last white space of a run that a solid character of the same row follows: a blank joins what follows, another stands alone
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:]
    last[heads[1:] - 1] = False
    st |= last
    joined = np.flatnonzero(last & (buf == 32)) + 1
    st[joined] = False
    # contractions: an apostrophe that starts a pre-token takes the letters it knows
    quote = np.flatnonzero((buf == 39) & st)
    if len(quote):
        end = off[np.searchsorted(off, quote, side="right")]
        at = lambda k: np.where(quote + k < end, buf[np.minimum(quote + k, n - 1)], 0)
        a, b = at(1), at(2)
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for hit, k in ((one, 2), (two & ~one, 3)):
            q = quote[hit]
            st[q + 1] = False
            after = q + k
            after = after[after < end[hit]]
            st[after] = True
    return st


def _hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(buf)
    if not _QPOW or len(_QPOW[0]) <= n:
        m = max(n, T.PIECE) + 1
        with np.errstate(over="ignore"):
            _QPOW[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, T.U64), np.full(m - 1, q, dtype=T.U64)])) for q in (_Q, _QINV)]
    out = []
    wide = buf.astype(T.U64) + T.U64(1)
    for power, inverse in (T._powers(n), _QPOW):
        with np.errstate(over="ignore"):
            acc = np.empty(n + 1, dtype=T.U64)
            acc[0] = 0
            np.cumsum(wide * power[:n], out=acc[1:])
            out.append(T.mix((acc[end] - acc[start]) * inverse[start] + (end - start).astype(T.U64)))
    return out[0], out[1]


class Table:
    """Pre-tokens by hash: place of each one's ids in `pool`."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(_SLOTS, -1, dtype=np.int32)
        self.h, self.g = np.zeros(MEMO * 2, T.U64), np.zeros(MEMO * 2, T.U64)
        self.at, self.n = np.zeros(MEMO * 2, np.int64), np.zeros(MEMO * 2, np.int32)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.size, self.held = 0, 0

    def find(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        """Entry of each pre-token, or -1."""
        out = np.full(len(h), -1, dtype=np.int32)
        slot = (h & T.U64(_SLOTS - 1)).astype(np.int64)
        todo = None
        while True:
            entry = self.slots[slot]
            safe = np.maximum(entry, 0)
            hh, gg = (h, g) if todo is None else (h[todo], g[todo])
            same = (entry >= 0) & (self.h[safe] == hh) & (self.g[safe] == gg)
            if todo is None:
                out[same] = entry[same]
                todo = np.flatnonzero((entry >= 0) & ~same)
            else:
                out[todo[same]] = entry[same]
                keep = (entry >= 0) & ~same
                todo, slot = todo[keep], slot[keep]
                if not len(todo):
                    return out
                slot = (slot + 1) & (_SLOTS - 1)
                continue
            if not len(todo):
                return out
            slot = (slot[todo] + 1) & (_SLOTS - 1)

    def add(self, h: np.ndarray, g: np.ndarray, ids: list[list[int]]) -> None:
        """New pre-tokens, each once."""
        k = len(h)
        n = np.fromiter(map(len, ids), np.int32, k)
        flat = np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum()))
        while self.held + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(len(self.pool), np.uint32)])
        own = slice(self.size, self.size + k)
        self.h[own], self.g[own], self.n[own] = h, g, n
        self.at[own] = self.held + np.cumsum(n) - n
        self.pool[self.held : self.held + len(flat)] = flat
        entry = np.arange(self.size, self.size + k, dtype=np.int32)
        self.size, self.held = self.size + k, self.held + len(flat)
        slot = (h & T.U64(_SLOTS - 1)).astype(np.int64)
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & (_SLOTS - 1)


class ByteEncoder:
    """Ids of texts by a byte-level tokenizer file; `get` keeps one per worker."""

    _kept: dict[str, ByteEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        if self.library.normalizer is not None:
            raise ValueError("only for vocabularies without a normaliser")
        self.specials = sorted({t.content[:2].encode() for t in self.library.get_added_tokens_decoder().values()})
        self.table = Table()

    @classmethod
    def get(cls, path: str) -> ByteEncoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows one after the other, ids of each row) for rows buf[off[i]:off[i + 1]], off from 0."""
        rows = len(off) - 1
        if not len(buf):
            return np.zeros(0, np.uint32), np.zeros(rows, np.int64)
        cls = classes(buf)
        odd = cls == BAD
        for s in self.specials:
            hit = buf == s[0]
            if len(s) > 1:
                hit[:-1] &= buf[1:] == s[1]
            odd |= hit
        odd_rows = np.unique(np.searchsorted(off, np.flatnonzero(odd), side="right") - 1)
        st = byte_starts(buf, cls, off)
        start = np.flatnonzero(st)
        end = np.append(start[1:], len(buf))
        row = np.searchsorted(off, start, side="right") - 1
        if len(odd_rows):
            good = ~np.isin(row, odd_rows)
            start, end, row = start[good], end[good], row[good]
        h, g = _hashes(buf, start, end)
        if self.table.size > MEMO:
            self.table.clear()
        entry = self.table.find(h, g)
        while len(miss := np.flatnonzero(entry < 0)):
            _, first = np.unique(h[miss], return_index=True)
            first = miss[first[:MEMO]]
            if self.table.size + len(first) > 2 * MEMO:
                self.table.clear()
                entry[:] = -1
                continue
            words = [buf[a:b].tobytes().decode() for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            self.table.add(h[first], g[first], [e.ids for e in self.library.encode_batch_fast(words, add_special_tokens=False)])
            entry[miss] = self.table.find(h[miss], g[miss])
        n = self.table.n[entry].astype(np.int64)
        at = self.table.at[entry]
        count = np.bincount(row, weights=n, minlength=rows).astype(np.int64)
        total = np.cumsum(n)
        ids = self.table.pool[np.repeat(at - (total - n), n) + np.arange(int(total[-1]) if len(total) else 0)]
        if len(odd_rows):
            ends = np.cumsum(count)
            parts, done = [], 0
            for r in odd_rows.tolist():
                own = np.array(self.library.encode(buf[off[r] : off[r + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
                parts += [ids[done : ends[r]], own]
                done, count[r] = int(ends[r]), len(own)
            ids = np.concatenate([*parts, ids[done:]])
        return ids, count
