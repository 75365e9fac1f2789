"""Encoding with public tokenizer files, pre-token by pre-token.

Both byte-pair vocabularies used here split a text into pre-tokens by a fixed pattern and encode each on its own, so the
ids of a text are the ids of its pre-tokens one after the other. Natural text repeats its pre-tokens, so each worker
keeps the library's answer for those it has met (a bounded memo) and asks the library only for new ones, many at a time.

That shortcut is taken only where it provably equals the library's answer: texts of ASCII and of the Latin letters up to
U+017F, where Unicode versions agree on classes and no normalisation joins characters, without any special string. All
other texts go to the library whole.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

import numpy as np

#: entries a worker keeps before it starts again
MEMO = 600_000

_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\u012f\\u0131-\\u017f]*")


# The pre-token patterns of the two vocabularies, with their letter and number classes as they are up to U+017F.
# A letter never starts a contraction, so the commonest branch stands first.
_L, _N = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
_WORD = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\s{_L}{_N}]+")
_BYTE = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+")


class Encoder:
    """One tokenizer file; use `Encoder.get` in tasks, so that a worker loads a file once."""

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        normal = self.library.normalizer
        self.lower = normal is not None
        self.pattern = _WORD if self.lower else _BYTE
        self.memo: dict[str, bytes] = {}
        self.counts: dict[str, int] = {}

    @classmethod
    def get(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def words(self, text: str) -> list[str]:
        return self.pattern.findall(text.lower() if self.lower else text)

    def _new(self, lists: Iterable[list[str]], known: dict) -> list[str]:
        if len(known) > MEMO:
            known.clear()
        return list(set().union(*lists).difference(known))

    def count_batch(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        plain = [self.plain(t) for t in texts]
        lists = [self.words(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        new = self._new(lists, self.counts)
        self.counts.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        get = self.counts.__getitem__
        return [sum(map(get, w)) if p else len(self.library.encode(t, add_special_tokens=False)) for t, w, p in zip(texts, lists, plain, strict=True)]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, unsigned 32-bit."""
        plain = [self.plain(t) for t in texts]
        lists = [self.words(t) if p else [] for t, p in zip(texts, plain, strict=True)]
        new = self._new(lists, self.memo)
        for w, e in zip(new, self.library.encode_batch_fast(new, add_special_tokens=False), strict=True):
            self.memo[w] = np.array(e.ids, dtype="<u4").tobytes()
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, w)), "<u4") if p else np.array(self.library.encode(t, add_special_tokens=False).ids, "<u4") for t, w, p in zip(texts, lists, plain, strict=True)]

    def ends(self, text: str) -> np.ndarray:
        """End offset (code points) of every token of the text, in order; a pre-token's tokens all end with it."""
        if not self.plain(text):
            return np.array([e for _, e in self.library.encode(text, add_special_tokens=False).offsets], dtype=np.int64)
        low = text.lower() if self.lower else text
        spans = [(m.group(), m.end()) for m in self.pattern.finditer(low)]
        words = [w for w, _ in spans]
        new = self._new([words], self.counts)
        self.counts.update(zip(new, map(len, self.library.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return np.repeat(np.array([e for _, e in spans], dtype=np.int64), np.array([self.counts[w] for w in words], dtype=np.int64)) if spans else np.zeros(0, np.int64)


def text_runs(texts: list[str | None], most: int = 1 << 20) -> Iterable[tuple[int, int]]:
    """Runs of rows of about `most` characters together."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if size and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
