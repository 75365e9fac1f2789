"""Token counts by overlap resynchronisation.

A text of at most CHUNK characters is encoded in one piece. A longer one is encoded in chunks that overlap, each with
the end offsets of its tokens, so that no call ever holds a huge encoding. Two neighbouring chunks are spliced at an
offset inside their overlap where both encodings end a token and the text goes on with ASCII white space: white space
separates pre-tokens whatever stands before or after it, so from there on the right chunk's tokens are those of the whole
text, and up to there the left chunk's are. Where the overlap holds no such offset it is doubled, to both sides, until it
does or the two chunks have become one.

Counts are the library's (see _tokens). One task reads each document once; nothing is shuffled.

Edge cases: null or empty text has 0 bytes and 0 tokens. Rows that repeat come out as often as they come in. A null doc_id is kept.
An empty table gives no rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tokens import Encoder, text_runs

CHUNK = 16_384
OVERLAP = 512
LIMIT = 2048
_SPACE = frozenset(" \t\n\r\f\v")


def stable_ends(text: str, ends: np.ndarray, left: int) -> np.ndarray:
    """Offsets (of the whole text) where a token of this chunk ends and the whole text goes on with white space."""
    inner = np.unique(ends)
    return np.array([left + e for e in inner.tolist() if e < len(text) and text[e] in _SPACE], dtype=np.int64)


def count_tokens(text: str, encoder: Encoder, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a text of any length, chunk by chunk."""
    n = len(text)
    if n <= chunk:
        return int(encoder.count_batch([text])[0])
    total, done, left, right = 0, 0, 0, chunk  # tokens up to the offset `done` are counted; [left, right) is the open chunk
    ends = encoder.ends(text[left:right])
    while right < n:
        width = overlap
        while True:
            to = min(n, right + width if width > overlap else right)
            from_ = max(left, right - width)
            if to > right:
                ends, right = encoder.ends(text[left:to]), to
            if right >= n:
                break
            nxt_right = min(n, from_ + chunk if from_ + chunk > right else right + chunk)
            nxt = encoder.ends(text[from_:nxt_right])
            common = np.intersect1d(stable_ends(text[left:right], ends, left), stable_ends(text[from_:nxt_right], nxt, from_))
            common = common[(common > from_) & (common > done) & (common < right)]
            if len(common):
                # the last common offset but one, where there is one: the chunk's own end is the least sure place
                b = int(common[-2] if len(common) > 1 else common[-1])
                total += int(((ends > done - left) & (ends <= b - left)).sum())
                done, left, right, ends = b, from_, nxt_right, nxt
                break
            if from_ <= left:
                ends, right = encoder.ends(text[left:nxt_right]), nxt_right
                break
            width *= 2
    return total + int((ends > done - left).sum())


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document, by the tokenizer file at `path`."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.get(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            n = np.zeros(len(texts), dtype=np.int64)
            short = [i for i, t in enumerate(texts) if len(t) <= chunk]
            for a, b in text_runs([texts[i] for i in short]):
                n[short[a:b]] = encoder.count_batch([texts[i] for i in short[a:b]])
            for i, t in enumerate(texts):
                if len(t) > chunk:
                    n[i] = count_tokens(t, encoder, chunk, overlap)
            size = np.array([len(t) if t.isascii() else len(t.encode()) for t in texts], dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
