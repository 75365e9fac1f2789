"""Token-id files: frequency-ranked ids in a byte-aligned code with separate control bytes.

Format. A file set is a Parquet folder; a row is one block of at most about BLOCK ids (a longer document makes a longer
block) and can be read alone:

* part, block: the block's place in the order of documents
* doc_ids, lengths: the documents of the block and how many ids each has
* ranked: the ids that occur in the block, most frequent first (unsigned 32-bit, little-endian)
* control: two bits an id, four ids a byte, lowest bits first: bytes of the id's rank less one
* data: the ranks, 1 to 4 bytes each, little-endian, one after the other

Frequent ids have ranks below 256 and take one byte. Decoding reads the lengths of four ids at a time from a table of
256 rows, sums them to offsets and gathers the bytes with numpy; `ranked` turns ranks back into ids.

Documents are range-partitioned by id before they are encoded, so one shuffle of the texts gives files in order, and a
block is counted, ranked and written by the task that encoded it. Spark's committer makes the writing safe against lost tasks.

Edge cases: a null or empty text has only the end id. Rows that repeat a doc_id are all kept, next to each other, ordered by
the hash of their text. A null doc_id sorts first. An empty table makes an empty file set. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _text as T
from ._pretokens import ByteEncoder
from ._spark import fresh_path

BLOCK = 1 << 21
END = 0
_FORMAT = "part int, block int, doc_ids array<long>, lengths array<int>, ranked binary, control binary, data binary"
#: bytes of each of the four ids of a control byte
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], dtype=np.uint8)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of a run of ids."""
    ids = ids.astype(np.uint32, copy=False)
    seen, back, times = np.unique(ids, return_inverse=True, return_counts=True) if int(ids.max(initial=0)) >= 1 << 20 else _small_unique(ids)
    order = np.lexsort((seen, -times))
    rank_of = np.empty(len(seen), dtype=np.uint32)
    rank_of[order] = np.arange(len(seen), dtype=np.uint32)
    ranks = rank_of[back]
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(ids) // 4) * 4, dtype=np.uint8)
    padded[: len(ids)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    data = np.zeros(int(end[-1]) if len(end) else 0, dtype=np.uint8)
    for k in range(4):
        m = slice(None) if k == 0 else size > k
        data[at[m] + k] = ranks[m] >> np.uint32(8 * k)
    return seen[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def _small_unique(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    times = np.bincount(ids)
    seen = np.flatnonzero(times)
    place = np.zeros(len(times), dtype=np.int64)
    place[seen] = np.arange(len(seen))
    return seen.astype(np.uint32), place[ids], times[seen]


def unpack(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The n ids of a block, by table lookup."""
    size = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    end = np.cumsum(size, dtype=np.int64)
    at = end - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        m = np.flatnonzero(size > k)
        ranks[m] |= raw[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


def write_token_files(docs: DataFrame, path: str, out: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, end: int = END) -> None:
    """Encode every text with the tokenizer file at `path`, append `end`, and write the file set `out` in ascending id order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        encoder = ByteEncoder.get(path)
        names: list[pa.Array] = []
        lengths: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        held = 0

        def closed() -> pa.RecordBatch:
            ranked, control, data = pack(np.concatenate(parts))
            docs_ = pa.concat_arrays(names)
            n = np.concatenate(lengths)
            one = np.array([0, len(n)], np.int32)
            arrays = [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.ListArray.from_arrays(one, docs_), pa.ListArray.from_arrays(one, pa.array(n.astype(np.int32))),
                      pa.array([ranked], pa.binary()), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, names=["part", "block", "doc_ids", "lengths", "ranked", "control", "data"])

        for batch in batches:
            buf, off = T.raw(batch.column(1))
            for a, b in T.row_groups(off):
                ids, n = encoder.encode(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                names.append(batch.column(0).slice(a, b - a))
                lengths.append(n + 1)
                parts.append(np.insert(ids, np.cumsum(n), end))
                held += len(parts[-1])
                if held >= block:
                    yield closed()
                    number, held = number + 1, 0
                    names, lengths, parts = [], [], []
        if names:
            yield closed()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie, "text")
    ordered.mapInArrow(encode, _FORMAT).write.parquet(out)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a file set: part, block, place, doc_id, offset (ids of its block before it), n_tokens, ids array<int>."""
    return _decoded(spark, path, True)


def _decoded(spark: SparkSession, path: str, with_ids: bool) -> DataFrame:
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = np.array(row["lengths"], dtype=np.int64)
                ids = unpack(int(n.sum()), row["ranked"], row["control"], row["data"]).astype("<u4", copy=False)
                at = np.concatenate([[0], np.cumsum(n)])
                k = len(n)
                own = [ids[at[i] : at[i + 1]] for i in range(k)]
                last = pa.array([x.view("<i4") for x in own], pa.list_(pa.int32())) if with_ids else pa.array([zlib.crc32(x.tobytes()) for x in own], pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(k, row["part"], np.int32)), pa.array(np.full(k, row["block"], np.int32)), pa.array(np.arange(k, dtype=np.int32)),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(at[:-1]), pa.array(n), last,
                ], names=["part", "block", "place", "doc_id", "offset", "n_tokens", "ids" if with_ids else "ids_crc32"])

    tail = "ids array<int>" if with_ids else "ids_crc32 long"
    return spark.read.schema(_FORMAT).parquet(path).mapInArrow(decode, f"part int, block int, place int, doc_id long, offset long, n_tokens long, {tail}")


def token_digest(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the file set of a table, read it back, and return doc_id, start, n_tokens, ids_crc32 of every document."""
    spark = docs.sparkSession
    out = fresh_path(spark, "token-ids")
    write_token_files(docs, path, out, id_col, text_col)
    # ids before each block: a sum over the parts (as many as there were tasks), then over the blocks of a part
    sizes = spark.read.schema(_FORMAT).parquet(out).select("part", "block", F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x).alias("size"))
    parts = sizes.groupBy("part").agg(F.sum("size").alias("size")).select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("part_start"))
    blocks = sizes.select("part", "block", (F.sum("size").over(Window.partitionBy("part").orderBy("block")) - F.col("size")).alias("block_start")).join(parts, "part")
    return _decoded(spark, out, False).join(blocks, ["part", "block"]).select(
        "doc_id", (F.col("part_start") + F.col("block_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
