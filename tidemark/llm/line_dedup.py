"""Line dedup: a range partition of line hashes, streamed in order, gives each document a bitmap of the lines it keeps.

A line's key is the line without white space at its ends, A-Z in lower case; a blank line has none. Every line becomes a narrow row
of two 64-bit hashes of its key, its document and its place; texts are not shuffled for this. The rows are partitioned by
ranges of all of these columns and sorted by them, so a line that a third of all documents hold is spread over
many ranges. A task streams its range: it counts the documents of each run of equal keys as they pass, holds back the rows of a
run of fewer than `least` documents, and from the document that makes it `least` lets all pass. A run that touches the edge of a
range may go on in the next: its rows up to there are marked as pending, and two rows tell how many documents it had
and which were the first and the last. These (at most four a task) are added up on the driver.

What is left of a document's rows is a bitmap: one bit a line, 1 for a line that stays, packed (first line in the highest bit) and
deflated. Texts meet their bitmaps in one join on document and text hash.

keep="none" drops all lines of a key that stands in at least `least` documents; keep="first" keeps the first of them, by
document and place.

Edge cases: a null or empty text is one empty line, which has no key and stays. Rows of one doc_id count as one document; rows without
one are told apart by their text. A document whose lines all go keeps the empty text. A document of any length is
one row; repeated lines in it are rows of their own. Rows that are equal in id and text have one bitmap. An empty table gives an empty
one. Further columns stay as they are, whatever their names.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ._spark import cut, unused

LEAST = 10
_SPACE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: what a row of the stream says: a line goes; it goes if its key is frequent in all ranges; the same for the first row of a run in its range; the first document of a run and how many it has; its last document
GOES, PENDING, FIRST, RUN, END = range(5)
_ROW = "h1 long, h2 long, no_id boolean, id long, text_hash long, place long"


def _who(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [F.col(id_col).isNull().alias("no_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")]


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each line that has a key: its two hashes, document and place (from 0)."""
    lines = docs.select(*_who(docs, id_col, text_col)).select("no_id", "id", "text_hash", F.posexplode(F.split("text", "\n", -1)).alias("place", "line"))
    bare = F.btrim("line", F.lit(_SPACE))
    # lower() would change letters beyond ASCII too, but on ASCII it is the same, and faster
    ascii_ = F.octet_length("bare") == F.char_length("bare")
    keyed = lines.withColumn("bare", bare).where("bare <> ''").withColumn("key", F.when(ascii_, F.lower("bare")).otherwise(F.translate("bare", _UPPER, _LOWER)))
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(12), "key").alias("h2"), "no_id", "id", "text_hash", F.col("place").cast("long").alias("place"))


class _Run:
    """The open run of a range: its rows are held until it has `least` documents."""

    def __init__(self, key: tuple[int, int], least: int, first: bool, keep_first: bool):
        self.key, self.least, self.edge, self.keep_first = key, least, first, keep_first
        self.docs, self.start, self.last, self.held = 0, None, None, []

    def add(self, rows: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
        no_id, id_, text, _ = rows
        fresh = np.ones(len(id_), bool)
        fresh[1:] = (no_id[1:] != no_id[:-1]) | (id_[1:] != id_[:-1]) | no_id[1:] & (text[1:] != text[:-1])
        here = self.name(rows, 0)
        fresh[0] = here != self.last
        if self.start is None:
            self.start = here
            if self.keep_first:  # decided when it is known whether the run began in an earlier range
                self.held.append((FIRST, [x[:1] for x in rows]))
                rows = [x[1:] for x in rows]
        self.docs += int(fresh.sum())
        self.last = self.name([no_id, id_, text], len(id_) - 1)
        if len(rows[0]):
            self.held.append((GOES, rows))
        if self.docs >= self.least:
            yield from ((k, x) for k, x in self.held if k == GOES)
            self.held = [x for x in self.held if x[0] == FIRST]

    @staticmethod
    def name(rows: list[np.ndarray], i: int) -> tuple[bool, int]:
        return bool(rows[0][i]), int(rows[2 if rows[0][i] else 1][i])

    def end(self, last: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
        if not (self.edge or last):
            return  # all of the run was in this range
        for kind, x in self.held:
            yield (PENDING if kind == GOES else kind), x
        for kind, (no_id, name), n in ((RUN, self.start, self.docs), (END, self.last, 0)):
            yield kind, [np.array([no_id]), np.array([0 if no_id else name]), np.array([name if no_id else 0]), np.array([n])]


def _stream(least: int, keep_first: bool):
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run: _Run | None = None

        def told(key: tuple[int, int], rows: Iterator[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            for kind, x in rows:
                n = len(x[0])
                yield _batch([np.full(n, kind, np.int8), np.full(n, key[0], np.int64), np.full(n, key[1], np.int64), *x])

        def goes_on(a: int, b: int, h1: np.ndarray, h2: np.ndarray, rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            nonlocal run
            key = int(h1[a]), int(h2[a])
            if run is None or run.key != key:
                if run is not None:
                    yield from told(run.key, run.end(False))
                run = _Run(key, least, run is None, keep_first)
            yield from told(key, run.add([x[a:b] for x in rows]))

        for batch in batches:
            h1, h2, *rows = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(h1):
                continue
            at = np.concatenate([[0], np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1, [len(h1)]])
            yield from goes_on(at[0], at[1], h1, h2, rows)  # may have begun before this batch
            if len(at) > 3:
                yield from _inside(h1, h2, rows, at[1:-1], least, keep_first)
            if len(at) > 2:
                yield from goes_on(at[-2], at[-1], h1, h2, rows)  # may go on after it
        if run is not None:
            yield from told(run.key, run.end(True))

    return stream


def _inside(h1: np.ndarray, h2: np.ndarray, rows: list[np.ndarray], starts: np.ndarray, least: int, keep_first: bool) -> Iterator[pa.RecordBatch]:
    """Lines to drop of the runs from starts[0] to before starts[-1], which are whole in this batch."""
    a, b = starts[0], starts[-1]
    no_id, id_, text, _ = rows
    fresh = np.ones(b - a, bool)
    fresh[1:] = (no_id[a + 1 : b] != no_id[a : b - 1]) | (id_[a + 1 : b] != id_[a : b - 1]) | no_id[a + 1 : b] & (text[a + 1 : b] != text[a : b - 1])
    at = starts[:-1] - a
    fresh[at] = True
    goes = np.repeat(np.add.reduceat(fresh.astype(np.int64), at) >= least, np.diff(starts))
    if keep_first:
        goes[at] = False
    which = np.flatnonzero(goes) + a
    if len(which):
        yield _batch([np.full(len(which), GOES, np.int8), h1[which], h2[which], *(x[which] for x in rows)])


def _batch(columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["kind", *(x.split()[0] for x in _ROW.split(", "))])


def _joined_runs(edges: list, least: int) -> tuple[list, list]:
    """Of the runs at edges: the keys that enough documents of all ranges hold, and the first rows of ranges that only go on with such a run."""
    order = lambda r: (r["h1"], r["h2"], r["no_id"], r["id"], r["text_hash"])
    starts, ends = (sorted((r for r in edges if r["kind"] == k), key=order) for k in (RUN, END))
    docs: dict[tuple[int, int], int] = {}
    last = None
    for a, b in zip(starts, ends, strict=True):
        docs[order(a)[:2]] = docs.get(order(a)[:2], 0) + a["place"] - (last == order(a))  # a document that both ranges hold counts once
        last = order(b)
    firsts = sorted((*order(r), r["place"]) for r in edges if r["kind"] == FIRST)
    later = [b[2:] for a, b in itertools.pairwise(firsts) if a[:2] == b[:2] and docs[b[:2]] >= least]
    return [k for k, n in docs.items() if n >= least], later


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep: str = "none") -> DataFrame:
    """no_id, id, text_hash, place of every line that goes."""
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    by = ["h1", "h2", "no_id", "id", "text_hash", "place"]
    ranges = line_rows(docs, id_col, text_col).repartitionByRange(*by).sortWithinPartitions(*by)
    found = cut(ranges.mapInArrow(_stream(least, keep == "first"), f"kind byte, {_ROW}"))
    frequent, later = _joined_runs(found.where(F.col("kind").isin(RUN, END, FIRST)).collect(), least)  # six rows a task at most
    goes = found.where(F.col("kind") == GOES).select("no_id", "id", "text_hash", "place")
    if frequent:
        keys = docs.sparkSession.createDataFrame(frequent, "h1 long, h2 long")
        goes = goes.unionByName(found.where(F.col("kind") == PENDING).join(F.broadcast(keys), ["h1", "h2"]).select(goes.columns))
    return goes.unionByName(docs.sparkSession.createDataFrame(later, goes.schema)) if later else goes


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, gone = batch.column(2).to_numpy(), batch.column(3)
        at, places = gone.offsets.to_numpy(), gone.values.to_numpy()
        maps = []
        for i, lines in enumerate(n):
            keep = np.ones(lines, bool)
            keep[places[at[i] : at[i + 1]]] = False
            maps.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        ids = batch.column(0)
        yield pa.RecordBatch.from_arrays([ids, batch.column(1), batch.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(maps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep: str = "none") -> DataFrame:
    """doc_id, text_hash, n_lines, n_dropped, keep (deflated bitmap): one row for each different pair of id and text."""
    n = (F.length("text") - F.length(F.replace(F.col("text"), F.lit("\n"), F.lit(""))) + 1).cast("long")
    own = docs.select(*_who(docs, id_col, text_col)).select("no_id", "id", "text_hash", n.alias("n_lines"), F.lit(None).cast("long").alias("place"))
    gone = dropped_lines(docs, id_col, text_col, least, keep).withColumn("n_lines", F.lit(None).cast("long"))
    each = own.unionByName(gone).groupBy("no_id", "id", "text_hash").agg(F.max("n_lines").alias("n_lines"), F.collect_set("place").alias("gone"))
    named = each.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), "text_hash", "n_lines", "gone")
    return named.mapInArrow(_packed, "doc_id long, text_hash long, n_lines long, n_dropped long, keep binary")


def kept_bits(keep: bytes, n_lines: int) -> np.ndarray:
    """The bitmap of a document as an array of n_lines truths."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


@F.arrow_udf(StringType())
def _kept_lines(text: pa.Array, keep: pa.Array, n: pa.Array) -> pa.Array:
    out = []
    for t, k, m in zip(text.cast(pa.binary()).to_pylist(), keep.to_pylist(), n.to_pylist(), strict=True):
        out.append(None if t is None else b"\n".join(itertools.compress(t.split(b"\n"), kept_bits(k, m).tolist())))
    return pa.array(out, pa.binary()).cast(pa.string())


def without_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, keep: str = "none", counts: bool = False) -> DataFrame:
    """docs with only the lines that stay in text_col; counts adds n_lines and n_dropped."""
    bitmaps = keep_bitmaps(docs, id_col, text_col, least, keep)
    none, id_, hash_, n, gone, bits = unused(docs, "_none", "_id", "_hash", "n_lines", "n_dropped", "_keep")
    maps = bitmaps.select(F.col("doc_id").isNull().alias(none), F.coalesce("doc_id", F.lit(0)).alias(id_), F.col("text_hash").alias(hash_), F.col("n_lines").alias(n), F.col("n_dropped").alias(gone), F.col("keep").alias(bits))
    met = docs.withColumns(dict(zip((none, id_, hash_, text_col), _who(docs, id_col, text_col), strict=True))).join(maps, [none, id_, hash_])
    changed = _kept_lines(F.when(F.col(gone) > 0, F.col(text_col)), bits, n)
    return met.withColumn(text_col, F.coalesce(changed, F.col(text_col))).select(*docs.columns, *([F.col(n).alias(n), F.col(gone).alias(gone)] if counts else []))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every document."""
    return without_lines(docs.select("doc_id", "text"), counts=True).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH parts AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM parts),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {LEAST}),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
