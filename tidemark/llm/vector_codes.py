"""Vector code compression: codebooks of vector parts by Lloyd's method with filtering over kd-trees.

Vectors become whole numbers, floor(SCALE * x), and are cut into PARTS consecutive parts; each part position has a codebook of at most
ENTRIES entries, and a vector's code is the index of the nearest entry of each part.

Each partition cuts its rows into blocks and builds, once, a kd-tree over each part of a block: rows in tree order, and for every node its
bounding box and the sum of its rows (counts follow from the shape). Blocks are written to the shared folder; a round reads them. It goes down
a tree level by level with the entries that are still possible for a node. The entry nearest to the middle of the box rules out
each entry that is farther than it from every point of the box (its most favourable corner decides), with ties to the lower
index. A node with one entry left is assigned at once, with its cached sum and count; only rows of leaves with more are compared one by
one. Tasks send a sum and a count for each entry, which Spark adds up; the codebooks themselves (ENTRIES vectors) live on the driver.

All is exact: distances are taken in doubles where they hold every number that occurs, in 64-bit whole numbers otherwise.

Edge cases: a vector that is null, empty, holds a null, NaN or infinite component or one of LARGEST or more in size (squares would not fit 64
bits), or has another length than most (the shorter of two as frequent), has no code and no row. Where the length is not a multiple of
PARTS, part i begins at i * length // PARTS. The first codebooks take distinct ids: of several vectors of one id the smallest in array order. A row
without an id gets a code, but doesn't start a codebook. Fewer ids than ENTRIES make smaller codebooks, and rows none of which has an
id get no codes. Each row that repeats an id has a row of its own. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ._spark import broadcast_if_small, cut

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LARGEST = 16_384
#: rows of a leaf, about; bytes of a block's whole numbers
LEAF = 32
BLOCK_BYTES = 2 << 20
_TREE = [f"{x}{p}" for p in range(PARTS) for x in ("order", "rows", "low", "high", "sums")]


def whole(x: np.ndarray) -> np.ndarray:
    return np.floor(np.asarray(x, np.float64) * SCALE).astype(np.int64)


def bounds(n: int, parts: int = PARTS) -> list[int]:
    return [n * i // parts for i in range(parts + 1)]


class Tree:
    """A balanced kd-tree over whole-number rows: level l has 2^l nodes, node i the rows at[l][i] to at[l][i + 1] in tree order."""

    def __init__(self, rows: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray):
        self.rows, self.order, self.low, self.high, self.sums = rows, order, low, high, sums
        self.depth = (len(low) + 1).bit_length() - 2
        self.at = [len(rows) * np.arange((1 << d) + 1) >> d for d in range(self.depth + 1)]

    @classmethod
    def build(cls, x: np.ndarray) -> Tree:
        n, width = x.shape
        depth = max(0, (n // LEAF).bit_length() - 1) if width else 0
        order = np.arange(n)
        for d in range(depth):
            at = n * np.arange((2 << d) + 1) >> (d + 1)
            for a, mid, b in zip(at[:-1:2], at[1::2], at[2::2], strict=True):
                own = x[order[a:b]]
                widest = int(np.argmax(own.max(0) - own.min(0)))
                order[a:b] = order[a:b][np.argpartition(own[:, widest], mid - a)]
        rows = x[order]
        leaf = n * np.arange((1 << depth) + 1) >> depth
        levels = [[f.reduceat(rows, leaf[:-1], axis=0) for f in (np.minimum, np.maximum, np.add)]]
        for _ in range(depth):
            levels.append([f(y[0::2], y[1::2]) for f, y in zip((np.minimum, np.maximum, np.add), levels[-1], strict=True)])
        return cls(rows, order, *(np.concatenate([y[i] for y in levels[::-1]]) for i in range(3)))

    def packed(self) -> list[bytes]:
        return [self.order.astype("<i4").tobytes(), self.rows.astype("<i4").tobytes(), self.low.astype("<i4").tobytes(), self.high.astype("<i4").tobytes(), self.sums.astype("<i8").tobytes()]

    @classmethod
    def unpacked(cls, width: int, order: bytes, rows: bytes, low: bytes, high: bytes, sums: bytes) -> Tree:
        index = np.frombuffer(order, "<i4")
        if not width:
            return cls(np.zeros((len(index), 0), np.int64), index, *(np.zeros((1, 0), np.int64) for _ in range(3)))
        shaped = (np.frombuffer(b, kind).astype(np.int64).reshape(-1, width) for b, kind in ((rows, "<i4"), (low, "<i4"), (high, "<i4"), (sums, "<i8")))
        return cls(next(shaped), index, *shaped)

    def assigned(self, book: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray | None]]:
        """(from, to, entry, sum): whole subtrees of one entry; (from, to, -1, entries): rows of a leaf, one by one. Places are in tree order."""
        most = max(int(np.abs(book).max(initial=0)), int(np.abs(self.rows).max(initial=0)))
        kind = np.float64 if 8 * max(1, book.shape[1]) * most * most < 1 << 53 else np.int64
        z = book.astype(kind)
        zz = (z * z).sum(1)
        index = np.arange(len(z))
        nodes, left = np.zeros(1, np.int64), np.ones((1, len(z)), bool)
        for d in range(self.depth + 1):
            at = nodes + (1 << d) - 1
            low, high = self.low[at].astype(kind), self.high[at].astype(kind)
            # all scores below are a squared distance less what all entries share
            score = zz - (low + high) @ z.T
            nearest = np.where(left, score, score.max() + 1).argmin(1)
            gain = score - score[np.arange(len(at)), nearest][:, None]
            for a in np.unique(nearest):
                own = nearest == a
                gain[own] -= (high[own] - low[own]) @ np.abs(z - z[a]).T
            left &= (gain < 0) | (gain == 0) & (index <= nearest[:, None])
            alone = left.sum(1) == 1
            for i in np.flatnonzero(alone):
                yield int(self.at[d][nodes[i]]), int(self.at[d][nodes[i] + 1]), int(nearest[i]), self.sums[at[i]]
            nodes, left = nodes[~alone], left[~alone]
            if not len(nodes):
                return
            if d < self.depth:
                nodes, left = np.repeat(2 * nodes, 2) + np.tile([0, 1], len(nodes)), np.repeat(left, 2, axis=0)
        for node, few in zip(nodes, left, strict=True):
            a, b, some = int(self.at[-1][node]), int(self.at[-1][node + 1]), np.flatnonzero(few)
            yield a, b, -1, some[(zz[some] - 2 * self.rows[a:b].astype(kind) @ z[some].T).argmin(1)]

    def sums_of(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sum and count of the rows of each entry."""
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
        for a, b, entry, x in self.assigned(book):
            if entry >= 0:
                sums[entry] += x
                counts[entry] += b - a
            else:
                np.add.at(sums, x, self.rows[a:b])
                np.add.at(counts, x, 1)
        return sums, counts

    def entries_of(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of each row, in the order that the tree was built from."""
        entry = np.zeros(len(self.rows), np.int64)
        for a, b, one, x in self.assigned(book):
            entry[a:b] = one if one >= 0 else x
        far = ((self.rows - book[entry]) ** 2).sum(1)
        out = np.zeros((2, len(entry)), np.int64)
        out[:, self.order] = entry, far
        return out[0], out[1]


def _blocks(n: int):
    cap, at = max(LEAF, BLOCK_BYTES // (4 * n)), bounds(n)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def closed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids, vectors, labels = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
            x = whole(vectors.flatten().to_numpy(zero_copy_only=False)).reshape(-1, n)
            trees = [y for a, b in itertools.pairwise(at) for y in Tree.build(x[:, a:b]).packed()]
            one = pa.array([0, len(x)], pa.int32())
            return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, ids), pa.ListArray.from_arrays(one, labels), *(pa.array([y], pa.binary()) for y in trees)], names=["ids", "labels", *_TREE])

        held, size = [], 0
        for batch in batches:
            a = 0
            while a < batch.num_rows:
                held.append(part := batch.slice(a, cap - size))
                a, size = a + part.num_rows, size + part.num_rows
                if size == cap:
                    yield closed(held)
                    held, size = [], 0
        if held:
            yield closed(held)

    return build


def _trees(batch: pa.RecordBatch, n: int) -> Iterator[tuple[int, list[Tree]]]:
    at = bounds(n)
    for i in range(batch.num_rows):
        yield i, [Tree.unpacked(at[p + 1] - at[p], *(batch.column(f"{x}{p}")[i].as_py() for x in ("order", "rows", "low", "high", "sums"))) for p in range(PARTS)]


def _summed(books: list[np.ndarray], n: int):
    width = max(b.shape[1] for b in books)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [(np.zeros(b.shape, np.int64), np.zeros(len(b), np.int64)) for b in books]
        for batch in batches:
            for _, trees in _trees(batch, n):
                for (sums, counts), tree, book in zip(total, trees, books, strict=True):
                    s, c = tree.sums_of(book)
                    sums += s
                    counts += c
        for part, (sums, counts) in enumerate(total):
            used = np.flatnonzero(counts)
            s = np.zeros((len(used), width), np.int64)
            s[:, : sums.shape[1]] = sums[used]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), part, np.int32)), pa.array(used.astype(np.int32)), pa.array(counts[used]), *(pa.array(np.ascontiguousarray(y)) for y in s.T)],
                                             names=["part", "entry", "rows", *(f"s{j}" for j in range(width))])

    return summed, width


def _encoded(books: list[np.ndarray], n: int):
    digits = np.frombuffer("".join(f"{i:02x}" for i in range(ENTRIES)).encode(), "S2")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels = batch.column(0), batch.column(1)
            for i, trees in _trees(batch, n):
                found = [t.entries_of(b) for t, b in zip(trees, books, strict=True)]
                m = len(found[0][0])
                text = np.stack([digits[e] for e, _ in found], axis=1).tobytes()
                code = pa.StringArray.from_buffers(m, pa.py_buffer(np.arange(0, 2 * PARTS * (m + 1), 2 * PARTS, dtype=np.int32)), pa.py_buffer(text))
                yield pa.RecordBatch.from_arrays([ids[i].values, labels[i].values, code, pa.array(sum(e for _, e in found))], names=["vec_id", "label", "code", "error"])

    return encoded


def _first_ids(rows: DataFrame, count: int) -> list[int]:
    """The `count` smallest ids: of the smallest rows where ids rarely repeat, of the distinct ids otherwise."""
    ids = rows.select("vec_id").where("vec_id IS NOT NULL")
    few = sorted({r["vec_id"] for r in ids.orderBy("vec_id").limit(count).collect()})
    return few if len(few) == count else [r["vec_id"] for r in ids.distinct().orderBy("vec_id").limit(count).collect()]


def vector_codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """(vec_id, label, code, error of every row that has a code; the codebook of each part)."""
    v = F.col(vector_col)
    bad = lambda x: F.coalesce(F.isnan(x) | (F.abs(x) >= LARGEST), F.lit(True))
    good = rows.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad)).select(F.col(id_col).cast("long").alias("vec_id"), v.cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    lengths = good.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "n").first()
    schema = StructType([StructField("vec_id", LongType()), good.schema["label"], StructField("code", StringType()), StructField("error", LongType())])
    none = rows.sparkSession.createDataFrame([], schema), [np.zeros((0, 0), np.int64)] * PARTS
    if not lengths:
        return none
    n = lengths["n"]
    good = good.where(F.size("v") == n)
    first = good.where(F.col("vec_id").isin(_first_ids(good, ENTRIES))).groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").collect()  # ENTRIES vectors
    if not first:
        return none
    x = whole([r["v"] for r in first])
    books = [x[:, a:b].copy() for a, b in itertools.pairwise(bounds(n))]
    kinds = StructType([StructField("ids", ArrayType(LongType())), StructField("labels", ArrayType(good.schema["label"].dataType))])
    blocks = cut(good.mapInArrow(_blocks(n), ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in kinds), *(f"{x} binary" for x in _TREE)])))
    for _ in range(rounds):
        step, width = _summed(books, n)
        sums = blocks.mapInArrow(step, ", ".join(["part int", "entry int", "rows long", *(f"s{j} long" for j in range(width))]))
        for r in sums.groupBy("part", "entry").agg(F.sum("rows").alias("rows"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(width))).collect():  # a row for each entry
            book = books[r["part"]]
            book[r["entry"]] = [r[f"s{j}"] // r["rows"] for j in range(book.shape[1])]
    return blocks.mapInArrow(_encoded(books, n), schema), books


def books_hash(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def digest(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every row that has a code."""
    codes, books = vector_codes(rows)
    codes = cut(codes)
    labels = cut(codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label"))
    met = codes.join(broadcast_if_small(labels, labels.count()), F.col("label").eqNullSafe(F.col("of_label")))
    return met.select("vec_id", "code", "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def _oracle() -> str:
    """Each round as two steps over (row, part, place) and (part, entry, place)."""
    far = lambda b: f"SELECT x.vec_id, x.part, b.entry, sum((x.x - b.x) * (x.x - b.x))::BIGINT AS far FROM x JOIN {b} b USING (part, place) GROUP BY ALL"
    near = lambda b: f"SELECT vec_id, part, entry, far FROM ({far(b)}) QUALIFY row_number() OVER (PARTITION BY vec_id, part ORDER BY far, entry) = 1"
    steps = [
        "k AS MATERIALIZED (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "u AS (SELECT vec_id, unnest(embedding)::DOUBLE AS y, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) AS n FROM k)",
        f"x AS MATERIALIZED (SELECT vec_id, (i * {PARTS} // n)::INTEGER AS part, (i % (n // {PARTS}))::INTEGER AS place, floor({SCALE} * y)::BIGINT AS x FROM u)",
        f"f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k ORDER BY vec_id LIMIT {ENTRIES})",
        "b0 AS MATERIALIZED (SELECT part, entry, place, x FROM x JOIN f USING (vec_id))",
    ]
    for r in range(1, ROUNDS + 1):
        steps.append(f"n{r} AS MATERIALIZED ({near(f'b{r - 1}')})")
        steps.append(f"m{r} AS (SELECT part, entry, place, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM x JOIN n{r} USING (vec_id, part) GROUP BY ALL)")
        steps.append(f"b{r} AS MATERIALIZED (SELECT part, entry, place, coalesce(m{r}.x, b{r - 1}.x) AS x FROM b{r - 1} LEFT JOIN m{r} USING (part, entry, place))")
    steps.append(f"z AS MATERIALIZED ({near(f'b{ROUNDS}')})")
    steps.append("c AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(far)::BIGINT AS error FROM z GROUP BY vec_id)")
    steps.append(f"h AS (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, entry, place)) AS codebooks_sha256 FROM b{ROUNDS})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM c JOIN k USING (vec_id), h"


ORACLE_SQL = _oracle()
