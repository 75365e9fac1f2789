"""Exact top-k search in Hamming space by incremental multi-index hashing.

Vectors become binary codes: a bit for the sign of each dimension (of BITS seeded sign projections where there are more
dimensions than BITS). A code is cut into m segments of about log2(codes) bits; the index holds every distinct code
under each of its m segment values. A code within distance s = m * r + a of a query has to be within r of it in
one of the first a + 1 segments or within r - 1 in another (pigeonhole), so the search grows r from 0, probing all
segment values at exactly r flipped bits, and after each step verifies full distances. A query is done when its kth
verified distance is at most the distance that the probes so far provably cover. The answer is exact; there is no cap
on candidates or probes.

Equal codes are one index entry with the k smallest ids that have it, which is all that the k nearest can need, so a
vector shared by a third of all rows costs one entry. Buckets are rows of at most CHUNK codes, so a crowded
segment value is many rows. Probes of one segment value are gathered in lists of about GROUP queries before they meet its bucket
in a hash join, so the join makes a row for a list and a bucket and not for each probe; distances are taken in numpy,
PAIRS at a time. Each radius is one job, written to the shared folder, and there are at most segment-width + 1 of them.

Edge cases: a null vector, or one with a null or NaN anywhere, or of another length than most (the shorter of two as
frequent), has no code: it is not found and finds nothing. A query's own row counts as a row. Ties go to the smaller id. Fewer
than k rows give all of them. Rows that repeat an id are one entry for each different code; a query id with several codes
has the k nearest over all of them, as in ORACLE_SQL. Queries of one code are searched once. An empty table on either side gives no
rows. Further columns of the vectors are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._spark import cut

BITS = 64
CHUNK = 2048
#: queries in one list of probes, about; a query is in a list once
GROUP = 16_384
#: distances taken at a time
PAIRS = 1 << 20
K = 10
SEED = 9
#: vectors projected at a time
ROWS = 256


def codes(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, code (64 bits as a long) of every row that has one: signs of the dimensions, or of BITS projections where there are more of them."""
    v = F.col(vector_col)
    good = rows.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x)))
    lengths = good.groupBy(F.size(v).alias("n")).agg(F.count(F.lit(1)).alias("times")).orderBy(F.desc("times"), "n").first()
    n = lengths["n"] if lengths else 0
    good = good.where(F.size(v) == n).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    if n > BITS:
        return good.select("id", F.col("v").cast("array<double>")).mapInArrow(_projected(n), "id long, code long").distinct()
    code = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return good.select("id", code.alias("code")).distinct()


def _projected(n: int):
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Signs of seeded projections, summed in the order of the dimensions, so that equal vectors get equal codes in any batch."""
        to = np.random.default_rng(SEED).standard_normal((n, BITS))
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, n)
            out = [np.zeros(0, np.int64)]
            for a in range(0, len(x), ROWS):
                part, total = np.ascontiguousarray(x[a : a + ROWS].T), 0.0
                with np.errstate(invalid="ignore", over="ignore"):
                    for i in range(n):
                        total = total + part[i][:, None] * to[i]
                out.append(np.packbits(total > 0, axis=1).view(">u8").astype(np.uint64).view(np.int64).ravel())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out), pa.int64())], names=["id", "code"])

    return project


def segments(n: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(shift, width) of the segments for n codes."""
    m = max(1, math.ceil(bits / max(8, min(20, round(math.log2(max(n, 2)))))))
    cuts = [bits * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def _segment(code: Column, shift: int, width: int) -> Column:
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _exploded(rows: DataFrame, parts: list[tuple[int, int]], code: str = "code") -> DataFrame:
    each = F.array(*[F.struct(F.lit(i).alias("seg"), F.lit(w).alias("width"), _segment(F.col(code), s, w).alias("value")) for i, (s, w) in enumerate(parts)])
    return rows.select("*", F.explode(each).alias("s")).select(*rows.columns, "s.seg", "s.width", "s.value")


def _blocks(nq: np.ndarray, nc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place of the query, place of the code) of all pairs of each row's lists, at most about PAIRS at a time."""
    step = np.maximum(1, PAIRS // np.maximum(nc, 1))
    parts = -(-nq // step)
    row = np.repeat(np.arange(len(nq)), parts)
    first = (np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)) * step[row]
    many = np.minimum(step[row], nq[row] - first) * nc[row]
    group = np.cumsum(many) // PAIRS
    for a, b in zip(*(lambda e: (e[:-1], e[1:]))(np.append(np.flatnonzero(np.diff(group, prepend=-1)), len(row))), strict=True):
        n = many[a:b]
        part = np.repeat(np.arange(a, b), n)
        at = np.arange(len(part)) - np.repeat(np.cumsum(n) - n, n)
        width = nc[row[part]]
        yield row[part], first[part] + at // width, at % width


def _verify(k: int):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Lists of queries with buckets; out come the k best codes of each query and block of pairs."""
        for batch in batches:
            if not batch.num_rows:
                continue
            q_list, c_list = batch.column(0), batch.column(1)
            q_off, c_off = q_list.offsets.to_numpy().astype(np.int64), c_list.offsets.to_numpy().astype(np.int64)
            qs, cs = q_list.values, c_list.values
            qcode, most = qs.field("qcode").to_numpy(), qs.field("most").to_numpy()
            code_, low_ = cs.field("code").to_numpy(), cs.field("low").to_numpy()
            for row, i, j in _blocks(np.diff(q_off), np.diff(c_off)):
                i, j = q_off[row] + i, c_off[row] + j
                d = np.bitwise_count((code_[j] ^ qcode[i]).view(np.uint64)).astype(np.int32)
                near = d <= most[i]  # farther than the kth so far can't enter
                d, q, code, low = d[near], qcode[i[near]], code_[j[near]], low_[j[near]]
                order = np.lexsort((code, low, d, q))
                q, d, low, code = q[order], d[order], low[order], code[order]
                new = np.ones(len(q), bool)
                new[1:] = (q[1:] != q[:-1]) | (code[1:] != code[:-1])
                q, d, low, code = q[new], d[new], low[new], code[new]
                head = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, int)
                place = np.arange(len(q)) - np.repeat(head, np.diff(np.append(head, len(q))))
                top = place < k
                yield pa.RecordBatch.from_arrays([pa.array(q[top]), pa.array(d[top]), pa.array(low[top]), pa.array(code[top])], names=["qid", "distance", "low", "code"])

    return verify


def top_k(queries: DataFrame, rows: DataFrame, k: int = K) -> DataFrame:
    """qid, rank (from 1), id, distance: the k nearest of `rows` for each of `queries`; both have distinct id and code."""
    first = Window.partitionBy("code").orderBy("id")
    # k ids of each code at most leave the window, before and after the shuffle
    entries = cut(rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k).groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    n = entries.count()
    parts = segments(n)
    m = len(parts)
    listed = _exploded(entries.select("code", F.col("ids")[0].alias("low")), parts)
    sizes = listed.groupBy("seg", "value").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias("chunks")).where("chunks > 1")
    buckets = cut(
        listed.join(sizes, ["seg", "value"], "left").withColumn("chunk", F.pmod(F.xxhash64("code"), F.coalesce("chunks", F.lit(1))))
        .groupBy("seg", "value", "chunk").agg(F.collect_list(F.struct("code", "low")).alias("codes")))
    best = "array<struct<distance:int,low:long,code:long>>"
    # the answer is that of the code: qid stands for it until the end
    state = cut(queries.select(F.col("code").alias("qid"), F.col("code").alias("qcode"), F.array().cast(best).alias("best")).dropDuplicates(["qid"]))
    widest = max(w for _, w in parts)
    done = None
    for r in range(widest + 1):
        kth = F.when(F.size("best") >= k, F.element_at("best", k)["distance"] if r else F.lit(None).cast("int"))
        state = state.withColumn("kth", kth)
        open_ = state.where(F.col("kth").isNull() | (F.col("kth") > m * r - 1))
        closed = state.where(F.col("kth") <= m * r - 1).select("qid", "best")
        done = closed if done is None else done.unionByName(closed)
        many = open_.count()
        if not many:
            break
        probes = _exploded(open_.select("qcode", "kth"), parts, "qcode").where(F.col("kth").isNull() | (F.col("kth") > m * r + F.col("seg") - 1))
        # all values that differ in r bits: C(width, r) at most, whatever the input
        flips = [F.when(F.col("width") == w, F.split(F.lit(",".join(map(str, _masks(w, r)))), ",").cast("array<bigint>")) for w in {w for _, w in parts} if r <= w]
        probes = probes.select("qcode", "kth", "seg", "value", F.explode(F.coalesce(*flips)).alias("flip"))
        lists = probes.groupBy("seg", F.col("value").bitwiseXOR(F.col("flip")).alias("value"), F.pmod(F.xxhash64("qcode"), F.lit(-(-many // GROUP))).alias("part")).agg(
            F.collect_list(F.struct("qcode", F.coalesce("kth", F.lit(BITS)).cast("int").alias("most"))).alias("queries"))
        hits = lists.join(buckets, ["seg", "value"]).select("queries", "codes")
        found = hits.mapInArrow(_verify(k), "qid long, distance int, low long, code long")
        found = found.groupBy("qid").agg(F.collect_set(F.struct("distance", "low", "code")).alias("found"))
        merged = F.slice(F.array_sort(F.array_distinct(F.concat("best", F.coalesce("found", F.array().cast(best))))), 1, k)
        state = cut(open_.join(found, "qid", "left").select("qid", "qcode", merged.alias("best")))
    left = state.select("qid", "best")
    answers = left if done is None else done.unionByName(left.join(done.select("qid"), "qid", "left_anti"))
    near = answers.select("qid", F.explode("best").alias("b")).select("qid", "b.distance", "b.code").join(entries, "code").select("qid", "distance", F.explode("ids").alias("id"))
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id"))).where(F.col("n") <= k)
    near = near.withColumnRenamed("qid", "code").join(queries.select(F.col("id").alias("qid"), "code"), "code")
    order = Window.partitionBy("qid").orderBy("distance", "id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "distance")


def _masks(width: int, r: int) -> list[int]:
    from itertools import combinations

    return [sum(1 << b for b in c) for c in combinations(range(width), r)]


ORACLE_SQL = f"""
WITH c AS (
  SELECT vec_id AS id, list_aggregate(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), 'string_agg', '') AS code FROM embeddings),
q AS (SELECT * FROM c WHERE id % 100 = 0),
d AS (SELECT q.id AS qid, c.id AS id, hamming(q.code, c.code)::INTEGER AS distance FROM q, c)
SELECT qid, rank::INTEGER AS rank, id, distance FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, id) AS rank FROM d) WHERE rank <= {K}
"""
