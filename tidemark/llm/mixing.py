"""Mixing sources to target weights by Sainte-Lague apportionment.

Targets: sources in code-point order (null last) weigh 3, 1, 2, repeating, and share 150 % of all words; no target exceeds
twice its source, and what is cut off is shared again by weight. With sources sorted by (2 * size / weight) that is one
running sum: the first k are cut, the others share the rest.

Blocks: the mix is cut into equal blocks of words. Sources get whole blocks by the highest quotients target / 1, / 3,
/ 5, ...; each source's quota is handed down to its shards the same way. A shard holds about SHARD_DOCS documents and
SHARD_BLOCKS blocks at least (where its source has as many), so a source with a third of all rows is many shards and no shard is
shorter than a block. A shard's own blocks are of equal length, near that of the mix, and its quota is its share in them.
Only quotients near the boundary are compared: the divisor lies within S / 2N of the mean (S parties, N blocks), so all
quotients outside that band are decided.

Selection: a shard lays its documents end to end in a seeded order and takes each of its blocks floor(quota / blocks)
times, and the remaining quota as evenly spaced blocks from a seeded offset. No block is taken more than twice. What a
document contributes follows from its place, by arithmetic; blocks are never rows.

Only (id, source, size) is shuffled, not texts. Edge cases: null text has size 0; null source is a source, and sorts last;
a null doc_id takes part under the seed of "null"; rows that repeat count each; an empty table gives no rows. Rows that
share id and size stand in the order of the hash of their id, source and text. Other columns are ignored (mix) or kept
(mixed_documents), whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _text as T
from ._spark import broadcast_if_small, cut, unused

SHARE = 1.5
MOST = 2
BLOCKS = 16_384
SHARD_DOCS = 4096
SHARD_BLOCKS = 16
SEED = "mix-1"


def _div(a: Column, b: Column | int) -> Column:
    """Whole-number division of values that are not negative."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = T.raw(batch.column(3))
        size = [T.Words(buf[off[a] : off[b]], off[a : b + 1], T.SOLID, hashes=False).count for a, b in T.row_groups(off)]
        size = np.concatenate(size) if size else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(size.astype(np.int64))], names=["doc_id", "source", "row", "size"])


def _row(id_col: str, source_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("long"), F.col(source_col).cast("string"), F.col(text_col).cast("string"))


def sized(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, row (hash of id, source and text), size (words) and a seeded hash `h` of every document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _row(id_col, source_col, text_col).alias("row"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_sizes, "doc_id long, source string, row long, size long").withColumn(
        "h", F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))


def targets(sizes: DataFrame) -> DataFrame:
    """source, place (code-point order, null last), docs, source_size, weight, target: one row per source."""
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    # windows over one row per source
    each = each.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    each = each.withColumn("weight", F.element_at(F.array(F.lit(3), F.lit(1), F.lit(2)), (F.col("place") - 1) % 3 + 1))
    each = each.withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    all_ = Window.partitionBy(F.lit(1))
    each = each.withColumn("total", SHARE * F.sum("source_size").over(all_))
    each = each.withColumn("level", (F.col("total") - (F.sum("cap").over(order) - F.col("cap"))) / F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place"))).over(all_)
    each = each.withColumn("target", F.least(F.col("cap").cast("double"), F.coalesce(level, F.max("ratio").over(all_)) * F.col("weight")))
    return each.select("source", "place", "docs", "source_size", "weight", "target", "total")


def apportion(parties: DataFrame, group: list[str], seats: Column, share: Column, most: Column, order: list[str]) -> DataFrame:
    """parties with `quota`: Sainte-Lague seats within each group. share: a party's exact share of the seats; most: its largest quota; order breaks ties."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    p = parties.withColumn("_n", seats.cast("long")).withColumn("_share", share.cast("double")).withColumn("_most", most.cast("long")).withColumn("_s", F.count(F.lit(1)).over(w))
    slack = F.col("_share") * F.col("_s") / F.greatest(F.col("_n"), F.lit(1)) / 2 + 1.5
    p = p.withColumn("_low", F.least(F.greatest(F.floor(F.col("_share") - slack), F.lit(0)), F.col("_most"))).withColumn("_high", F.least(F.ceil(F.col("_share") + slack), F.col("_most")))
    p = p.withColumn("_left", F.col("_n") - F.sum("_low").over(w))
    near = p.withColumn("_j", F.explode(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high"))).otherwise(F.array(F.lit(None).cast("long")))))
    near = near.withColumn("_q", F.col("_share") / (2 * F.col("_j") - 1))
    near = near.withColumn("_rank", F.row_number().over(Window.partitionBy(*(group or [F.lit(1)])).orderBy(F.col("_q").desc_nulls_last(), *order)))
    won = F.count(F.when(F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_left")), 1))
    keep = parties.columns
    return near.groupBy(*keep).agg((F.first("_low") + won).alias("quota"))


def plan(sizes: DataFrame) -> DataFrame:
    """One row per row of `sizes`: what the mix takes of it, with the place of its words in its shard and the shard's selection rule."""
    sizes = cut(sizes)  # small rows, read several times below
    goal = targets(sizes)
    least = F.min(F.when(F.col("target") > 0, F.col("target"))).over(Window.partitionBy(F.lit(1)))
    all_ = Window.partitionBy(F.lit(1))
    mean = F.floor(F.sum("source_size").over(all_) / F.sum("docs").over(all_) * SHARD_DOCS / SHARD_BLOCKS)  # blocks of which a shard of mean documents holds enough
    goal = goal.withColumn("block", F.greatest(F.lit(1), F.least(F.floor(F.col("total") / BLOCKS), F.greatest(F.lit(16), mean), F.greatest(F.lit(16), F.floor(F.coalesce(least, F.lit(0.0)) / 16)))))
    goal = goal.withColumn("shards", F.greatest(F.lit(1), F.least(F.ceil(F.col("docs") / SHARD_DOCS), _div(F.col("source_size"), F.col("block") * SHARD_BLOCKS))))
    blocks_of = lambda words: _div(words + F.col("block") - 1, F.col("block"))
    quota = apportion(goal, [], F.round(F.col("total") / F.col("block")), F.col("target") / F.col("block"), MOST * blocks_of(F.col("source_size")), ["place"]).withColumnRenamed("quota", "source_quota")
    quota = cut(quota)
    # the sources are one row each; a plan over very many of them is joined by shuffle
    n = quota.count()
    rows = sizes.join(broadcast_if_small(quota, n, 100_000), sizes["source"].eqNullSafe(quota["source"])).drop(quota["source"])
    rows = rows.withColumn("shard", F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % F.col("shards"))
    shards = rows.groupBy("place", "shard", "block", "source_quota", "source_size").agg(F.sum("size").alias("words"))
    # a shard's own blocks: as many of the mix's length as come nearest to its words
    shards = shards.withColumn("near", F.greatest(F.lit(1), _div(2 * F.col("words") + F.col("block"), 2 * F.col("block"))))
    shards = shards.withColumn("own", F.greatest(F.lit(1), _div(F.col("words") + F.col("near") - 1, F.col("near")))).withColumn("blocks", _div(F.col("words") + F.col("own") - 1, F.col("own")))
    share = F.when(F.col("source_size") > 0, F.col("source_quota") * F.col("block") * F.col("words") / F.col("source_size") / F.col("own")).otherwise(0.0)
    shards = shards.withColumn("share", F.least(share, (MOST * F.col("blocks")).cast("double"))).withColumn("seats", F.round(F.sum("share").over(Window.partitionBy("place"))))
    shards = apportion(shards, ["place"], F.col("seats"), F.col("share"), MOST * F.col("blocks"), ["shard"])
    shards = shards.select("place", "shard", "quota", "blocks", "own")
    rows = rows.drop("block").join(shards, ["place", "shard"]).withColumnRenamed("own", "block")
    line = Window.partitionBy("place", "shard").orderBy("h", "doc_id", "size", "row")
    rows = rows.withColumn("start", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    n_blocks = F.greatest(F.col("blocks"), F.lit(1))
    rows = rows.withColumn("every", _div(F.col("quota"), n_blocks)).withColumn("more", F.col("quota") % n_blocks)
    offset = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(SEED), "place", "shard")), 1, 8), 16, 10).cast("long") % n_blocks
    rows = rows.withColumn("offset", offset)
    upto = lambda b: _div(b * F.col("more") + F.col("offset"), n_blocks)  # noqa: E731  extra blocks among the first b
    b0, b1 = _div(F.col("start"), F.col("block")), _div(F.greatest(F.col("start") + F.col("size") - 1, F.lit(0)), F.col("block"))
    extra = F.col("block") * (upto(b1 + 1) - upto(b0)) - (F.col("start") - b0 * F.col("block")) * (upto(b0 + 1) - upto(b0)) - ((b1 + 1) * F.col("block") - F.col("start") - F.col("size")) * (upto(b1 + 1) - upto(b1))
    taken = F.when(F.col("size") > 0, F.col("every") * F.col("size") + extra).otherwise(F.lit(0))
    return rows.withColumn("taken", taken.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every document."""
    return plan(sized(docs, id_col, source_col, text_col)).select("doc_id", "source", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, in the columns of `docs`: a document comes once for each pass in which words of it are taken, with the text of those words' runs.

    Documents of which nothing is taken are absent. Rows that share id, source and text are interchangeable: one of them stands
    for all, and is joined to the places of all of them.
    """
    key, place, times = unused(docs, "_key", "_place", "_times")
    marks = ["start", "block", "every", "more", "offset", "blocks"]
    rows = plan(sized(docs, id_col, source_col, text_col)).select(
        F.col("row").alias(key), "taken", F.struct("size", "start", "block", "every", "more", "offset", F.greatest("blocks", F.lit(1)).alias("blocks")).alias(place))
    rows = cut(rows)
    often = rows.groupBy(key).agg(F.count(F.lit(1)).alias(times)).where(F.col(times) > 1).select(key)
    often = cut(often)
    n_often, n = often.count(), rows.count()
    some = rows.where("taken > 0").select(key, place)
    out = docs.withColumn(key, _row(id_col, source_col, text_col))
    if n_often:
        often = broadcast_if_small(often, n_often)
        same = out.join(often, key, "left_semi").dropDuplicates([key]).join(some.join(often, key, "left_semi"), key)
        one = out.join(often, key, "left_anti")
    else:
        same, one = None, out
    one = one.join(broadcast_if_small(some, n, 200_000), key)
    both = one if same is None else one.unionByName(same)
    columns = docs.columns
    out_schema = docs.schema

    def slice_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            texts, places = t.column(text_col), t.column(place)
            take, text, held = [], [], 0

            def done() -> Iterator[pa.RecordBatch]:
                got = t.select(columns).take(pa.array(take, pa.int64()))
                at = columns.index(text_col)
                got = got.set_column(at, pa.field(text_col, pa.string()), pa.array(text, pa.string()))
                if chars_col in columns:
                    at = columns.index(chars_col)
                    got = got.set_column(at, pa.field(chars_col, got.schema.field(at).type), pa.array([len(x) for x in text], pa.int64()).cast(got.schema.field(at).type))
                yield from got.combine_chunks().to_batches()

            for i in range(t.num_rows):
                buf = (texts[i].as_py() or "").encode()
                w = T.Words(np.frombuffer(buf, np.uint8), np.array([0, len(buf)]), T.SOLID, hashes=False)
                for piece in pieces(**places[i].as_py()):
                    take.append(i)
                    text.append("\n".join(buf[w.abs_start[a] : w.abs_end[b - 1]].decode() for a, b in piece))
                    held += len(text[-1])
                    if held >= 4 << 20:  # a batch goes out in parts
                        yield from done()
                        take, text, held = [], [], 0
            yield from done()
            pa.default_memory_pool().release_unused()

    return both.mapInArrow(slice_, out_schema)


def pieces(size: int, start: int, block: int, every: int, more: int, offset: int, blocks: int) -> list[list[tuple[int, int]]]:
    """For each pass the runs [a, b) of a document's words that it takes."""
    out = []
    b0, b1 = start // block, (start + size - 1) // block
    times = [(max(0, b * block - start), min(size, (b + 1) * block - start), every + ((b + 1) * more + offset) // blocks - (b * more + offset) // blocks) for b in range(b0, b1 + 1)]
    for k in range(1, MOST + 1):
        runs: list[tuple[int, int]] = []
        for a, b, n in times:
            if n >= k:
                if runs and runs[-1][1] == a:
                    runs[-1] = (runs[-1][0], b)
                else:
                    runs.append((a, b))
        if runs:
            out.append(runs)
    return out


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM documents),
s0 AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
s1 AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s0),
s2 AS (
  SELECT *, {MOST} * source_size AS cap, ({MOST} * source_size)::DOUBLE / weight AS ratio, {SHARE}::DOUBLE * sum(source_size) OVER () AS total FROM s1),
s3 AS (
  SELECT *, (total - (sum(cap) OVER (ORDER BY ratio, place) - cap)::DOUBLE)
            / (sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM s2),
s4 AS (
  SELECT *, least(cap::DOUBLE, coalesce((SELECT arg_min(level, (ratio, place)) FROM s3 WHERE level <= ratio), (SELECT max(ratio) FROM s3)) * weight) AS target FROM s3),
s5 AS (
  SELECT *, greatest(1, least(floor(total / {BLOCKS}), greatest(16, floor((SELECT sum(source_size)::DOUBLE / sum(docs)::DOUBLE FROM s4) * {SHARD_DOCS} / {SHARD_BLOCKS})),
           greatest(16, floor(coalesce((SELECT min(target) FROM s4 WHERE target > 0), 0) / 16))))::BIGINT AS block FROM s4),
s6 AS (SELECT *, greatest(1, least(ceil(docs / {SHARD_DOCS}.0)::BIGINT, source_size // (block * {SHARD_BLOCKS}))) AS shards FROM s5),
q1 AS (
  SELECT place, unnest(range(1, least(ceil(target / block)::BIGINT + 2, {MOST} * ((source_size + block - 1) // block)) + 1)) AS j, target / block AS share, round(total / block) AS n FROM s5),
q2 AS (SELECT place, n, row_number() OVER (ORDER BY share / (2 * j - 1) DESC, place) AS r FROM q1),
q3 AS (SELECT place, count(*) AS source_quota FROM q2 WHERE r <= n GROUP BY place),
rows_ AS (
  SELECT d.*, s6.* EXCLUDE (source), coalesce(source_quota, 0) AS source_quota, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard
  FROM d JOIN s6 ON d.source IS NOT DISTINCT FROM s6.source LEFT JOIN q3 USING (place)),
h0 AS (SELECT place, shard, block, source_quota, source_size, sum(size)::BIGINT AS words FROM rows_ GROUP BY ALL),
h1 AS (SELECT *, greatest(1, (2 * words + block) // (2 * block)) AS near FROM h0),
h2 AS (SELECT *, greatest(1, (words + near - 1) // near) AS own FROM h1),
h3 AS (
  SELECT *, (words + own - 1) // own AS blocks,
         least(CASE WHEN source_size > 0 THEN (source_quota * block)::DOUBLE * words / source_size / own ELSE 0 END, ({MOST} * ((words + own - 1) // own))::DOUBLE) AS share FROM h2),
h4 AS (SELECT *, round(sum(share) OVER (PARTITION BY place)) AS seats FROM h3),
h5 AS (SELECT *, unnest(range(1, least(ceil(share)::BIGINT + 2, {MOST} * blocks) + 1)) AS j FROM h4),
h6 AS (SELECT place, shard, seats, row_number() OVER (PARTITION BY place ORDER BY share / (2 * j - 1) DESC, shard) AS r FROM h5),
h7 AS (SELECT place, shard, count(*) AS quota FROM h6 WHERE r <= seats GROUP BY place, shard),
l0 AS (
  SELECT r.* EXCLUDE (block), own AS block, coalesce(quota, 0) AS quota, greatest(blocks, 1) AS blocks,
         sum(size) OVER (PARTITION BY place, shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS start
  FROM rows_ r JOIN h4 USING (place, shard) LEFT JOIN h7 USING (place, shard)),
l1 AS (
  SELECT *, quota // blocks AS every, quota % blocks AS more, start // block AS b0, greatest(start + size - 1, 0) // block AS b1,
         CAST('0x' || substr(md5('{SEED}:' || place || ':' || shard), 1, 8) AS BIGINT) % blocks AS off FROM l0)
SELECT doc_id, size, source_size, target,
       CASE WHEN size > 0 THEN every * size
         + block * (((b1 + 1) * more + off) // blocks - (b0 * more + off) // blocks)
         - (start - b0 * block) * (((b0 + 1) * more + off) // blocks - (b0 * more + off) // blocks)
         - ((b1 + 1) * block - start - size) * (((b1 + 1) * more + off) // blocks - (b1 * more + off) // blocks) ELSE 0 END::BIGINT AS taken
FROM l1
"""
