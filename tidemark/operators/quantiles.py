"""Exact quantiles and places of groups of any size: neither needs a group in one task's memory or one task's sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.names import spare
from tidemark.operators.shared import kept

#: buckets in which a group's values are counted; a power of two
BUCKETS = 64


def beside(left: DataFrame, right: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """left with the right side's row of its group, null groups too; a right side of one row in all (no `by`) is broadcast."""
    if not by:
        return left.join(F.broadcast(right), F.lit(True), how)
    named = dict(zip(by, spare(left.join(right.drop(*by).limit(0)), *[f"_of_{c}" for c in by]), strict=True))
    right = right.withColumnsRenamed(named)
    same = [F.col(c).eqNullSafe(F.col(named[c])) for c in by]
    return left.join(right, same, how).drop(*named.values())


def quantiles(rows: DataFrame, by: Sequence[str], value: str | Column, qs: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """by, n (values) and q, the interpolated quantiles `qs` of each group; null values take no part, a group without values has no row (without `by`: one row of nulls, n 0).

    Values are counted first, so that a repeated one is one row. Bounds from a mergeable sketch of the distinct values cut a group into `buckets`, whose
    counts tell in which of them each quantile lies; only these are sorted, each by a task of its own.
    """
    v, c, b, n, upto, all_, cuts, want, here = spare(rows, "_v", "_c", "_b", "_n", "_upto", "_all", "_cuts", "_want", "_here")
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    counts = rows.select(*by, x.alias(v)).where(F.col(v).isNotNull()).groupBy(*by, v).agg(F.count(F.lit(1)).alias(c))
    bounds = counts.where(~F.isnan(v)).groupBy(*by).agg(F.percentile_approx(v, [i / buckets for i in range(1, buckets)], 16 * buckets).alias(cuts))
    placed = beside(counts, bounds, by).withColumn(b, F.lit(0))
    step = buckets // 2
    while step:  # the number of bounds under a value, by halving
        placed = placed.withColumn(b, F.col(b) + F.when(F.coalesce(F.get(cuts, F.col(b) + (step - 1)) < F.col(v), F.lit(False)), step).otherwise(0))
        step //= 2
    placed = placed.drop(cuts)
    whole = Window.partitionBy(*by)
    total = placed.groupBy(*by, b).agg(F.sum(c).alias(n)).withColumns({upto: F.sum(n).over(whole.orderBy(b)), all_: F.sum(n).over(whole)})  # `buckets` rows a group
    rank = lambda q, up: (F.ceil if up else F.floor)((F.col(all_) - 1) * F.lit(q))
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("i"), rank(q, up).alias("r")) for i, q in enumerate(qs) for up in (0, 1)])
    wanted = total.withColumn(want, F.filter(ranks, lambda r: (r["r"] >= F.col(upto) - F.col(n)) & (r["r"] < F.col(upto)))).where(F.size(want) > 0)
    wanted = wanted.select(*by, b, (F.col(upto) - F.col(n)).alias(here), all_, want)
    mine = beside(placed, wanted, [*by, b], "inner")
    mine = mine.withColumn(upto, F.col(here) + F.sum(c).over(Window.partitionBy(*by, b).orderBy(v)))
    hit = mine.select(*by, v, all_, F.explode(F.filter(want, lambda r: (r["r"] >= F.col(upto) - F.col(c)) & (r["r"] < F.col(upto)))).alias(want))
    at = lambda i: F.max(F.when(F.col(want)["i"] == i, F.col(v)))
    got = hit.groupBy(*by).agg(F.max(all_).alias(all_), F.array(*[at(i) for i in range(2 * len(qs))]).alias(want))
    part = lambda q: (F.col(all_) - 1) * F.lit(q)
    between = lambda q, lo, hi: F.when(lo == hi, lo).otherwise((F.ceil(part(q)) - part(q)) * lo + (part(q) - F.floor(part(q))) * hi)
    return got.select(*by, F.coalesce(all_, F.lit(0)).alias("n"), F.array(*[between(q, F.col(want)[2 * i], F.col(want)[2 * i + 1]) for i, q in enumerate(qs)]).alias("q"))


def with_quantiles(rows: DataFrame, by: Sequence[str], value: str | Column, qs: Sequence[float], name: str) -> DataFrame:
    """rows with the array `name` of their group's quantiles (null where it has no values)."""
    return beside(rows, quantiles(rows, by, value, qs).select(*by, F.col("q").alias(name)), by)


def numbered(rows: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """rows with their place `_i` from 0 in the order of their group and the number `_n` of its rows.

    Rows are dealt out by ranges of group and order and sorted where they lie, so that a huge group is many tasks' work; a row's place is that in
    its range, after the sizes of the group's ranges before it. The sorted rows are kept once: the ranges have to be the same for both looks.
    """
    pos, part, first, many, before, total = spare(rows, "_pos", "_part", "_first", "_many", "_before", "_total")
    keys = [*by, *order]
    x = kept(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(pos, F.monotonically_increasing_id()))
    x = x.withColumn(part, F.shiftright(pos, 33))
    w = Window.partitionBy(*by)
    pieces = x.groupBy(*by, part).agg(F.min(pos).alias(first), F.count(F.lit(1)).alias(many))  # a row for each range of a group
    pieces = pieces.withColumns({before: F.sum(many).over(w.orderBy(part)) - F.col(many), total: F.sum(many).over(w)})
    met = beside(x, pieces.drop(many), [*by, part], "inner")
    return met.withColumns({"_i": F.col(before) + F.col(pos) - F.col(first), "_n": F.col(total)}).drop(pos, part, first, before, total)
