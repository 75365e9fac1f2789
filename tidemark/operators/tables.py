"""Tables about groups: levels beside rows, conditional pivots, flows, shares, paths, rankings, splits by place, audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.names import spare
from tidemark.operators.quantiles import beside, with_quantiles


def with_level(rows: DataFrame, by: Sequence[str], value: str, level: str = "level", members: str = "members", places: int | None = None) -> DataFrame:
    """rows with the mean of a value over their group (rounded, where `places` says so) and the number of its rows; aggregated, then joined back, null groups too."""
    mean = F.avg(value)
    return beside(rows, rows.groupBy(*by).agg((mean if places is None else F.round(mean, places)).alias(level), F.count(F.lit(1)).alias(members)), by)


def pivot_sums(rows: DataFrame, by: Sequence[str], value: str, cells: Mapping[str, Column]) -> DataFrame:
    """A column for each cell: the sum of a value where its condition holds, 0 where it never does; one pass, whatever the number of cells."""
    return rows.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(c, F.col(value))), F.lit(0.0)).alias(name) for name, c in cells.items()])


def large_flow(rows: DataFrame, by: Sequence[str], size: str, sold: Column, q: float, name: str = "large_flow") -> DataFrame:
    """Signed size of a group's large rows (at or over its exact quantile q) over the size of all its rows, sold ones negative; null for a group of size 0."""
    (cut,) = spare(rows, "_cut")
    x = with_quantiles(rows, by, size, [q], cut)
    big = F.sum(F.when(F.col(size) >= F.col(cut)[0], F.when(sold, -F.col(size)).otherwise(F.col(size))))
    return x.groupBy(*by).agg((F.coalesce(big, F.lit(0.0)) / F.nullif(F.sum(size), F.lit(0.0))).alias(name))


def last_in(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "last") -> DataFrame:
    """The value of each group's last row in order."""
    return rows.groupBy(*by).agg(F.max_by(value, F.struct(*order)).alias(name))


def value_shares(rows: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """by, value, n, share (of its group) and is_mode (the commonest value, the first in order of several): from counts, a row a value."""
    c = rows.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    return c.withColumns({"share": F.col("n") / F.sum("n").over(w), "is_mode": F.row_number().over(w.orderBy(F.desc("n"), value)) == 1})


def correlations(rows: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """One row: the correlation of the target with each column, as c_<column>; over the rows that have both."""
    return rows.agg(*[F.corr(target, c).alias(f"c_{c}") for c in columns])


def damage(rows: DataFrame, whole: str, part: str, value: str) -> DataFrame:
    """whole, part, damage (sum of the negative values), losers and is_whole (1 for the row of all parts) of each part and of all parts together."""
    lost = F.col(value) < 0
    return rows.groupingSets([[whole, part], [whole]], whole, part).agg(F.sum(F.when(lost, F.col(value)).otherwise(0.0)).alias("damage"), F.count(F.when(lost, 1)).alias("losers"), F.grouping(part).cast("int").alias("is_whole"))


def paths(rows: DataFrame, key: str, order: Sequence[str], state: str) -> DataFrame:
    """key, path (its states in order, joined by >) and n. A key's states are one row: for keys of bounded length."""
    x = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*order, F.col(state).alias("_state")))).alias("_all"))
    return x.select(key, F.array_join(F.transform("_all", lambda s: s["_state"]), ">").alias("path"), F.size("_all").cast("long").alias("n"))


def ranked(rows: DataFrame, order: Sequence[Column], most: int, name: str = "place") -> DataFrame:
    """The first `most` rows in order, with their place from 1: only these meet in one task."""
    return rows.orderBy(*order).limit(most).withColumn(name, F.row_number().over(Window.orderBy(*order)))


def split_sums(rows: DataFrame, by: Sequence[str], time: Sequence[str], size: Sequence[Column | str], value: str, worst: int, first: float, last: float, tail: float) -> DataFrame:
    """without_worst (the sum without the `worst` rows in order of `size`), first_part and last_part (sums of these shares of the rows in order of `time`), and cut (rows of the tail share, rounded up)."""
    r, p, n = spare(rows, "_r", "_p", "_n")
    w = Window.partitionBy(*by)
    x = rows.withColumns({r: F.row_number().over(w.orderBy(*size)), p: F.row_number().over(w.orderBy(*time)), n: F.count(F.lit(1)).over(w)})
    part = lambda c: F.sum(F.when(c, F.col(value)))
    return x.groupBy(*by).agg(part(F.col(r) > worst).alias("without_worst"), part(F.col(p) <= F.floor(F.col(n) * first)).alias("first_part"),
                              part(F.col(p) > F.col(n) - F.floor(F.col(n) * last)).alias("last_part"), F.count(F.when(F.col(r) <= F.ceil(F.col(n) * tail), 1)).alias("cut"))


def running(rows: DataFrame, key: str, order: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """rows with running sums of a key in order."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({k: F.sum(c).over(w) for k, c in sums.items()})


def vetoes(panel: DataFrame, key: str, at: str, price: str, pair: tuple[str, str], backs: tuple[int, int], moves: tuple[float, float], breadth: tuple[float, float], median: float) -> DataFrame:
    """at and reasons (comma-joined, in order): both_short and both_long, where both benchmarks rose over `moves` in `backs` rows; breadth, where over breadth[1] of the members rose over
    breadth[0] in the shorter time; median, where the middle member rose over `median` in it."""
    w = Window.partitionBy(key).orderBy(at)
    x = panel.select(key, at, *[(F.col(price) / F.nullif(F.lag(price, k).over(w), F.lit(0.0)) - 1).alias(f"_r{i}") for i, k in enumerate(backs)])
    of = lambda i, j: F.max(F.when(F.col(key) == pair[i], F.col(f"_r{j}"))) > moves[j]
    why = {"both_short": of(0, 0) & of(1, 0), "both_long": of(0, 1) & of(1, 1), "breadth": F.avg(F.when(F.col("_r0") > breadth[0], 1.0).otherwise(0.0)) > breadth[1], "median": F.percentile("_r0", 0.5) > median}
    return x.groupBy(at).agg(F.concat_ws(",", *[F.when(c, k) for k, c in why.items()]).alias("reasons"))


def sides_paid(rows: DataFrame, by: Sequence[str], order: Sequence[str], side: str, value: str, paid: str) -> DataFrame:
    """pays (whether the rows of one side sum to more than 0) and sides (how many there are) by group.

    Rows are added up in `order`: doubles that cancel leave a rest whose sign hangs on the order, which that of a distributed sum is not fixed.
    """
    (total,) = spare(rows, "_total")
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = rows.select(*by, *[c for c in order if c not in by], side, F.when(F.col(side) == paid, F.col(value)).alias(total)).withColumn(total, F.sum(total).over(w))
    return x.groupBy(*by).agg((F.coalesce(F.max(total), F.lit(0.0)) > 0).alias("pays"), F.count_distinct(side).alias("sides"))


def cube_levels(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, level (bits of the keys that are added over), n and mean of every combination of the keys."""
    return rows.cube(*keys).agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))


def key_audit(rows: DataFrame, by: Sequence[str], value: str, member: str, ts: str) -> DataFrame:
    """n, bad (null, NaN or infinite values), members, first and last instant by group."""
    v = F.col(value)
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("bad"), F.count_distinct(member).alias("members"), F.min(ts).alias("first"), F.max(ts).alias("last"))
