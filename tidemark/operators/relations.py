"""Joins and set operations beyond joins.py: matching, merging of sources, inventories, duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import carried
from tidemark.operators.joins import asof, band


def _us(c: Column | str) -> Column:
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def asof_lagged(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], lag_s: float, tolerance_s: float | None = None, tie: str | None = None) -> DataFrame:
    """asof() to what was known `lag_s` before each instant, with `looks_ahead`: whether the row found is later than that (never true; a check for tests and audits)."""
    shifted = right.withColumn(ts, F.timestamp_micros(_us(ts) + int(lag_s * 1e6)).cast(dict(right.dtypes)[ts]))
    out = asof(left, shifted, key, ts, columns, tolerance_s, tie=tie)
    return out.withColumn("looks_ahead", F.coalesce(F.col(f"r_{ts}") > F.col(ts), F.lit(False)))


def in_snapshots(facts: DataFrame, snapshots: DataFrame, key: str, ts: str, aggregates: Sequence[Column]) -> DataFrame:
    """Aggregates of the facts by the latest snapshot at or before each; facts before a key's first snapshot go."""
    there = snapshots.select(key, ts).distinct()
    found = asof(facts, there, key, ts, []).where(F.col(f"r_{ts}").isNotNull())
    return found.groupBy(key, F.col(f"r_{ts}").alias(ts)).agg(*aggregates)


def delayed_return(events: DataFrame, prices: DataFrame, key: str, ts: str, price: str, delay_s: float, horizon_s: float, tie: str) -> DataFrame:
    """events with p0 (the first price at or after t + delay), p1 (the first at or after t + delay + horizon), before (the last at or before t) and ret_bps."""
    kind = dict(events.dtypes)[ts]
    at = lambda s: F.timestamp_micros(F.col("_us") + int(s * 1e6)).cast(kind)
    out = asof(events, prices, key, ts, [price], tie=tie).withColumnRenamed(f"r_{price}", "before").drop(f"r_{ts}").withColumn("_us", _us(ts)).withColumn("_at", F.col(ts))
    for name, s in (("p0", delay_s), ("p1", delay_s + horizon_s)):
        out = asof(out.withColumn(ts, at(s)), prices, key, ts, [price], forward=True, tie=tie).withColumnRenamed(f"r_{price}", name).drop(f"r_{ts}")
    return out.withColumn(ts, F.col("_at")).drop("_at", "_us").withColumn("ret_bps", (F.col("p1") / F.nullif(F.col("p0"), F.lit(0.0)) - 1) * 10_000)


def greedy_pairs(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: float, l_id: str, r_id: str) -> DataFrame:
    """One-to-one pairs at most `seconds` apart: the nearest first (then the smaller ids), each row in one pair at most.

    Rows over a pause of more than `seconds` never meet, so a key is cut there, and only what lies between two pauses is matched in sequence.
    """
    side = lambda df, id_, s: df.select(key, ts, F.col(id_).alias("id"), F.lit(s).alias("side")).where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    w = Window.partitionBy(key).orderBy("_us")
    both = side(left, l_id, 0).unionByName(side(right, r_id, 1)).withColumn("_us", _us(ts))
    both = both.withColumn("_new", F.coalesce((F.col("_us") - F.lag("_us").over(w) > int(seconds * 1e6)).cast("long"), F.lit(0)))
    both = both.withColumn("_burst", F.struct(key, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n")))
    pairs = band(both.where("side = 0"), both.where("side = 1"), "_burst", ts, seconds, ["id"], ["id"])
    pairs = pairs.select(F.col("_burst")[key].alias(key), F.col("_burst")["n"].alias("burst"), "l_id", "r_id", "distance_s", F.abs("distance_s").alias("_d"))

    def step(state, l, r):
        used_l, used_r = state
        free = l not in used_l and r not in used_r
        if free:
            used_l.add(l)
            used_r.add(r)
        return state, (free,)

    out = carried(pairs, [key, "burst"], ["_d", "l_id", "r_id"], ["l_id", "r_id"], "free boolean", lambda: (set(), set()), step)
    return out.where("free").select(key, "l_id", "r_id", "distance_s")


def around(events: DataFrame, facts: DataFrame, key: str, ts: str, value: str, before_s: float, after_s: float) -> DataFrame:
    """events with sum_around and n_around of the facts in [t - before, t + after]: a range frame over the stacked sides, no pairs. A null key or time counts nothing."""
    kind = events.select(F.struct(*events.columns).alias("s")).schema["s"].dataType
    e = events.select(key, _us(ts).alias("_t"), F.lit(None).cast("double").alias("_v"), F.struct(*events.columns).alias("_e"))
    f = facts.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, _us(ts).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(kind).alias("_e"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-int(before_s * 1e6), int(after_s * 1e6))
    known = F.col(key).isNotNull() & F.col("_t").isNotNull()
    made = e.where(known).unionByName(f).withColumn("sum_around", F.coalesce(F.sum("_v").over(w), F.lit(0.0))).withColumn("n_around", F.count("_v").over(w)).where("_e IS NOT NULL")
    rest = e.where(~known).withColumn("sum_around", F.lit(0.0)).withColumn("n_around", F.lit(0).cast("long"))
    return made.unionByName(rest).select("_e.*", "sum_around", "n_around")


def trailing_windows(snapshots: DataFrame, facts: DataFrame, key: str, ts: str, value: str, sign: Column, seconds: Sequence[int], large: float) -> DataFrame:
    """snapshots with, for each window (t - s, t]: count, sum, signed sum, imbalance, mean, max and count of large values of the facts; one sort per key for all windows."""
    kind = snapshots.select(F.struct(*snapshots.columns).alias("s")).schema["s"].dataType
    e = snapshots.select(key, _us(ts).alias("_t"), F.lit(None).cast("double").alias("_v"), F.lit(None).cast("double").alias("_s"), F.struct(*snapshots.columns).alias("_e"))
    f = facts.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(key, _us(ts).alias("_t"), F.col(value).cast("double").alias("_v"), (F.col(value) * sign).cast("double").alias("_s"), F.lit(None).cast(kind).alias("_e"))
    made = {}
    for s in seconds:
        w = Window.partitionBy(key).orderBy("_t").rangeBetween(-int(s * 1e6) + 1, 0)
        total, signed = F.coalesce(F.sum("_v").over(w), F.lit(0.0)), F.coalesce(F.sum("_s").over(w), F.lit(0.0))
        made |= {f"count_{s}": F.count("_v").over(w), f"sum_{s}": total, f"signed_{s}": signed, f"imbalance_{s}": signed / F.nullif(total, F.lit(0.0)), f"mean_{s}": F.avg("_v").over(w), f"max_{s}": F.max("_v").over(w), f"large_{s}": F.count(F.when(F.col("_v") >= large, 1)).over(w)}
    return e.where(F.col(key).isNotNull() & F.col("_t").isNotNull()).unionByName(f).withColumns(made).where("_e IS NOT NULL").select("_e.*", *made)


def forward_moves(rows: DataFrame, key: str, ts: str, price: str, seconds: int, tie: str) -> DataFrame:
    """rows with fwd_bps (to the first row at or after t + seconds), best_bps and worst_bps (over (t, t + seconds])."""
    us = _us(ts)
    w = Window.partitionBy(key).orderBy(us).rangeBetween(1, int(seconds * 1e6))
    p = F.col(price)
    move = lambda x: (x / F.nullif(p, F.lit(0.0)) - 1) * 10_000
    out = rows.withColumns({"best_bps": move(F.max(price).over(w)), "worst_bps": move(F.min(price).over(w))})
    kind = dict(rows.dtypes)[ts]
    there = rows.select(key, ts, F.col(price).alias("_p"), F.col(tie).alias("_tie"))
    out = asof(out.withColumn("_at", F.col(ts)).withColumn(ts, F.timestamp_micros(us + int(seconds * 1e6)).cast(kind)), there, key, ts, ["_p"], forward=True, tie="_tie")
    return out.withColumn(ts, F.col("_at")).withColumn("fwd_bps", move(F.col("r__p"))).drop("_at", "r__p", f"r_{ts}")


def merge_sources(sources: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key of any source, with all their columns (the largest value where a source repeats a key) and `sources`, the names that have it.

    The parts are stacked and aggregated in one shuffle, instead of n full joins.
    """
    parts = [df.withColumn("_from", F.lit(name)) for name, df in sources.items()]
    columns = list(dict.fromkeys(c for df in sources.values() for c in df.columns if c not in keys))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in columns], F.array_join(F.sort_array(F.collect_set("_from")), ",").alias("sources"))


def inventory(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key of either side once, with `where`: both, left or right."""
    both = left.select(*keys, F.lit(1).alias("_s")).unionByName(right.select(*keys, F.lit(2).alias("_s"))).groupBy(*keys).agg(F.bit_or("_s").alias("_s"))
    return both.select(*keys, F.when(F.col("_s") == 3, "both").when(F.col("_s") == 1, "left").otherwise("right").alias("where"))


def intersected(left: DataFrame, right: DataFrame, key: str, ts: str, step_s: int, value: str) -> DataFrame:
    """Instants that both sides hold, with both values and the left value one step later (null where it is missing)."""
    l, r = left.select(key, ts, F.col(value).alias("l_value")), right.select(key, ts, F.col(value).alias("r_value"))
    later = left.select(key, F.timestamp_micros(_us(ts) - step_s * 1_000_000).cast(dict(left.dtypes)[ts]).alias(ts), F.col(value).alias("next_value"))
    return l.join(r, [key, ts]).join(later, [key, ts], "left")


def match_rate(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """n and rate of the left rows whose keys the right side holds, by group."""
    there = right.select(*keys).distinct().withColumn("_there", F.lit(1.0))
    return left.join(there, list(keys), "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce("_there", F.lit(0.0))).alias("rate"))


def marked_to_market(positions: DataFrame, prices: DataFrame, key: str, ts: str, price: str, tie: str, entry: str, side: str) -> DataFrame:
    """positions with their key's latest price (`mark`) and the return on their side in basis points."""
    last = prices.groupBy(key).agg(F.max_by(price, F.struct(ts, tie)).alias("mark"))
    move = F.col("mark") / F.nullif(F.col(entry), F.lit(0.0)) - 1
    return positions.join(last, key, "left").withColumn("mtm_bps", F.when(F.col(side) == "short", -move).otherwise(move) * 10_000)


def duplicates(rows: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys that repeat: times, versions (different values) and `kind`, exact or conflicting."""
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times"), F.count_distinct(F.struct(*values)).alias("versions")).where("times > 1")
    return out.withColumn("kind", F.when(F.col("versions") > 1, "conflicting").otherwise("exact"))


def resolved(rows: DataFrame, keys: Sequence[str], order: Sequence[str], policy: str = "last") -> DataFrame:
    """One row a key: the last in order, or (policy 'agree') only keys whose rows are all equal."""
    whole = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in order])
    best = rows.groupBy(*keys).agg(F.max(whole).alias("_r"), F.min(whole).alias("_s"))
    if policy == "agree":
        best = best.where("_r = _s")
    return best.select(*[F.col("_r")[c].alias(c) for c in rows.columns])


def collapsed(rows: DataFrame, key: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row a key with each column's last value that is not null."""
    at = F.struct(*order)
    return rows.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in columns])


def apart(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side only (each once), with `side`."""
    return left.exceptAll(right).distinct().withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).distinct().withColumn("side", F.lit("right")))


def graded(rows: DataFrame, grid: DataFrame, condition: Column, by: Sequence[str], value: str) -> DataFrame:
    """n, mean and total of the rows that meet each rule of a grid (a table of a few hundred rules at most, broadcast): one conditional aggregate over rules x rows."""
    most = 10_000
    if grid.limit(most + 1).count() > most:
        raise ValueError(f"a grid has at most {most} rules")
    return rows.join(F.broadcast(grid), condition).groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
