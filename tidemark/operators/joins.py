"""Causal joins over time: as-of, band, trailing range, exact and calendar offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _us(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, columns: list[str], tolerance_s: float | None = None, forward: bool = False, tie: str | None = None) -> DataFrame:
    """left with the right side's latest row at or before each instant (forward: the first at or after), within a tolerance.

    Both sides are stacked and one sort per key carries the last right row on, so that the cost is one shuffle of n + m rows,
    and no pair is ever formed, in either direction. Among right rows of one instant the one with the largest `tie` counts (forward: smallest). Right columns come as r_*.
    A null key or time on either side matches nothing.
    """
    right = right.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    tie_l, tie_r = (F.lit(None), F.lit(None)) if tie is None else (F.lit(None).cast(dict(right.dtypes)[tie]), F.col(tie))
    packed = F.struct(F.col(ts), *columns)
    kind = right.select(packed.alias("r")).schema["r"].dataType
    side = 0 if forward else 1
    l = left.select(key, _us(F.col(ts)).alias("_t"), F.lit(side).alias("_side"), tie_l.alias("_tie"), F.lit(None).cast(kind).alias("_r"), F.struct(*left.columns).alias("_l"))
    r = right.select(key, _us(F.col(ts)).alias("_t"), F.lit(1 - side).alias("_side"), tie_r.alias("_tie"), packed.alias("_r"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("s")).schema["s"].dataType).alias("_l"))
    # forward is the same carry over the rows in reverse: a frame that ends at the last row would be gone through anew for each row
    order = [F.desc(c) if forward else F.asc(c) for c in ("_t", "_side", "_tie")]
    found = F.last("_r", True).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    known = F.col(key).isNotNull() & F.col("_t").isNotNull()
    out = l.where(known).union(r).withColumn("_f", found).where("_l IS NOT NULL").unionByName(l.where(~known).withColumn("_f", F.lit(None).cast(kind)))
    if tolerance_s is not None:
        out = out.withColumn("_f", F.when(F.abs(F.col("_t") - _us(F.col("_f")[ts])) <= int(tolerance_s * 1e6), F.col("_f")))
    return out.select("_l.*", F.col("_f")[ts].alias("r_" + ts), *[F.col("_f")[c].alias("r_" + c) for c in columns])


def band(left: DataFrame, right: DataFrame, key: str, ts: str, seconds: float, left_cols: list[str], right_cols: list[str]) -> DataFrame:
    """All pairs of one key at most `seconds` apart: equi-joined on the bucket of time and its two neighbours, then checked."""
    width = int(seconds * 1e6)
    l = left.select(key, *[F.col(c).alias("l_" + c) for c in left_cols], _us(F.col(ts)).alias("_tl")).withColumn("_b", F.floor(F.col("_tl") / width))
    r = right.select(key, *[F.col(c).alias("r_" + c) for c in right_cols], _us(F.col(ts)).alias("_tr")).withColumn("_b", F.explode(F.array(*[F.floor(F.col("_tr") / width) + d for d in (-1, 0, 1)])))
    return l.join(r, [key, "_b"]).where(F.abs(F.col("_tl") - F.col("_tr")) <= width).withColumn("distance_s", (F.col("_tr") - F.col("_tl")) / 1e6).drop("_tl", "_tr", "_b")


def trailing(events: DataFrame, facts: DataFrame, key: str, ts: str, value: str, seconds: float) -> DataFrame:
    """events with the sum and count of the facts in [t - seconds, t), by a range frame over the stacked sides: one sort per key, no pairs. A null key or time counts nothing."""
    facts = facts.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
    kind = events.select(F.struct(*events.columns).alias("s")).schema["s"].dataType
    e = events.select(key, _us(F.col(ts)).alias("_t"), F.lit(None).cast("double").alias("_v"), F.struct(*events.columns).alias("_e"))
    f = facts.select(key, _us(F.col(ts)).alias("_t"), F.col(value).cast("double").alias("_v"), F.lit(None).cast(kind).alias("_e"))
    w = Window.partitionBy(key).orderBy("_t").rangeBetween(-int(seconds * 1e6), -1)
    known = F.col(key).isNotNull() & F.col("_t").isNotNull()
    rest = e.where(~known).withColumn("sum_before", F.lit(None).cast("double")).withColumn("n_before", F.lit(0).cast("long"))
    return e.where(known).union(f).withColumn("sum_before", F.sum("_v").over(w)).withColumn("n_before", F.count("_v").over(w)).where("_e IS NOT NULL").unionByName(rest).select("_e.*", F.coalesce("sum_before", F.lit(0.0)).alias("sum_before"), "n_before")


def offset(panel: DataFrame, key: str, ts: str, value: str, shift: Column, name: str) -> DataFrame:
    """panel with the value of the same key at exactly `shift` (an instant computed from the row), null where there is no such row."""
    there = panel.select(F.col(key).alias("_k"), F.col(ts).alias("_t"), F.col(value).alias(name))
    return panel.withColumn("_at", shift).join(there, (F.col(key) == F.col("_k")) & (F.col("_at") == F.col("_t")), "left").drop("_k", "_t", "_at")
