"""Evaluation of signals and trades: splits, folds, months, costs, exits, thresholds, verdicts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import beside
from tidemark.operators.quantiles import quantiles as exact


def split_of(entry: str, exit_: str, windows: Mapping[str, tuple[str, str]]) -> tuple[Column, Column]:
    """(split, crosses): the half-open window [from, to) an entry lies in (null: in none), and whether the exit lies beyond it."""
    split, crosses = F.lit(None).cast("string"), F.lit(False)
    for name, (a, b) in reversed(list(windows.items())):
        inside = (F.col(entry) >= F.lit(a).cast("timestamp_ntz")) & (F.col(entry) < F.lit(b).cast("timestamp_ntz"))
        split = F.when(inside, name).otherwise(split)
        crosses = F.when(inside, F.col(exit_) >= F.lit(b).cast("timestamp_ntz")).otherwise(crosses)
    return split, crosses


def expanding_months(rows: DataFrame, month: str, value: str, least: int) -> DataFrame:
    """A fold per month with at least `least` months before it: train_n and train_mean of all months before, test_n and test_mean of its own; from monthly sums."""
    m = rows.groupBy(month).agg(F.count(value).alias("test_n"), F.sum(value).alias("_s"))
    w = Window.orderBy(month).rowsBetween(Window.unboundedPreceding, -1)  # one row a month
    m = m.withColumns({"train_n": F.sum("test_n").over(w), "_t": F.sum("_s").over(w), "_k": F.count(F.lit(1)).over(w)}).where(F.col("_k") >= least)
    return m.select(month, "train_n", (F.col("_t") / F.nullif(F.col("train_n"), F.lit(0))).alias("train_mean"), "test_n", (F.col("_s") / F.nullif(F.col("test_n"), F.lit(0))).alias("test_mean"))


def verdicts(folds: DataFrame, least_n: int, share: float) -> DataFrame:
    """Folds with `status`: thin, pass (train and test means of one sign, not 0) or fail; and `verdict`, whether that share of all that are not thin pass."""
    same = (F.signum("train_mean") == F.signum("test_mean")) & (F.col("test_mean") != 0)
    out = folds.withColumn("status", F.when(F.col("test_n") < least_n, "thin").when(same, "pass").otherwise("fail"))
    rate = out.agg((F.count(F.when(F.col("status") == "pass", 1)) / F.nullif(F.count(F.when(F.col("status") != "thin", 1)), F.lit(0))).alias("_rate"))
    return out.crossJoin(F.broadcast(rate)).withColumn("verdict", F.when(F.coalesce(F.col("_rate") >= share, F.lit(False)), "robust").otherwise("weak")).drop("_rate")  # one row


def canonical_months(rows: DataFrame, month: str, share: float, most: int) -> DataFrame:
    """The `most` months with the most rows among those with at least `share` of the median month's rows (the earlier first where they tie)."""
    m = rows.groupBy(month).agg(F.count(F.lit(1)).alias("n"))
    mid = m.agg(F.percentile("n", 0.5).alias("_q"))
    return m.crossJoin(F.broadcast(mid)).where(F.col("n") >= share * F.col("_q")).orderBy(F.desc("n"), month).limit(most).select(month, "n")  # one row


def monthly_rates(rows: DataFrame, by: Sequence[str], month: str, value: str, least: int) -> DataFrame:
    """months, positive_rate, and the same over months of at least `least` values, worst and best month by group."""
    m = rows.groupBy(*by, month).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    full = F.col("_n") >= least
    return m.groupBy(*by).agg(F.count(F.lit(1)).alias("months"), F.avg((F.col("_s") > 0).cast("int")).alias("positive_rate"), F.count(F.when(full, 1)).alias("full_months"),
                              F.avg(F.when(full, (F.col("_s") > 0).cast("int"))).alias("full_positive_rate"), F.min("_s").alias("worst"), F.max("_s").alias("best"))


def cost_grid(rows: DataFrame, by: Sequence[str], gross_bps: str, costs: Sequence[float]) -> DataFrame:
    """cost, n, net_mean, win_rate and survives by group and cost, and break_even, the cost at which nothing is left; one pass over the rows."""
    x = rows.withColumn("cost", F.explode(F.array(*[F.lit(float(c)) for c in costs]))).withColumn("_net", F.col(gross_bps) - F.col("cost"))
    return x.groupBy(*by, "cost").agg(F.count("_net").alias("n"), F.avg("_net").alias("net_mean"), F.avg((F.col("_net") > 0).cast("int")).alias("win_rate"), F.avg(gross_bps).alias("break_even")).withColumn("survives", F.col("net_mean") > 0)


def delay_grid(rows: DataFrame, by: Sequence[str], key: str, order: str, price: str, delays: Sequence[int], hold: int, costs: Sequence[float]) -> DataFrame:
    """delay, cost, n, net_mean and survives: entry `delay` rows late, exit `hold` rows after it."""
    w = Window.partitionBy(key).orderBy(order)
    ret = lambda k: (F.lead(price, k + hold).over(w) / F.nullif(F.lead(price, k).over(w) if k else F.col(price), F.lit(0.0)) - 1) * 10_000
    x = rows.withColumns({f"_r{k}": ret(k) for k in delays})
    x = x.select(*by, F.explode(F.array(*[F.struct(F.lit(k).alias("delay"), F.col(f"_r{k}").alias("g")) for k in delays])).alias("s")).select(*by, "s.delay", "s.g").where("g IS NOT NULL")
    return cost_grid(x, [*by, "delay"], "g", costs).drop("win_rate", "break_even")


def exit_shapes(mfe: str, mae: str, close_ret: str, take: float, stop: float, side: Column) -> dict[str, Column]:
    """What three exits make of an event, in its own units: held to the end; take and stop, where a stop counts first if both are hit; and a stop at 0 once half the take was reached."""
    up, down, end = F.when(side == "short", -F.col(mae)).otherwise(F.col(mfe)), F.when(side == "short", -F.col(mfe)).otherwise(F.col(mae)), F.when(side == "short", -F.col(close_ret)).otherwise(F.col(close_ret))
    return {"fixed_hold": end, "stop_first": F.when(down <= -stop, F.lit(-float(stop))).when(up >= take, F.lit(float(take))).otherwise(end),
            "break_even": F.when(up >= take, F.lit(float(take))).when((up >= take / 2) & (end < 0), F.lit(0.0)).when(down <= -stop, F.lit(-float(stop))).otherwise(end)}


def threshold_scan(rows: DataFrame, features: Sequence[str], label: str, quantiles: Sequence[float]) -> DataFrame:
    """feature, quantile, direction, n, inside, outside and separation (difference of the label's means on either side of the feature's quantile)."""
    long = rows.select(F.col(label).cast("double").alias("_y"), F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("s")).select("_y", "s.*").where("v IS NOT NULL AND _y IS NOT NULL")
    cuts = exact(long, ["feature"], "v", quantiles).withColumnRenamed("q", "_q")
    cuts = cuts.select("feature", F.explode(F.arrays_zip(F.array(*[F.lit(q) for q in quantiles]).alias("q"), F.col("_q").alias("cut"))).alias("s")).select("feature", F.col("s.q").alias("quantile"), F.col("s.cut").alias("cut"))
    x = long.join(F.broadcast(cuts), "feature")  # features x quantiles
    out = x.groupBy("feature", "quantile").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("v") >= F.col("cut"), F.col("_y"))).alias("high"), F.avg(F.when(F.col("v") < F.col("cut"), F.col("_y"))).alias("low"))
    both = out.withColumn("s", F.explode(F.array(F.struct(F.lit("high").alias("direction"), F.col("high").alias("inside"), F.col("low").alias("outside")), F.struct(F.lit("low").alias("direction"), F.col("low").alias("inside"), F.col("high").alias("outside")))))
    return both.select("feature", "quantile", "s.direction", "n", "s.inside", "s.outside", (F.col("s.inside") - F.col("s.outside")).alias("separation"))


def return_stats(rows: DataFrame, by: Sequence[str], ret: str, quantiles: Mapping[str, float]) -> DataFrame:
    """events, n, missing (without a return), mean, std (of a population), shares above and below 0, and quantiles by group."""
    v = F.col(ret)
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("events"), F.count(v).alias("n"), F.count(F.when(v.isNull(), 1)).alias("missing"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
                                F.avg((v > 0).cast("int")).alias("positive"), F.avg((v < 0).cast("int")).alias("negative"))
    cuts = exact(rows, by, ret, list(quantiles.values())).select(*by, *[F.col("q")[i].alias(name) for i, name in enumerate(quantiles)])
    return beside(out, cuts, by)


def effects(rows: DataFrame, by: Sequence[str], sub: Sequence[str], category: str, baseline: str, value: str) -> DataFrame:
    """effect of each category against the baseline category and against all rows, and the share of sub-groups whose effect has the same sign."""
    parts = rows.groupBy(*by, *sub, category).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))

    def effect(keys: list[str]) -> DataFrame:
        g = parts.groupBy(*keys, category).agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
        a = g.groupBy(*keys).agg((F.sum("_s") / F.sum("_n")).alias("_all"), F.max(F.when(F.col(category) == baseline, F.col("_s") / F.col("_n"))).alias("_base"))
        m = F.col("_s") / F.col("_n")
        joined = g.where(F.col("_n") > 0).join(a, keys) if keys else g.where(F.col("_n") > 0).crossJoin(F.broadcast(a))  # one row
        return joined.where(F.col(category) != baseline).select(*keys, category, F.col("_n").alias("n"), (m - F.col("_base")).alias("vs_baseline"), (m - F.col("_all")).alias("vs_all"))

    whole, each = effect(list(by)), effect([*by, *sub]).withColumnRenamed("vs_baseline", "_e").drop("n", "vs_all")
    rate = each.join(whole, [*by, category]).where("_e IS NOT NULL").groupBy(*by, category).agg(F.avg((F.signum("_e") == F.signum("vs_baseline")).cast("int")).alias("sign_match"), F.count(F.lit(1)).alias("groups"))
    return whole.join(rate, [*by, category], "left")


def guard_search(rows: DataFrame, guards: Mapping[str, Column], pnl: str, bad: Column) -> DataFrame:
    """guard, kept, pnl_kept, delta (against no guard) and bad_removed (share of the bad rows that it takes out): one pass over the rows."""
    long = rows.withColumn("_bad", bad).select(F.col(pnl).alias("_p"), "_bad", F.explode(F.array(*[F.struct(F.lit(k).alias("guard"), F.coalesce(c, F.lit(False)).alias("keep")) for k, c in guards.items()])).alias("s")).select("_p", "_bad", "s.*")
    kept = F.coalesce(F.sum(F.when(F.col("keep"), F.col("_p"))), F.lit(0.0))
    return long.groupBy("guard").agg(F.count(F.when(F.col("keep"), 1)).alias("kept"), kept.alias("pnl_kept"), (kept - F.sum("_p")).alias("delta"), (F.count(F.when(F.col("_bad") & ~F.col("keep"), 1)) / F.nullif(F.count(F.when(F.col("_bad"), 1)), F.lit(0))).alias("bad_removed"))


def reversal(panel: DataFrame, key: str, order: str, value: str, tie: str, back: int, hold: int, tail: float, cost: float) -> DataFrame:
    """Per instant of a cross-sectional reversal: the losers of the last `back` rows against the winners, held for `hold` rows: n, gross, turnover (of equal weights) and net of cost times turnover.

    Rows count where all `hold` rows after them exist.
    """
    w = Window.partitionBy(key).orderBy(order)
    x = panel.withColumns({"_past": F.col(value) / F.nullif(F.lag(value, back).over(w), F.lit(0.0)) - 1, "_next": F.lead(value, hold).over(w) / F.nullif(F.col(value), F.lit(0.0)) - 1}).where("_past IS NOT NULL AND _next IS NOT NULL")
    s = Window.partitionBy(order)
    k = F.greatest(F.floor(F.count(F.lit(1)).over(s) * tail), F.lit(1))
    x = x.withColumns({"_k": k, "_up": F.row_number().over(s.orderBy(F.asc("_past"), tie)), "_down": F.row_number().over(s.orderBy(F.desc("_past"), tie))})
    x = x.withColumn("_w", F.when(F.col("_up") <= F.col("_k"), 0.5 / F.col("_k")).otherwise(0.0) - F.when(F.col("_down") <= F.col("_k"), 0.5 / F.col("_k")).otherwise(0.0))
    times = x.select(order).distinct().withColumn("_then", F.lead(order).over(Window.orderBy(order)))  # one row an instant
    held = x.where("_w <> 0").select(order, key, F.col("_w"))
    gone = held.join(times, order).where("_then IS NOT NULL").select(F.col("_then").alias(order), key, (-F.col("_w")).alias("_w"))
    turnover = held.unionByName(gone).groupBy(order, key).agg(F.sum("_w").alias("_c")).groupBy(order).agg(F.sum(F.abs("_c")).alias("turnover"))
    gross = x.groupBy(order).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_w") * F.col("_next")).alias("gross"))
    return gross.join(turnover, order).withColumn("net", F.col("gross") - cost * F.col("turnover"))
