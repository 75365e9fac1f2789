"""Windows over the last or next rows of a key: rolling statistics, ranges, volatilities, regressions, pivots.

Every function partitions by one key and sorts once per key; frames are bounded unless said otherwise. Null values take no part in a statistic.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.folds import true_range
from tidemark.operators.names import spare


def last_rows(key: str, order: str | Sequence[str], n: int, skip: int = 0) -> WindowSpec:
    """The n rows that end `skip` rows before a row (0: with it)."""
    return Window.partitionBy(key).orderBy(*([order] if isinstance(order, str) else order)).rowsBetween(-(n - 1) - skip, -skip)


def rolling(panel: DataFrame, key: str, order: str, value: str, n: int, least: int, prior: bool = False) -> DataFrame:
    """roll_mean, roll_std (of a sample), roll_pstd (of a population), roll_median, roll_min and roll_max of the last n rows (prior: of the n before); null under `least` values."""
    w = last_rows(key, order, n, int(prior))
    enough = F.count(value).over(w) >= least
    made = {"mean": F.avg(value), "std": F.stddev_samp(value), "pstd": F.stddev_pop(value), "median": F.percentile(value, 0.5), "min": F.min(value), "max": F.max(value)}
    return panel.withColumns({f"roll_{k}": F.when(enough, c.over(w)) for k, c in made.items()})


def persistence(panel: DataFrame, key: str, order: str, value: str, n: int, least: int, name: str = "persistence") -> DataFrame:
    """Share of the last n moves whose sign is that of the move before."""
    w = Window.partitionBy(key).orderBy(order)
    sign, same = spare(panel, "_s", "_same")
    out = panel.withColumn(sign, F.signum(F.col(value) - F.lag(value).over(w)))
    out = out.withColumn(same, (F.col(sign) == F.lag(sign).over(w)).cast("double"))
    m = last_rows(key, order, n - 1)
    return out.withColumn(name, F.when(F.count(same).over(m) >= least, F.avg(same).over(m))).drop(sign, same)


def half_ratio(panel: DataFrame, key: str, order: str, value: str, n: int, name: str = "half_ratio") -> DataFrame:
    """Mean of the last n rows over that of the n before; null unless all have values and the second mean is not 0."""
    a, b = last_rows(key, order, n), last_rows(key, order, n, n)
    before = F.when((F.count(value).over(a) == n) & (F.count(value).over(b) == n), F.nullif(F.avg(value).over(b), F.lit(0.0)))
    return panel.withColumn(name, F.avg(value).over(a) / before)


def contiguous(key: str, ts: str, n: int, step_s: float) -> Column:
    """Whether the last n rows of a key stand exactly `step_s` apart."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    first = F.lag(us, n - 1).over(Window.partitionBy(key).orderBy(ts))
    return F.coalesce(us - first == F.lit(int(step_s * 1e6) * (n - 1)), F.lit(False))


def share_momentum(panel: DataFrame, key: str, ts: str, part: str, whole: str, n: int, step_s: float, name: str = "momentum") -> DataFrame:
    """Share part/whole over the last n rows less that over the n before, where all 2n rows are there and contiguous."""
    a, b = last_rows(key, ts, n), last_rows(key, ts, n, n)
    share = lambda w: F.sum(part).over(w) / F.nullif(F.sum(whole).over(w), F.lit(0.0))
    (whole_,) = spare(panel, "_whole")
    return panel.withColumn(whole_, contiguous(key, ts, 2 * n, step_s)).withColumn(name, F.when(F.col(whole_), share(a) - share(b))).drop(whole_)


def excursions(panel: DataFrame, key: str, order: str, entry: str, high: str, low: str, horizon: int) -> DataFrame:
    """Best and worst move of the next `horizon` rows against `entry` in basis points, long and short; null until all rows are there."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(1, horizon)
    full = (F.count(high).over(w) == horizon) & (F.col(entry) != 0)
    up = F.when(full, (F.max(high).over(w) / F.col(entry) - 1) * 10_000)
    down = F.when(full, (F.min(low).over(w) / F.col(entry) - 1) * 10_000)
    return panel.withColumns({"mfe_long": up, "mae_long": down, "mfe_short": -down, "mae_short": -up})


def timed_zscore(panel: DataFrame, key: str, ts: str, value: str, seconds: int, least: int, name: str = "z") -> DataFrame:
    """Distance from the mean of the values in [t - seconds, t), in their standard deviations; null under `least` of them or without spread."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(us).rangeBetween(-int(seconds * 1e6), -1)
    mean, std = F.avg(value).over(w), F.stddev_samp(value).over(w)
    return panel.withColumn(name, F.when((F.count(value).over(w) >= least) & (std > 0), (F.col(value) - mean) / std))


def two_factor(panel: DataFrame, key: str, order: str, y: str, x1: str, x2: str, n: int, most: float = 20.0, flat: float = 1e-12) -> DataFrame:
    """alpha, beta1, beta2 of y on x1 and x2 over the n rows before a row, and the row's residual.

    Sums in one frame and a closed form. Null unless n complete rows come before, the factors are independent (determinant over `flat` times
    the product of their variances) and no |beta| is over `most`.
    """
    w = last_rows(key, order, n, 1)
    whole = F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull()
    # moments around values of the frame keep the sums small
    cov = lambda a, b: F.covar_pop(F.when(whole, F.col(a)), F.when(whole, F.col(b))).over(w)
    mean = lambda a: F.avg(F.when(whole, F.col(a))).over(w)
    names = ("_c11", "_c22", "_c12", "_c1y", "_c2y", "_my", "_m1", "_m2", "_n", "_det")
    made = dict(zip(names, spare(panel, *names), strict=True))
    out = panel.withColumns({made["_c11"]: cov(x1, x1), made["_c22"]: cov(x2, x2), made["_c12"]: cov(x1, x2), made["_c1y"]: cov(x1, y), made["_c2y"]: cov(x2, y), made["_my"]: mean(y), made["_m1"]: mean(x1), made["_m2"]: mean(x2), made["_n"]: F.count(F.when(whole, 1)).over(w)})
    c = lambda s: F.col(made["_c" + s])
    out = out.withColumn(made["_det"], c("11") * c("22") - c("12") * c("12"))
    good = (F.col(made["_n"]) == n) & (F.col(made["_det"]) > flat * c("11") * c("22"))
    out = out.withColumn("beta1", F.when(good, (c("1y") * c("22") - c("2y") * c("12")) / F.col(made["_det"]))).withColumn("beta2", F.when(good, (c("2y") * c("11") - c("1y") * c("12")) / F.col(made["_det"])))
    sane = (F.abs("beta1") <= most) & (F.abs("beta2") <= most)
    out = out.withColumn("alpha", F.when(sane, F.col(made["_my"]) - F.col("beta1") * F.col(made["_m1"]) - F.col("beta2") * F.col(made["_m2"])))
    out = out.withColumns({b: F.when(sane, F.col(b)) for b in ("beta1", "beta2")})
    out = out.withColumn("residual", F.when(whole, F.col(y) - F.col("alpha") - F.col("beta1") * F.col(x1) - F.col("beta2") * F.col(x2)))
    return out.drop(*made.values())


def full_sum(value: str, key: str, order: str, n: int) -> Column:
    """Sum of the last n values; null unless all are there."""
    w = last_rows(key, order, n)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def garman_klass(panel: DataFrame, key: str, ts: str, n: int, step_s: float, name: str = "gk_vol") -> DataFrame:
    """Root of the summed Garman-Klass variances of the last n bars; null where a bar of them is missing, not positive or inverted."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    good = (o > 0) & (l > 0) & (c > 0) & (h >= l)
    term = lambda a, b: F.pow(F.log(F.when(good, a) / F.when(good, b)), F.lit(2))
    gk, whole = spare(panel, "_gk", "_whole")
    out = panel.withColumn(gk, 0.5 * term(h, l) - (2 * F.log(F.lit(2.0)) - 1) * term(c, o)).withColumn(whole, contiguous(key, ts, n, step_s))
    total = full_sum(gk, key, ts, n)
    # greatest skips nulls: a window with a bad bar is none of variance 0
    return out.withColumn(name, F.when(F.col(whole) & total.isNotNull(), F.sqrt(F.greatest(total, F.lit(0.0))))).drop(gk, whole)


def mean_range(panel: DataFrame, key: str, order: str, high: str, low: str, close: str, n: int, name: str = "atr_sma") -> DataFrame:
    """Mean true range of the last n rows that have a row before them."""
    (tr,) = spare(panel, "_tr")
    out = panel.withColumn(tr, F.when(F.lag(close).over(Window.partitionBy(key).orderBy(order)).isNotNull(), true_range(key, [order], high, low, close)))
    return out.withColumn(name, full_sum(tr, key, order, n) / n).drop(tr)


def change(panel: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """`before` (the last value that is not null before a row), `changed` (whether the row's value is another) and `delta`."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = panel.withColumn("before", F.last(value, True).over(w))
    return out.withColumn("delta", F.col(value) - F.col("before")).withColumn("changed", F.col(value).isNotNull() & ~F.col(value).eqNullSafe(F.col("before")))


def transitions(panel: DataFrame, key: str, ts: str, state: str, most_s: float) -> DataFrame:
    """`transition`: the state before and the state, joined by >; null at a key's first row, over a gap of more than `most_s` and over the turn of a month."""
    w = Window.partitionBy(key).orderBy(ts)
    before = F.lag(ts).over(w)
    near = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(before.cast("timestamp")) <= int(most_s * 1e6)
    same = F.date_trunc("month", before) == F.date_trunc("month", F.col(ts))
    return panel.withColumn("transition", F.when(near & same, F.concat_ws(">", F.lag(state).over(w), F.col(state))))


def spikes(panel: DataFrame, key: str, order: str, value: str, n: int, least: int, times: float) -> DataFrame:
    """`prior_median` of the n rows before, and `spike`: whether the value is at least `times` it; false where there is no median."""
    w = last_rows(key, order, n, 1)
    median = F.when(F.count(value).over(w) >= least, F.percentile(value, 0.5).over(w))
    return panel.withColumn("prior_median", median).withColumn("spike", F.coalesce((F.col("prior_median") > 0) & (F.col(value) >= times * F.col("prior_median")), F.lit(False)))


def next_bar_events(panel: DataFrame, key: str, order: str, signal: str, open_: str, hold: int) -> DataFrame:
    """Signal rows with entry (the next row's open), exit (the open `hold` rows later) and ret_bps; rows without both are left out."""
    w = Window.partitionBy(key).orderBy(order)
    out = panel.withColumns({"entry": F.lead(open_, 1).over(w), "exit": F.lead(open_, 1 + hold).over(w), "entry_at": F.lead(order, 1).over(w), "exit_at": F.lead(order, 1 + hold).over(w)})
    return out.where(F.col(signal) & F.col("exit").isNotNull() & (F.col("entry") != 0)).withColumn("ret_bps", (F.col("exit") / F.col("entry") - 1) * 10_000)


def pivots(panel: DataFrame, key: str, order: str, high: str, low: str, left: int, right: int) -> DataFrame:
    """pivot_high and pivot_low as they are known at a row: the last extreme of `left` rows before and `right` rows after it, `right` rows late and carried on."""
    w = Window.partitionBy(key).orderBy(order)
    around = w.rowsBetween(-left, right)
    full = F.count(F.lit(1)).over(around) == left + right + 1
    h, l = spare(panel, "_h", "_l")
    out = panel.withColumn(h, F.when(full & (F.col(high) == F.max(high).over(around)), F.col(high))).withColumn(l, F.when(full & (F.col(low) == F.min(low).over(around)), F.col(low)))
    out = out.withColumn(h, F.lag(h, right).over(w)).withColumn(l, F.lag(l, right).over(w))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("pivot_high", F.last(h, True).over(upto)).withColumn("pivot_low", F.last(l, True).over(upto)).drop(h, l)


def level_crosses(panel: DataFrame, key: str, order: str, average: str, level: str) -> DataFrame:
    """panel with `cross`: up where an average goes from at or under a level to over it, down the other way round; the level is that of the row, as it was known then.

    Null without both at a row and the row before.
    """
    w = Window.partitionBy(key).orderBy(order)
    now, before = F.col(average) - F.col(level), F.lag(F.col(average)).over(w) - F.lag(F.col(level)).over(w)
    return panel.withColumn("cross", F.when((before <= 0) & (now > 0), "up").when((before >= 0) & (now < 0), "down"))


def liquidity_pull(panel: DataFrame, key: str, order: str, depth: str, n: int) -> DataFrame:
    """`pull`: what the depth lost since the last row that had one; `pull_mean` and `pull_std` of the last n pulls, which rows without a depth do not move."""
    none = panel.where(F.col(depth).isNull()).withColumns({c: F.lit(None).cast("double") for c in ("pull", "pull_mean", "pull_std")})
    some = panel.where(F.col(depth).isNotNull())
    some = some.withColumn("pull", F.greatest(F.lag(depth).over(Window.partitionBy(key).orderBy(order)) - F.col(depth), F.lit(0.0)))
    some = some.withColumn("pull", F.when(F.lag(depth).over(Window.partitionBy(key).orderBy(order)).isNotNull(), F.col("pull")))
    w, upto = last_rows(key, order, n), Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    some = some.withColumn("pull_mean", F.avg("pull").over(w)).withColumn("pull_std", F.stddev_pop("pull").over(w))
    both = some.unionByName(none)
    return both.withColumns({c: F.last(c, True).over(upto) for c in ("pull_mean", "pull_std")})


def regime(panel: DataFrame, key: str, ts: str, close: str, average: str, n: int, flat: float) -> DataFrame:
    """bull, bear or range: the close against an average, and its return over n rows beyond `flat` the same way; unknown without both."""
    ret = F.col(close) / F.nullif(F.lag(close, n).over(Window.partitionBy(key).orderBy(ts)), F.lit(0.0)) - 1
    (_ret,) = spare(panel, "_ret")
    out = panel.withColumn(_ret, ret)
    state = F.when(F.col(_ret).isNull() | F.col(average).isNull(), "unknown").when((F.col(close) > F.col(average)) & (F.col(_ret) > flat), "bull").when((F.col(close) < F.col(average)) & (F.col(_ret) < -flat), "bear")
    return out.withColumn("regime", state.otherwise("range")).drop(_ret)
