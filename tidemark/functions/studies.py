"""Studies of trades and events as whole operators: robustness slices, carry, monthly thresholds, rule scans, validations of subsets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.evaluate import reversal
from tidemark.operators.names import spare
from tidemark.operators.quantiles import beside, with_quantiles
from tidemark.operators.series import cooldown


def ladder(value: Column, steps: Sequence[tuple[float, str]], otherwise: str, unknown: str | None = None, closed: bool = False) -> Column:
    """The label of the first bound that a value is under (closed: at or under), `otherwise` over all of them, `unknown` for null."""
    out = F.when(value.isNull(), F.lit(unknown).cast("string"))
    for bound, label in steps:
        out = out.when(value <= bound if closed else value < bound, label)
    return out.otherwise(otherwise)


def outcome_table(rows: DataFrame, buckets: Mapping[str, Column], value: str) -> DataFrame:
    """n, mean and positive (share over 0) of a value in each combination of the named buckets."""
    return rows.groupBy(*[c.alias(k) for k, c in buckets.items()]).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("int")).alias("positive"))


def robustness_slices(rows: DataFrame, ts: str, value: str, groups: Mapping[str, Column] | None = None, size: str | None = None, signal: str | None = None, thresholds: Sequence[float] = (), horizons: Mapping[str, str] | None = None, drop: int = 0, tie: str | None = None) -> DataFrame:
    """dimension, slice, n, mean and positive of a value, cut in every way in which a result should hold.

    half (before and after the middle instant) and year; each of `groups`; tercile of `size`; threshold: |signal| at or over each; horizon: other return columns; and
    drop: without the `drop` values furthest from 0 (the first by `tie` where they tie). Rows of a null value or time take no part.
    """
    _us, _mid, _q, _d = spare(rows, "_us", "_mid", "_q", "_d")
    x = rows.where(F.col(value).isNotNull() & F.col(ts).isNotNull()).withColumn(_us, F.unix_micros(F.col(ts).cast("timestamp")))
    mid = x.agg(((F.min(_us) + F.max(_us)) / 2).alias(_mid))
    x = x.join(F.broadcast(mid))  # one row
    one = lambda dimension, label, v=F.col(value): F.struct(F.lit(dimension).alias("dimension"), label.cast("string").alias("slice"), v.cast("double").alias("v"))
    cuts = [one("half", F.when(F.col(_us) < F.col(_mid), "first").otherwise("second")), one("year", F.year(ts)), *[one(k, c) for k, c in (groups or {}).items()]]
    if size is not None:
        x = with_quantiles(x, [], size, [1 / 3, 2 / 3], _q)
        cuts.append(one("tercile", F.when(F.col(size) <= F.col(_q)[0], "small").when(F.col(size) <= F.col(_q)[1], "middle").when(F.col(size).isNotNull(), "large")))
    cuts += [one("threshold", F.when(F.abs(signal) >= c, f"{c:g}")) for c in thresholds] if signal is not None else []
    cuts += [one("horizon", F.lit(k), F.col(c)) for k, c in (horizons or {}).items()]
    long = x.select(F.explode(F.array(*cuts)).alias(_d)).select(f"{_d}.*").where("slice IS NOT NULL AND v IS NOT NULL")
    out = outcome_table(long, {"dimension": F.col("dimension"), "slice": F.col("slice")}, "v")
    if drop:
        far = x.select(F.col(value).cast("double").alias("v"), *([tie] if tie else [])).orderBy(F.desc(F.abs("v")), *([tie] if tie else [])).limit(drop)
        signed = x.select(F.col(value).cast("double").alias("v"), F.lit(1).alias("w")).unionByName(far.select("v", F.lit(-1).alias("w")))  # all rows less those few: nothing is sorted whole
        n = F.sum("w")
        out = out.unionByName(signed.agg(F.lit("drop").alias("dimension"), F.lit(f"{drop}").alias("slice"), n.alias("n"), (F.sum(F.col("v") * F.col("w")) / F.nullif(n, F.lit(0))).alias("mean"),
                                         (F.sum(F.when(F.col("v") > 0, F.col("w")).otherwise(0)) / F.nullif(n, F.lit(0))).alias("positive")).where("n > 0"))
    return out


def carry_components(spot: DataFrame, perp: DataFrame, cash: DataFrame, key: str, ts: str, price: str, step_s: int, rate: str, complete: str | None = None) -> DataFrame:
    """What a hedged pair (long the first, short the second) earns from each instant to the one `step_s` later: spot_return, perp_return (of the short), price_component, cash_flow (the rates
    paid at the instant, 0 without), gross, basis and next_basis. Instants at which both sides have a price now and then, and (complete) a full bar now."""
    kind = dict(spot.dtypes)[ts]
    good = F.col(price) > 0
    side = lambda df, name: df.where(good).select(key, ts, F.col(price).alias(name), (F.col(complete) if complete else F.lit(True)).alias(f"{name}_full"))
    both = side(spot, "_s").join(side(perp, "_p"), [key, ts])
    earlier = F.timestamp_micros(F.unix_micros(F.col(ts).cast("timestamp")) - step_s * 1_000_000).cast(kind)
    later = both.select(key, earlier.alias(ts), F.col("_s").alias("_s1"), F.col("_p").alias("_p1"))
    paid = cash.groupBy(key, ts).agg(F.sum(rate).alias("_paid"))
    x = both.where("_s_full AND _p_full").join(later, [key, ts]).join(paid, [key, ts], "left")
    x = x.withColumns({"spot_return": F.col("_s1") / F.col("_s") - 1, "perp_return": -(F.col("_p1") / F.col("_p") - 1), "cash_flow": F.coalesce("_paid", F.lit(0.0))})
    x = x.withColumn("price_component", F.col("spot_return") + F.col("perp_return"))
    return x.select(key, ts, "spot_return", "perp_return", "price_component", "cash_flow", (F.col("price_component") + F.col("cash_flow")).alias("gross"),
                    (F.col("_p") / F.col("_s") - 1).alias("basis"), (F.col("_p1") / F.col("_s1") - 1).alias("next_basis"))


def rolling_cash(monthly: DataFrame, key: str, month: str, value: str, months: int = 12, share: float = 0.8, name: str = "carry") -> DataFrame:
    """monthly with the sum over the last `months` calendar months, where at least `share` of them have a value."""
    w = Window.partitionBy(key).orderBy(F.year(month) * 12 + F.month(month)).rangeBetween(1 - months, 0)
    return monthly.withColumn(name, F.when(F.count(value).over(w) >= F.ceil(F.lit(months * share)), F.sum(value).over(w)))


def month_thresholds(rows: DataFrame, by: Sequence[str], ts: str, bounds: Mapping[str, tuple[str, float]]) -> DataFrame:
    """rows with each named quantile of a column over their group's calendar month: `bounds` maps a name to (column, quantile)."""
    (month,) = spare(rows, "_month")
    x = rows.withColumn(month, F.date_trunc("month", ts))
    cuts = x.groupBy(*by, month).agg(*[F.percentile(c, q).alias(name) for name, (c, q) in bounds.items()])
    return beside(x, cuts, [*by, month]).drop(month)


def threshold_events(rows: DataFrame, key: Sequence[str], ts: str, tie: str, low: tuple[str, float], high: tuple[str, float], score: Column, least: int, seconds: float) -> DataFrame:
    """Rows at or under their month's `low` (column, quantile) quantile and at or over its `high` one, whose rejection score is `least` or more, and that come `seconds` or more after the last such row of their key."""
    a, b, s = spare(rows, "_low", "_high", "_score")
    x = month_thresholds(rows, key, ts, {a: low, b: high})
    x = x.withColumn(s, score).where((F.col(low[0]) <= F.col(a)) & (F.col(high[0]) >= F.col(b)) & (F.col(s) >= least)).drop(a, b, s)
    return cooldown(x, key, ts, seconds, tie)


def rejection_score(open_: str, high: str, low: str, close: str, wick: float = 0.5, location: float = 0.6) -> dict[str, Column]:
    """long and short: how many of two signs a bar gives that a move was rejected: a long wick on the far side, and a close near the other end. 0 for a bar without a range."""
    span = F.nullif(F.col(high) - F.col(low), F.lit(0.0))
    under, over = (F.least(open_, close) - F.col(low)) / span, (F.col(high) - F.greatest(open_, close)) / span
    at = (F.col(close) - F.col(low)) / span
    count = lambda *c: sum((F.coalesce(x.cast("int"), F.lit(0)) for x in c), F.lit(0))
    return {"long": count(under >= wick, at >= location), "short": count(over >= wick, at <= 1 - location)}


def reversal_grid(panel: DataFrame, key: str, order: str, value: str, tie: str, backs: Sequence[int], holds: Sequence[int], tail: float, cost: float) -> DataFrame:
    """back, hold, instants, gross, net, turnover (means over instants) and positive (share of instants with a net over 0) of reversal() for every pair of a lookback and a holding time."""
    out = None
    for b in backs:
        for h in holds:
            x = reversal(panel, key, order, value, tie, b, h, tail, cost).select(F.lit(b).alias("back"), F.lit(h).alias("hold"), "gross", "net", "turnover")
            out = x if out is None else out.unionByName(x)
    return out.groupBy("back", "hold").agg(F.count("net").alias("instants"), F.avg("gross").alias("gross"), F.avg("net").alias("net"), F.avg("turnover").alias("turnover"), F.avg((F.col("net") > 0).cast("int")).alias("positive"))


def rule_scan(rows: DataFrame, rule: str, month: str, member: str, value: str, train: Column, blocked: DataFrame | None = None, months: int = 12, top: float = 0.25, places: int = 6) -> DataFrame:
    """n, train_mean, oos_mean, months, positive_months, top_share and gate of each rule; rules whose sha256 is in `blocked` (column h) are left out.

    gate: strict where all of at least `months` months are positive (sums rounded to `places`), near where all but one are, else fail; crowded where one member has over `top` of all absolute values, whatever its months.
    """
    x = rows
    if blocked is not None:
        x = x.join(F.broadcast(blocked.select("h").distinct()) if blocked.limit(10_001).count() <= 10_000 else blocked.select("h").distinct(), F.sha2(F.col(rule), 256) == F.col("h"), "left_anti")
    m = x.groupBy(rule, month).agg(F.sum(value).alias("_s")).groupBy(rule).agg(F.count(F.lit(1)).alias("months"), F.count(F.when(F.round("_s", places) > 0, 1)).alias("positive_months"))
    k = x.groupBy(rule, member).agg(F.sum(F.abs(value)).alias("_c")).groupBy(rule).agg((F.max("_c") / F.nullif(F.sum("_c"), F.lit(0.0))).alias("top_share"))
    s = x.groupBy(rule).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(train, F.col(value))).alias("train_mean"), F.avg(F.when(~train, F.col(value))).alias("oos_mean"))
    missed = F.col("months") - F.col("positive_months")
    gate = F.when(F.col("top_share") > top, "crowded").when((F.col("months") >= months) & (missed == 0), "strict").when((F.col("months") >= months) & (missed == 1), "near").otherwise("fail")
    return s.join(m, rule).join(k, rule).withColumn("gate", gate)


def threshold_sweep(rows: DataFrame, trade: Sequence[str], signal: str, value: str, cuts: Sequence[float], slack: float = 1e-9) -> DataFrame:
    """cut, n, mean and win_rate of the trades whose |signal| is at or over each cut; a trade that several rows name by the columns `trade` counts once for each different signal and value."""
    x = rows.select(*dict.fromkeys([*trade, signal, value])).distinct()
    x = x.withColumn("cut", F.explode(F.array(*[F.lit(float(c)) for c in cuts]))).where(F.abs(signal) >= F.col("cut") - slack)
    return x.groupBy("cut").agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.avg((F.col(value) > 0).cast("int")).alias("win_rate"))


def subset_validation(rows: DataFrame, by: Sequence[str], member: str, value: str, least: int, share: float, top: float, places: int = 6) -> DataFrame:
    """n, members, positive_members (share whose sum is over 0), top_share and verdict (thin, accept, reject) of each subset, from one sum a member."""
    s = rows.groupBy(*by, member).agg(F.count(F.lit(1)).alias("_n"), F.sum(value).alias("_p"))
    out = s.groupBy(*by).agg(F.sum("_n").alias("n"), F.count(F.lit(1)).alias("members"), F.avg((F.round("_p", places) > 0).cast("int")).alias("positive_members"), (F.max(F.abs("_p")) / F.nullif(F.sum(F.abs("_p")), F.lit(0.0))).alias("top_share"))
    return out.withColumn("verdict", F.when(F.col("n") < least, "thin").when((F.col("positive_members") >= share) & (F.col("top_share") < top), "accept").otherwise("reject"))


def motif_outcomes(rows: DataFrame, key: str, order: Sequence[str], state: str, value: str, length: int, least: int, most: int) -> DataFrame:
    """motif, n and outcome (mean change of the value to the next row) of the `most` commonest runs of `length` states of a key seen at least `least` times."""
    w = Window.partitionBy(key).orderBy(*order)
    parts = [F.lag(state, length - 1 - i).over(w) if i < length - 1 else F.col(state) for i in range(length)]
    x = rows.select(*[p.alias(f"_s{i}") for i, p in enumerate(parts)], (F.lead(value).over(w) - F.col(value)).alias("_o")).dropna(subset=[f"_s{i}" for i in range(length)])
    m = x.groupBy(F.concat_ws(">", *[f"_s{i}" for i in range(length)]).alias("motif")).agg(F.count(F.lit(1)).alias("n"), F.avg("_o").alias("outcome"))
    return m.where(F.col("n") >= least).orderBy(F.desc("n"), "motif").limit(most)


def latest_results(ledger: DataFrame, run: str, validator: str, order: Sequence[str], result: str, validators: Sequence[str], passed: str) -> DataFrame:
    """A row a run: the latest result of each validator (null: none yet) and how many of them passed."""
    v = ledger.groupBy(run, validator).agg(F.max_by(result, F.struct(*order)).alias("_r"))
    return v.groupBy(run).agg(*[F.max(F.when(F.col(validator) == k, F.col("_r"))).alias(k) for k in validators], F.count(F.when(F.col("_r") == passed, 1)).alias("passed"))


def append_results(results: DataFrame, path: str, key: str, order: Sequence[str]) -> None:
    """Results as a hash-chained block of a ledger: each run of a validator adds its rows, and none is ever changed."""
    from tidemark.functions.stats import chained

    payload = [c for c in results.columns if c != key]
    chained(results, key, order, payload).write.mode("append").parquet(path)


def loss_stops(trades: DataFrame, key: str, order: Sequence[str], pnl: str, steps: Sequence[tuple[float, str]], otherwise: str, name: str = "capital", places: int = 6) -> DataFrame:
    """trades with what is left of their capital: the label of the first step whose bound the lowest running sum before the trade has reached."""
    total, worst = spare(trades, "_total", "_worst")
    w = Window.partitionBy(key).orderBy(*order)
    x = trades.withColumn(total, F.round(F.sum(pnl).over(w.rowsBetween(Window.unboundedPreceding, 0)), places))
    x = x.withColumn(worst, F.coalesce(F.min(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    return x.withColumn(name, ladder(F.col(worst), steps, otherwise, closed=True)).drop(total, worst)


def listing_audit(rows: DataFrame, key: str, ts: str, start: Column, end: Column, universe: DataFrame | None = None) -> DataFrame:
    """state, n and never of the members by their first and last rows against a window: late_listing, delisted, both or whole; never: members of the universe (its column `key`) without any row."""
    l = rows.groupBy(key).agg(F.min(ts).alias("_a"), F.max(ts).alias("_b"))
    late, gone = F.col("_a") >= start, F.col("_b") < end
    out = l.groupBy(F.when(late & gone, "both").when(late, "late_listing").when(gone, "delisted").otherwise("whole").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    if universe is None:
        return out.withColumn("never", F.lit(None).cast("long"))
    return out.crossJoin(universe.join(l, key, "left_anti").agg(F.count(F.lit(1)).alias("never")))  # one row
