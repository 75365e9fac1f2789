"""Queries of windows over the rows of a key."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import folds, rolling, series, tables
from tidemark.plans.registry import BARS, bars, query, r, t

_K = ["event_type", "bar"]
_W = "PARTITION BY event_type ORDER BY bar"
_B = f"WITH b AS ({BARS})"
_AT = "event_type, bar::TIMESTAMP AS bar"


@query(f"""{_B} SELECT {_AT}, CASE WHEN k >= 6 THEN round(m, 6) END AS roll_mean, CASE WHEN k >= 6 THEN round(s, 6) END AS roll_std, CASE WHEN k >= 6 THEN round(q, 6) END AS roll_median, CASE WHEN k >= 6 THEN hi END AS roll_max
FROM (SELECT *, count(close) OVER w AS k, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, quantile_cont(close, 0.5) OVER w AS q, max(close) OVER w AS hi FROM b WINDOW w AS ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))""")
def rolling_stats(spark, d):
    out = rolling.rolling(bars(spark, d), *_K, "close", 12, 6)
    return out.select(*_K, r("roll_mean"), r("roll_std"), r("roll_median"), "roll_max")


@query(f"""{_B} SELECT {_AT}, CASE WHEN count(close) OVER w = 10 THEN round(avg(close) OVER w, 6) END AS sma FROM b WINDOW w AS ({_W} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""")
def simple_average(spark, d):
    return rolling.rolling(bars(spark, d), *_K, "close", 10, 10).select(*_K, r("roll_mean", "sma"))


@query(f"""{_B}, s AS (SELECT *, sign(close - lag(close) OVER ({_W})) AS s FROM b), m AS (SELECT *, (s = lag(s) OVER ({_W}))::INTEGER::DOUBLE AS same FROM s)
SELECT {_AT}, CASE WHEN count(same) OVER w >= 12 THEN round(avg(same) OVER w, 6) END AS persistence FROM m WINDOW w AS ({_W} ROWS BETWEEN 22 PRECEDING AND CURRENT ROW)""")
def trend_persistence(spark, d):
    return rolling.persistence(bars(spark, d), *_K, "close", 24, 12).select(*_K, r("persistence"))


@query(f"""{_B} SELECT {_AT}, CASE WHEN count(total) OVER a = 6 AND count(total) OVER p = 6 THEN round(avg(total) OVER a / nullif(avg(total) OVER p, 0), 6) END AS half_ratio
FROM b WINDOW a AS ({_W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW), p AS ({_W} ROWS BETWEEN 11 PRECEDING AND 6 PRECEDING)""")
def half_window_ratio(spark, d):
    return rolling.half_ratio(bars(spark, d), *_K, "total", 6).select(*_K, r("half_ratio"))


@query(f"""{_B} SELECT {_AT}, CASE WHEN bar - lag(bar, 7) OVER ({_W}) = INTERVAL 7 HOUR THEN round(sum(high) OVER a / nullif(sum(total) OVER a, 0) - sum(high) OVER p / nullif(sum(total) OVER p, 0), 6) END AS momentum
FROM b WINDOW a AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), p AS ({_W} ROWS BETWEEN 7 PRECEDING AND 4 PRECEDING)""")
def share_momentum(spark, d):
    return rolling.share_momentum(bars(spark, d), *_K, "high", "total", 4, 3600).select(*_K, r("momentum"))


@query(f"""{_B}, x AS (SELECT *, count(high) OVER w = 6 AND close <> 0 AS whole, max(high) OVER w AS hi, min(low) OVER w AS lo FROM b WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT {_AT}, CASE WHEN whole THEN round((hi / close - 1) * 10000, 4) END AS mfe_long, CASE WHEN whole THEN round((lo / close - 1) * 10000, 4) END AS mae_long, CASE WHEN whole THEN round(-(lo / close - 1) * 10000, 4) END AS mfe_short FROM x""")
def excursions_bps(spark, d):
    return rolling.excursions(bars(spark, d), *_K, "close", "high", "low", 6).select(*_K, r("mfe_long", places=4), r("mae_long", places=4), r("mfe_short", places=4))


@query(f"""{_B}, x AS (SELECT *, count(close) OVER w AS k, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s FROM b WINDOW w AS ({_W} RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING))
SELECT {_AT}, CASE WHEN k >= 8 AND s > 0 THEN round((close - m) / s, 6) END AS z FROM x""")
def zscore_prior_day(spark, d):
    return rolling.timed_zscore(bars(spark, d), *_K, "close", 86_400, 8).select(*_K, r("z"))


_W2 = f"WINDOW w AS ({_W} ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)"


@query(f"""{_B}, m AS (SELECT *, count(*) OVER w AS k, covar_pop(open, open) OVER w AS a, covar_pop(total, total) OVER w AS b2, covar_pop(open, total) OVER w AS c, covar_pop(open, close) OVER w AS y1, covar_pop(total, close) OVER w AS y2,
 avg(close) OVER w AS my, avg(open) OVER w AS m1, avg(total) OVER w AS m2 FROM b {_W2}), e AS (SELECT *, a * b2 - c * c AS det FROM m),
f AS (SELECT *, CASE WHEN k = 30 AND det > 1e-12 * a * b2 THEN (y1 * b2 - y2 * c) / det END AS beta1, CASE WHEN k = 30 AND det > 1e-12 * a * b2 THEN (y2 * a - y1 * c) / det END AS beta2 FROM e),
g AS (SELECT *, CASE WHEN abs(beta1) <= 20 AND abs(beta2) <= 20 THEN close - (my - beta1 * m1 - beta2 * m2) - beta1 * open - beta2 * total END AS residual FROM f)
SELECT {_AT}, CASE WHEN residual IS NOT NULL THEN round(beta1, 5) END AS beta1, CASE WHEN residual IS NOT NULL THEN round(beta2, 5) END AS beta2, round(residual, 4) AS residual,
 CASE WHEN count(residual) OVER v = 4 THEN round(sum(residual) OVER v, 4) END AS residual_4 FROM g WINDOW v AS ({_W} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)""")
def two_factor_residuals(spark, d):
    out = rolling.two_factor(bars(spark, d), *_K, "close", "open", "total", 30)
    return out.select(*_K, r("beta1", places=5), r("beta2", places=5), r("residual", places=4), r(rolling.full_sum("residual", *_K, 4), "residual_4", 4))


@query(f"""{_B}, g AS (SELECT *, CASE WHEN open > 0 AND low > 0 AND close > 0 AND high >= low THEN 0.5 * ln(high / low) ** 2 - (2 * ln(2.0::DOUBLE) - 1) * ln(close / open) ** 2 END AS gk FROM b)
SELECT {_AT}, CASE WHEN bar - lag(bar, 11) OVER ({_W}) = INTERVAL 11 HOUR AND count(gk) OVER w = 12 THEN round(sqrt(greatest(sum(gk) OVER w, 0)), 6) END AS gk_vol FROM g WINDOW w AS ({_W} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def garman_klass(spark, d):
    return rolling.garman_klass(bars(spark, d), *_K, 12, 3600).select(*_K, r("gk_vol"))


@query(f"""WITH RECURSIVE b AS ({BARS}), p AS (SELECT *, lag(close) OVER ({_W}) AS pc, row_number() OVER ({_W}) AS k FROM b), x AS (SELECT *, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr FROM p),
s AS (SELECT *, CASE WHEN count(pc) OVER w = 14 THEN avg(tr) OVER w END AS sma, avg(tr) OVER (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS seed FROM x WINDOW w AS ({_W} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
e AS (SELECT event_type, k, seed AS atr FROM s WHERE k = 14 UNION ALL SELECT s.event_type, s.k, s.tr * (1 / 14.0::DOUBLE) + e.atr * (1 - 1 / 14.0::DOUBLE) FROM e JOIN s ON s.event_type = e.event_type AND s.k = e.k + 1)
SELECT s.event_type, bar::TIMESTAMP AS bar, round(sma, 6) AS atr_sma, round(atr, 6) AS atr FROM s LEFT JOIN e USING (event_type, k)""")
def average_true_range(spark, d):
    out = rolling.mean_range(bars(spark, d), *_K, "high", "low", "close", 14)
    return folds.wilder_range(out, "event_type", ["bar"], "high", "low", "close", 14).select(*_K, r("atr_sma"), r("atr"))


@query(f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER ({_W}) AS k FROM ({BARS})), s AS (SELECT event_type, avg(close) AS seed FROM b WHERE k <= 9 GROUP BY 1 HAVING count(*) = 9),
e AS (SELECT event_type, 9::BIGINT AS k, seed AS ema FROM s UNION ALL SELECT b.event_type, b.k, b.close * 0.2 + e.ema * 0.8 FROM e JOIN b ON b.event_type = e.event_type AND b.k = e.k + 1)
SELECT b.event_type, bar::TIMESTAMP AS bar, round(ema, 6) AS ema FROM b LEFT JOIN e USING (event_type, k)""")
def seeded_average(spark, d):
    return folds.ema(bars(spark, d), "event_type", ["bar"], "close", 0.2, seed=9).select(*_K, r("ema"))


@query(f"""{_B} SELECT {_AT}, CASE WHEN count(high) OVER w = 20 THEN max(high) OVER w END AS prior_max, CASE WHEN count(low) OVER w = 20 THEN min(low) OVER w END AS prior_min FROM b WINDOW w AS ({_W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)""")
def prior_extremes(spark, d):
    hi = rolling.rolling(bars(spark, d), *_K, "high", 20, 20, prior=True).withColumnRenamed("roll_max", "prior_max").select(*bars(spark, d).columns, "prior_max")
    return rolling.rolling(hi, *_K, "low", 20, 20, prior=True).select(*_K, "prior_max", F.col("roll_min").alias("prior_min"))


@query(f"""{_B}, x AS (SELECT *, CASE WHEN close > 0 AND lag(close) OVER ({_W}) > 0 THEN ln(close / lag(close) OVER ({_W})) END AS lr FROM b)
SELECT {_AT}, CASE WHEN count(lr) OVER w >= 24 THEN round(stddev_pop(lr) OVER w * 100, 6) END AS vol FROM x WINDOW w AS ({_W} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""")
def realised_volatility(spark, d):
    before = F.lag("close").over(Window.partitionBy("event_type").orderBy("bar"))
    x = bars(spark, d).withColumn("lr", F.when((F.col("close") > 0) & (before > 0), F.log(F.col("close") / before)))
    return rolling.rolling(x, *_K, "lr", 24, 24).select(*_K, r(F.col("roll_pstd") * 100, "vol"))


@query("""WITH x AS (SELECT *, epoch_us(ts) AS u FROM events), k AS (SELECT user_id, min(u) AS a, max(u) AS b FROM x GROUP BY 1), n AS (SELECT u, count(*) AS c FROM x GROUP BY 1),
g AS (SELECT u, (sum(c) OVER (ORDER BY u) - (c - 1) / 2) / sum(c) OVER () AS pct FROM n)
SELECT event_id, round((x.u - a) / nullif(b - a, 0), 6) AS age_pct, round(pct, 6) AS time_pct FROM x JOIN k USING (user_id) JOIN g ON x.u = g.u""")
def lifecycle_age(spark, d):
    out = series.life_share(t(spark, d, "events"), "user_id", "ts")
    return series.global_rank(out, "ts").select("event_id", r("age_pct"), r("pct", "time_pct"))


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY date_trunc('day', ts), event_type ORDER BY ts, event_id) - 1 AS place FROM events) SELECT event_id, place::INTEGER AS place FROM x WHERE place < 3""")
def signal_caps(spark, d):
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    return series.capped(e, ["day", "event_type"], ["ts", "event_id"], 3).select("event_id", "place")


@query("""WITH x AS (SELECT *, lag(ts) OVER w AS p, lag(event_type) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) SELECT s || '>' || event_type AS transition, count(*) AS n FROM x
WHERE ts - p <= INTERVAL 72 HOUR AND date_trunc('month', p) = date_trunc('month', ts) GROUP BY 1""")
def state_transitions(spark, d):
    return rolling.transitions(t(spark, d, "events"), "user_id", "ts", "event_type", 72 * 3600).where("transition IS NOT NULL").groupBy("transition").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN NULL ELSE floor(value / 100) END AS v FROM events), y AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM x)
SELECT event_id, p AS before, v - p AS delta, v IS NOT NULL AND v IS DISTINCT FROM p AS changed FROM y""")
def change_points(spark, d):
    e = t(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 3 != 0, F.floor(F.col("value") / 100).cast("double")))
    return rolling.change(e, "user_id", ["ts", "event_id"], "v").select("event_id", "before", "delta", "changed")


@query("""SELECT event_type, epoch(ts)::BIGINT // 604800 AS week, (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) // 500 AS chunk, event_id FROM events""")
def block_ids(spark, d):
    return series.blocks(t(spark, d, "events"), "event_type", "ts", 604_800, 500, "event_id").select("event_type", F.col("block").alias("week"), "chunk", "event_id")


@query(f"""{_B}, m AS (SELECT *, count(total) OVER w AS k, quantile_cont(total, 0.5) OVER w AS q FROM b WINDOW w AS ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT {_AT}, CASE WHEN k >= 12 THEN round(q, 6) END AS prior_median, coalesce(k >= 12 AND q > 0 AND total >= 3 * q, false) AS spike FROM m""")
def spike_events(spark, d):
    return rolling.spikes(bars(spark, d), *_K, "total", 24, 12, 3).select(*_K, r("prior_median"), "spike")


@query(f"""{_B}, m AS (SELECT *, count(total) OVER w AS k, quantile_cont(total, 0.5) OVER w AS q, lead(open, 1) OVER ({_W}) AS entry, lead(open, 5) OVER ({_W}) AS exit FROM b WINDOW w AS ({_W} ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT {_AT}, entry, exit, round((exit / entry - 1) * 10000, 4) AS ret_bps FROM m WHERE k >= 12 AND q > 0 AND total >= 2 * q AND exit IS NOT NULL AND entry <> 0""")
def next_bar_events(spark, d):
    x = rolling.spikes(bars(spark, d), *_K, "total", 24, 12, 2)
    return rolling.next_bar_events(x, *_K, "spike", "open", 4).select(*_K, "entry", "exit", r("ret_bps", places=4))


@query(f"""{_B}, m AS (SELECT *, CASE WHEN count(*) OVER w = 7 AND high = max(high) OVER w THEN high END AS h, CASE WHEN count(*) OVER w = 7 AND low = min(low) OVER w THEN low END AS l FROM b WINDOW w AS ({_W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
n AS (SELECT *, lag(h, 3) OVER ({_W}) AS h3, lag(l, 3) OVER ({_W}) AS l3 FROM m)
SELECT {_AT}, last_value(h3 IGNORE NULLS) OVER w AS pivot_high, last_value(l3 IGNORE NULLS) OVER w AS pivot_low FROM n WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""")
def pivots(spark, d):
    return rolling.pivots(bars(spark, d), *_K, "high", "low", 3, 3).select(*_K, "pivot_high", "pivot_low")


@query(f"""WITH b AS (SELECT *, CASE WHEN n % 4 <> 0 THEN total END AS depth FROM ({BARS})), s AS (SELECT *, lag(depth) OVER ({_W}) AS p FROM b WHERE depth IS NOT NULL), q AS (SELECT *, CASE WHEN p IS NOT NULL THEN greatest(p - depth, 0) END AS pull FROM s),
m AS (SELECT *, avg(pull) OVER w AS m, stddev_pop(pull) OVER w AS sd FROM q WINDOW w AS ({_W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
u AS (SELECT b.event_type, b.bar, pull, m, sd FROM b LEFT JOIN m USING (event_type, bar))
SELECT {_AT}, round(pull, 6) AS pull, round(last_value(m IGNORE NULLS) OVER w, 6) AS pull_mean, round(last_value(sd IGNORE NULLS) OVER w, 6) AS pull_std FROM u WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)""")
def liquidity_pull(spark, d):
    b = bars(spark, d).withColumn("depth", F.when(F.col("n") % 4 != 0, F.col("total")))
    return rolling.liquidity_pull(b, *_K, "depth", 20).select(*_K, r("pull"), r("pull_mean"), r("pull_std"))


@query(f"""{_B}, x AS (SELECT *, avg(close) OVER w AS a, count(close) OVER w AS k, close / nullif(lag(close, 24) OVER ({_W}), 0) - 1 AS ret FROM b WINDOW w AS ({_W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
SELECT {_AT}, CASE WHEN ret IS NULL OR k < 50 THEN 'unknown' WHEN close > a AND ret > 0.01 THEN 'bull' WHEN close < a AND ret < -0.01 THEN 'bear' ELSE 'range' END AS regime FROM x""")
def market_regime(spark, d):
    return rolling.regime(rolling.rolling(bars(spark, d), *_K, "close", 50, 50), *_K, "close", "roll_mean", 24, 0.01).select(*_K, "regime")


@query(f"""{_B}, x AS (SELECT *, sum(CASE WHEN high - low > 0 THEN 1 ELSE 0 END) OVER w AS busy, sum(total) OVER w AS s FROM b WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)) SELECT {_AT}, busy::BIGINT AS busy, round(s, 4) AS running FROM x""")
def running_totals(spark, d):
    x = tables.running(bars(spark, d), "event_type", ["bar"], {"busy": (F.col("high") - F.col("low") > 0).cast("long"), "running": F.col("total")})
    return x.select(*_K, "busy", r("running", places=4))
