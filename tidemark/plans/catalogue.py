"""The library's own queries over the driver's tables, with the SQL that says the same.

Doubles that come out of sums are rounded to 6 places on both sides: the order of a distributed sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import folds, joins, sections, series, tables
from tidemark.plans.registry import BARS as _BARS
from tidemark.plans.registry import MONTHS as _MONTHS
from tidemark.plans.registry import PNL as _PNL
from tidemark.plans.registry import SQL, Q, query
from tidemark.plans.registry import TWO as _TWO
from tidemark.plans.registry import bars as _bars
from tidemark.plans.registry import r as _r
from tidemark.plans.registry import t as _t


@query(f"SELECT event_type, bar::TIMESTAMP AS bar, open, high, low, close, round(total, 6) AS total, n FROM ({_BARS})")
def bars_ohlc_1h(spark, d):
    return _bars(spark, d).select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), "open", "high", "low", "close", _r("total", "total"), "n")


@query(f"WITH b AS ({_BARS}), s AS (SELECT *, lag(close) OVER (PARTITION BY event_type ORDER BY bar) AS p FROM b) SELECT event_type, bar::TIMESTAMP AS bar, round((close / nullif(p, 0) - 1) * 10000, 6) AS ret_bps FROM s")
def bar_returns(spark, d):
    return series.lagged_return(_bars(spark, d), "event_type", "bar", "close").select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), _r("ret_bps", "ret_bps"))


@query(f"""WITH b AS ({_BARS}), s AS (SELECT *, avg(close) OVER w AS m, stddev_samp(close) OVER w AS sd, count(close) OVER w AS k FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
SELECT event_type, bar::TIMESTAMP AS bar, CASE WHEN k >= 12 AND sd > 0 THEN round((close - m) / sd, 6) END AS z FROM s""")
def zscore_prior_24(spark, d):
    return series.prior_zscore(_bars(spark, d), "event_type", "bar", "close", 24, 12).select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), _r("z", "z"))


@query(f"""WITH b AS ({_BARS}) SELECT event_type, bar::TIMESTAMP AS bar, CASE WHEN count(close) OVER w = 6 THEN max(close) OVER w END AS fwd_max, CASE WHEN count(close) OVER w = 6 THEN min(close) OVER w END AS fwd_min
FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING)""")
def forward_extremes_6(spark, d):
    return series.forward_extremes(_bars(spark, d), "event_type", "bar", "close", 6).select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), "fwd_max", "fwd_min")


@query("""WITH g AS (SELECT *, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id)) / 1e6 AS gap_s FROM events)
SELECT event_id, gap_s, coalesce(gap_s > 3600, false) AS is_gap, (sum(CASE WHEN gap_s > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS run FROM g""")
def event_gaps(spark, d):
    return series.gaps(_t(spark, d, "events"), "event_type", "ts", 3600, tie="event_id").select("event_id", "gap_s", "is_gap", "run")


@query(f"""WITH b AS ({_BARS}), r AS (SELECT *, rank() OVER (PARTITION BY bar ORDER BY close) AS r, count(*) OVER (PARTITION BY bar, close) AS ties, count(*) OVER (PARTITION BY bar) AS k FROM b)
SELECT event_type, bar::TIMESTAMP AS bar, round((r + (ties - 1) / 2) / k, 6) AS pct FROM r""")
def cross_section_rank(spark, d):
    return series.pct_rank(_bars(spark, d), ["bar"], "close").select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), _r("pct", "pct"))


def _supplier_months(spark, d):
    return _t(spark, d, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


@query(f"""WITH p AS ({_MONTHS}), r AS (SELECT *, count(*) OVER (PARTITION BY month) AS k, row_number() OVER (PARTITION BY month ORDER BY revenue DESC, l_suppkey) AS u, row_number() OVER (PARTITION BY month ORDER BY revenue, l_suppkey) AS v FROM p)
SELECT l_suppkey, month, revenue, CASE WHEN u <= floor(k * 0.2) THEN 'long' ELSE 'short' END AS side FROM r WHERE k >= 5 AND (u <= floor(k * 0.2) OR v <= floor(k * 0.2))""")
def tail_selection(spark, d):
    return series.tails(_supplier_months(spark, d), ["month"], "revenue", "l_suppkey", 0.2, 5).select("l_suppkey", "month", "revenue", "side")


@query(f"""WITH p AS ({_MONTHS}) SELECT a.l_suppkey, a.month, a.revenue, b.revenue AS later FROM p a LEFT JOIN p b ON a.l_suppkey = b.l_suppkey AND b.month = a.month + INTERVAL 3 MONTH""")
def calendar_offset_join(spark, d):
    p = _supplier_months(spark, d)
    return joins.offset(p, "l_suppkey", "month", "revenue", F.expr("month + INTERVAL 3 MONTHS"), "later").select("l_suppkey", "month", "revenue", "later")


def _two(spark, d):
    """The two commonest event types, by name where they tie; at most as many rows as there are types."""
    e = _t(spark, d, "events").groupBy("event_type").count().orderBy(F.desc("count"), "event_type").limit(2)
    e = e.withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), "event_type")))
    x = _t(spark, d, "events").join(F.broadcast(e.select("event_type", "place")), "event_type")
    return x.where("place = 1").drop("place"), x.where("place = 2").drop("place")


@query(f"""WITH {_TWO} SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 6 HOUR THEN r.event_id END AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_backward(spark, d):
    l, r = _two(spark, d)
    return joins.asof(l, r, "user_id", "ts", ["event_id"], 6 * 3600, tie="event_id").select("event_id", "r_event_id")


@query(f"""WITH {_TWO} SELECT l.event_id, r.event_id AS r_event_id FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts""")
def asof_forward(spark, d):
    l, r = _two(spark, d)
    return joins.asof(l, r, "user_id", "ts", ["event_id"], forward=True, tie="event_id").select("event_id", "r_event_id")


@query(f"""WITH {_TWO} SELECT l.user_id, l.event_id AS l_event_id, r.event_id AS r_event_id, (epoch_us(r.ts) - epoch_us(l.ts)) / 1e6 AS distance_s FROM l JOIN r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 12 HOUR AND l.ts + INTERVAL 12 HOUR""")
def band_join(spark, d):
    l, r = _two(spark, d)
    return joins.band(l, r, "user_id", "ts", 12 * 3600, ["event_id"], ["event_id"]).select("user_id", "l_event_id", "r_event_id", "distance_s")


@query(f"""WITH {_TWO} SELECT l.event_id, round(coalesce(sum(r.value), 0), 6) AS sum_before, count(r.value) AS n_before FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts >= l.ts - INTERVAL 24 HOUR AND r.ts < l.ts GROUP BY l.event_id""")
def trailing_sum(spark, d):
    l, r = _two(spark, d)
    return joins.trailing(l, r, "user_id", "ts", "value", 86400).select("event_id", _r("sum_before", "sum_before"), "n_before")


@query("""WITH RECURSIVE e AS (SELECT event_id, event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
k AS (SELECT event_type, event_id, ts FROM e WHERE i = 1
      UNION ALL SELECT event_type, n.event_id, n.ts FROM (SELECT k.event_type, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id, min(e.ts) AS ts FROM k JOIN e ON e.event_type = k.event_type AND e.ts >= k.ts + INTERVAL 6 HOUR GROUP BY k.event_type, k.ts) n)
SELECT event_id, event_type FROM k""")
def cooldown_6h(spark, d):
    return series.cooldown(_t(spark, d, "events"), "event_type", "ts", 6 * 3600, "event_id").select("event_id", "event_type")


def _trades(spark, d):
    o = _t(spark, d, "orders")
    p = stats.trade_pnl(F.lit(100.0), 100.0 * (1 + (F.col("o_orderkey") % 21 - 10) / 100.0), F.lit(1000.0), F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short"), 0.002)
    return o.withColumn("t", p).select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "t.*")


@query(f"SELECT o_orderkey, round(net + 2.0, 6) AS gross, 2.0::DOUBLE AS cost, round(net, 6) AS net FROM ({_PNL})")
def trade_costs(spark, d):
    return _trades(spark, d).select("o_orderkey", _r("gross", "gross"), "cost", _r("net", "net"))


@query(f"""SELECT o_orderpriority, count(net) AS trades, round(sum(net), 4) AS pnl, round(avg(net), 6) AS mean_pnl, round(stddev_samp(net), 6) AS std_pnl, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate,
round(sum(CASE WHEN net > 0 THEN net ELSE 0 END) / nullif(sum(CASE WHEN net < 0 THEN -net ELSE 0 END), 0), 6) AS profit_factor FROM ({_PNL}) GROUP BY 1""")
def trade_summary(spark, d):
    s = _trades(spark, d).groupBy("o_orderpriority").agg(*series.scores(F.col("net")))
    return s.select("o_orderpriority", "trades", F.round("pnl", 4).alias("pnl"), *[_r(c, c) for c in ("mean_pnl", "std_pnl", "win_rate", "profit_factor")])


@query(f"""WITH e AS (SELECT *, sum(net) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS equity FROM ({_PNL})),
p AS (SELECT *, greatest(0.0, max(equity) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)) AS peak FROM e)
SELECT o_custkey, round(max(peak - equity), 5) AS max_drawdown FROM p GROUP BY 1""")
def max_drawdown(spark, d):
    return series.drawdown(_trades(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], "net").groupBy("o_custkey").agg(F.round(F.max("drawdown"), 5).alias("max_drawdown"))


@query("""WITH m AS (SELECT o_custkey AS k, o_orderdate AS t, 1 AS s FROM orders UNION ALL SELECT o_custkey, o_orderdate + INTERVAL 90 DAY, -1 FROM orders), n AS (SELECT k, t, s, sum(s) AS net FROM m GROUP BY ALL),
c AS (SELECT k, sum(net) OVER (PARTITION BY k ORDER BY t, s ROWS UNBOUNDED PRECEDING) AS open FROM n) SELECT k AS o_custkey, max(open)::BIGINT AS most_open FROM c GROUP BY 1""")
def concurrency_sweep(spark, d):
    o = _t(spark, d, "orders").withColumn("until", F.expr("o_orderdate + INTERVAL 90 DAYS"))
    return series.concurrency(o, "o_custkey", "o_orderdate", "until")


@query("""SELECT l_returnflag, regr_count(l_extendedprice, l_quantity) AS n, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem GROUP BY 1""")
def ols_by_group(spark, d):
    x = _t(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.ols(F.col("l_extendedprice"), F.col("l_quantity")))
    return x.select("l_returnflag", F.col("n").cast("long").alias("n"), F.round("slope", 5).alias("slope"), _r("r2", "r2"))


@query("""WITH t AS (SELECT p_brand, p_size, round(((p_brand_n * 7919) % 1000 + 1) / 1000.0, 6) AS p FROM (SELECT p_brand, p_size, count(*) AS p_brand_n FROM part GROUP BY ALL)),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p, p_size) AS rk, count(*) OVER (PARTITION BY p_brand) AS m FROM t)
SELECT p_brand, p_size, p, round(least(1.0, min(p * m / rk) OVER (PARTITION BY p_brand ORDER BY p DESC, p_size DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM (SELECT *, p_size AS z FROM r)""")
def false_discovery(spark, d):
    tests = _t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("c")).select("p_brand", "p_size", F.round((F.col("c") * 7919 % 1000 + 1) / 1000.0, 6).alias("p"))
    return stats.adjusted(tests, ["p_brand"], "p", tie="p_size").select("p_brand", "p_size", "p", _r("q", "q"))


@query("""SELECT event_type, user_id % 10 AS slice, grouping(event_type)::INTEGER * 2 + grouping(user_id % 10)::INTEGER AS level, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY GROUPING SETS ((event_type, user_id % 10), (event_type), (user_id % 10), ())""")
def rollup_slices(spark, d):
    e = _t(spark, d, "events").withColumn("slice", F.col("user_id") % 10)
    return tables.cube_levels(e, ["event_type", "slice"], "value").withColumn("mean", F.round("mean", 6))


@query("""SELECT s_nationkey, round(max(r) / sum(r), 6) AS top_share, round(sum(r * r) / (sum(r) * sum(r)), 6) AS hhi FROM (SELECT s_nationkey, l_suppkey, sum(l_extendedprice) AS r FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL) GROUP BY 1""")
def concentration(spark, d):
    r = _t(spark, d, "lineitem").join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sections.top_shares(r, ["s_nationkey"], "l_suppkey", "l_extendedprice", 1).select("s_nationkey", _r("top_share", "top_share"), _r("hhi", "hhi"))


@query(f"""WITH p AS ({_MONTHS}), w AS (SELECT l_suppkey, month, revenue / sum(revenue) OVER (PARTITION BY month) AS w FROM p), t AS (SELECT month, lead(month) OVER (ORDER BY month) AS nxt FROM (SELECT DISTINCT month FROM w)),
m AS (SELECT l_suppkey, month, w FROM w UNION ALL SELECT l_suppkey, nxt, -w FROM w JOIN t USING (month) WHERE nxt IS NOT NULL), c AS (SELECT month, l_suppkey, sum(w) AS c FROM m GROUP BY ALL)
SELECT month, round(sum(abs(c)), 6) AS turnover FROM c WHERE month > (SELECT min(month) FROM w) GROUP BY 1""")
def portfolio_turnover(spark, d):
    p = _supplier_months(spark, d)
    p = p.withColumn("w", F.col("revenue") / F.sum("revenue").over(Window.partitionBy("month")))
    return series.turnover(p, "month", "l_suppkey", "w").select("month", _r("turnover", "turnover"))


@query("""WITH x AS (SELECT event_id, value, event_type, CASE WHEN user_id % 7 = 0 THEN 1 ELSE 0 END AS l FROM events), y AS (SELECT *, unnest(range(0, 20))::INTEGER AS round FROM x),
z AS (SELECT round, value, sum(l) OVER w AS k, row_number() OVER (PARTITION BY round, event_type ORDER BY md5('null-1:' || round || ':' || event_type || ':' || event_id)) AS r FROM y WINDOW w AS (PARTITION BY round, event_type))
SELECT round, round(avg(value), 6) AS null_mean, count(*) AS n FROM z WHERE r <= k GROUP BY 1""")
def permutation_null(spark, d):
    return stats.permuted_means(_t(spark, d, "events"), ["event_type"], "event_id", F.col("user_id") % 7 == 0, "value", 20, "null-1").select("round", _r("null_mean", "null_mean"), "n")


_LEDGER = """WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq,
  json_object('o_orderkey', o_orderkey, 'o_orderstatus', o_orderstatus, 'o_totalprice', floor(o_totalprice)::BIGINT)::VARCHAR AS body FROM orders),
c AS (SELECT o_custkey, seq, body, sha256('|' || body) AS hash FROM o WHERE seq = 1
      UNION ALL SELECT o.o_custkey, o.seq, o.body, sha256(c.hash || '|' || o.body) FROM c JOIN o ON o.o_custkey = c.o_custkey AND o.seq = c.seq + 1)"""


def _ledger(spark, d):
    rows = _t(spark, d, "orders").withColumn("o_totalprice", F.floor("o_totalprice").cast("long"))
    return stats.chained(rows, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderkey", "o_orderstatus", "o_totalprice"])


@query(f"{_LEDGER} SELECT o_custkey, seq::INTEGER AS seq, hash FROM c")
def ledger_chain(spark, d):
    return _ledger(spark, d).select("o_custkey", "seq", "hash")


@query("SELECT o_custkey, true AS whole, count(*) AS n, NULL::INTEGER AS first_broken FROM orders WHERE o_custkey % 3 <> 0 GROUP BY 1 UNION ALL SELECT o_custkey, count(*) < 2, count(*), CASE WHEN count(*) >= 2 THEN 2 END FROM orders WHERE o_custkey % 3 = 0 GROUP BY 1")
def ledger_verification(spark, d):
    """Each third customer's second entry is forged."""
    forged = _ledger(spark, d).withColumn("body", F.when((F.col("o_custkey") % 3 == 0) & (F.col("seq") == 2), F.lit("{}")).otherwise(F.col("body")))
    return stats.verified(forged, "o_custkey")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value IS NULL OR isnan(value) OR isinf(value)) AS bad, count(DISTINCT user_id) AS users, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY 1""")
def panel_audit(spark, d):
    return tables.key_audit(_t(spark, d, "events"), ["event_type"], "value", "user_id", "ts").withColumnsRenamed({"members": "users", "first": "first_ts", "last": "last_ts"})


@query(f"""WITH RECURSIVE b AS (SELECT event_type, bar, close, row_number() OVER (PARTITION BY event_type ORDER BY bar) AS k FROM ({_BARS})),
e AS (SELECT event_type, bar, k, close::DOUBLE AS ema FROM b WHERE k = 1 UNION ALL SELECT b.event_type, b.bar, b.k, b.close * 0.1 + e.ema * 0.9 FROM e JOIN b ON b.event_type = e.event_type AND b.k = e.k + 1)
SELECT event_type, bar::TIMESTAMP AS bar, round(ema, 6) AS ema FROM e""")
def exponential_average(spark, d):
    return folds.ema(_bars(spark, d), "event_type", ["bar"], "close", 0.1).select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), _r("ema", "ema"))


@query("""WITH s AS (SELECT value, floor(epoch_us(ts::TIMESTAMP - TIMESTAMP '2024-01-01') / (3 * 86400000000.0))::BIGINT AS k FROM events),
f AS (SELECT unnest(range(k - 4, k + 1)) AS fold, k, value FROM s WHERE k >= 0)
SELECT fold, CASE WHEN fold + 4 = k THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(value), 6) AS mean FROM f WHERE fold >= 0 AND fold < 6 GROUP BY ALL""")
def walk_forward_folds(spark, d):
    rows = folds.walk_forward(_t(spark, d, "events").select("ts", "value"), "ts", F.lit("2024-01-01 00:00:00"), 3, 4, 6)
    return rows.groupBy("fold", "part").agg(F.count(F.lit(1)).alias("n"), _r(F.avg("value"), "mean"))


@query("""WITH s AS (SELECT user_id, lag(event_type, 2) OVER w AS a, lag(event_type) OVER w AS b, event_type AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT a || '>' || b || '>' || c AS motif, count(*) AS n, count(DISTINCT user_id) AS n_keys FROM s WHERE a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL GROUP BY 1""")
def event_motifs(spark, d):
    return folds.motifs(_t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", 3)


from tidemark.plans import evaluation, frames, panels, relations, replays, research, storage  # noqa: E402, F401  (their queries register themselves)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
