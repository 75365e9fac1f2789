"""Queries of evaluation, nulls and tests, data quality, governance and scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import evaluate, nulls, quality, scalars, stats, studies
from tidemark.operators import joins, rolling, series
from tidemark.plans.registry import BARS, PNL, TRADES, bars, query, r, t

_B = f"WITH b AS ({BARS})"
_AT = "event_type, bar::TIMESTAMP AS bar"
_W = "PARTITION BY event_type ORDER BY bar"
_PRIO = "o_orderpriority"


def _trades(spark, d):
    from tidemark.plans.catalogue import _trades as trades

    return trades(spark, d).withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short"))


def _months(spark, d):
    return _trades(spark, d).withColumn("month", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))


_M = f"(SELECT *, date_trunc('month', o_orderdate)::TIMESTAMP AS month FROM ({PNL}))"


def _u(parts: str) -> str:
    return f"(CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def _p(z: str) -> str:
    """Two-sided p of z by the library's fixed approximation, in SQL."""
    x = f"(1 / (1 + 0.2316419::DOUBLE * abs({z})))"
    poly = f"({x} * (0.319381530::DOUBLE + {x} * (-0.356563782::DOUBLE + {x} * (1.781477937::DOUBLE + {x} * (-1.821255978::DOUBLE + {x} * 1.330274429::DOUBLE)))))"
    return f"least(1.0, 2 * (1 - (1 - exp(-({z}) * ({z}) / 2) / 2.5066282746310002::DOUBLE * {poly})))"


def _t_p(t: str, df: str, n: int = 1500) -> str:
    """Two-sided p of Student's t in SQL: the part of the integral of cos^(df - 1) from 0 that lies beyond atan(t / sqrt(df)), by Simpson's rule."""
    part = lambda top: f"({top}) / {2 * n} / 3 * list_sum(list_transform(range(0, {2 * n + 1}), lambda i: (CASE WHEN i IN (0, {2 * n}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * power(cos(({top}) * i / {2 * n}), ({df}) - 1)))"
    end = f"least(pi() / 2, 14 / sqrt({df}))"
    return f"(1 - least(1.0, ({part(f'least({end}, atan(abs({t}) / sqrt({df})))')}) / ({part(end)})))"


_SPLIT = "CASE WHEN o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01' THEN 'train' WHEN o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' THEN 'validation' WHEN o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'holdout' END"


@query(f"""WITH x AS (SELECT *, {_SPLIT} AS split, o_orderdate + INTERVAL 30 DAY AS until FROM ({PNL})), y AS (SELECT *, coalesce((split = 'train' AND until >= TIMESTAMP '1996-01-01') OR (split = 'validation' AND until >= TIMESTAMP '1997-01-01') OR (split = 'holdout' AND until >= TIMESTAMP '1998-01-01'), false) AS crosses FROM x)
SELECT split, count(*) FILTER (NOT crosses) AS n, count(*) FILTER (crosses) AS crossing, round(avg(net) FILTER (NOT crosses), 6) AS mean FROM y GROUP BY 1""")
def split_windows(spark, d):
    x = _trades(spark, d).withColumn("until", F.expr("o_orderdate + INTERVAL 30 DAYS"))
    split, crosses = evaluate.split_of("o_orderdate", "until", {"train": ("1994-01-01", "1996-01-01"), "validation": ("1996-01-01", "1997-01-01"), "holdout": ("1997-01-01", "1998-01-01")})
    x = x.withColumn("split", split).withColumn("crosses", crosses)
    return x.groupBy("split").agg(F.count(F.when(~F.col("crosses"), 1)).alias("n"), F.count(F.when(F.col("crosses"), 1)).alias("crossing"), r(F.avg(F.when(~F.col("crosses"), F.col("net"))), "mean"))


_FOLDS = f"m AS (SELECT month, count(net) AS n, sum(net) AS s FROM {_M} GROUP BY 1), f AS (SELECT month, sum(n) OVER w AS train_n, sum(s) OVER w / nullif(sum(n) OVER w, 0) AS train_mean, n AS test_n, s / n AS test_mean, count(*) OVER w AS k FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"


@query(f"WITH {_FOLDS} SELECT month, train_n::BIGINT AS train_n, round(train_mean, 6) AS train_mean, test_n, round(test_mean, 6) AS test_mean FROM f WHERE k >= 6")
def expanding_folds(spark, d):
    return evaluate.expanding_months(_months(spark, d), "month", "net", 6).select("month", "train_n", r("train_mean"), "test_n", r("test_mean"))


@query(f"""WITH {_FOLDS}, s AS (SELECT month, CASE WHEN test_n < 15 THEN 'thin' WHEN sign(round(train_mean, 9)) = sign(round(test_mean, 9)) AND round(test_mean, 9) <> 0 THEN 'pass' ELSE 'fail' END AS status FROM f WHERE k >= 6)
SELECT month, status, CASE WHEN (SELECT count(*) FILTER (status = 'pass') / nullif(count(*) FILTER (status <> 'thin'), 0) FROM s) >= 0.55 THEN 'robust' ELSE 'weak' END AS verdict FROM s""")
def fold_verdicts(spark, d):
    f = evaluate.expanding_months(_months(spark, d), "month", "net", 6).withColumns({c: F.round(c, 9) for c in ("train_mean", "test_mean")})
    return evaluate.verdicts(f, 15, 0.55).select("month", "status", "verdict")


@query(f"""WITH m AS (SELECT month, count(*) AS n FROM {_M} GROUP BY 1) SELECT month, n FROM m WHERE n >= 0.55 * (SELECT median(n) FROM m) ORDER BY n DESC, month LIMIT 12""")
def canonical_months(spark, d):
    return evaluate.canonical_months(_months(spark, d), "month", 0.55, 12)


@query(f"""WITH m AS (SELECT {_PRIO}, month, count(net) AS n, round(sum(net), 6) AS s FROM {_M} GROUP BY ALL) SELECT {_PRIO}, count(*) AS months, round(avg((s > 0)::INTEGER), 6) AS positive_rate, count(*) FILTER (n >= 5) AS full_months, round(avg((s > 0)::INTEGER) FILTER (n >= 5), 6) AS full_positive_rate, round(min(s), 4) AS worst, round(max(s), 4) AS best FROM m GROUP BY 1""")
def monthly_rates(spark, d):
    m = evaluate.monthly_rates(_months(spark, d).withColumn("net", F.round("net", 6)), [_PRIO], "month", "net", 5)
    return m.select(_PRIO, "months", r("positive_rate"), "full_months", r("full_positive_rate"), r("worst", places=4), r("best", places=4))


@query(f"""SELECT side, c::DOUBLE AS cost, count(*) AS n, round(avg(g - c), 4) AS net_mean, round(avg((round(g - c, 6) > 0)::INTEGER), 6) AS win_rate, round(avg(g), 4) AS break_even FROM (SELECT *, round((net + 2.0) * 10, 6) AS g FROM ({PNL})), (VALUES (0), (10), (20), (50)) v(c) GROUP BY ALL""")
def cost_grid(spark, d):
    x = _trades(spark, d).withColumn("g", F.round(F.col("gross") * 10, 6))
    return evaluate.cost_grid(x, ["side"], "g", [0, 10, 20, 50]).select("side", "cost", "n", r("net_mean", places=4), r("win_rate"), r("break_even", places=4))


@query(f"""{_B}, x AS (SELECT event_type, unnest([{{'delay': 0, 'g': lead(close, 4) OVER w / nullif(close, 0) - 1}}, {{'delay': 1, 'g': lead(close, 5) OVER w / nullif(lead(close, 1) OVER w, 0) - 1}}, {{'delay': 3, 'g': lead(close, 7) OVER w / nullif(lead(close, 3) OVER w, 0) - 1}}], recursive := true) FROM b WINDOW w AS ({_W}))
SELECT event_type, delay, c::DOUBLE AS cost, count(*) AS n, round(avg(g * 10000 - c), 2) AS net_mean FROM x, (VALUES (5), (25)) v(c) WHERE g IS NOT NULL GROUP BY ALL""")
def delay_grid(spark, d):
    return evaluate.delay_grid(bars(spark, d), ["event_type"], "event_type", "bar", "close", [0, 1, 3], 4, [5, 25]).select("event_type", "delay", "cost", "n", r("net_mean", places=2))


@query(f"""{_B}, x AS (SELECT *, count(high) OVER w = 6 AS whole, max(high) OVER w / close - 1 AS up, min(low) OVER w / close - 1 AS down, last_value(close) OVER w / close - 1 AS e FROM b WHERE close > 0 WINDOW w AS ({_W} ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING))
SELECT event_type, count(*) AS n, round(avg(e), 4) AS fixed_hold, round(avg(CASE WHEN down <= -0.5 THEN -0.5 WHEN up >= 0.8 THEN 0.8 ELSE e END), 4) AS stop_first, round(avg(CASE WHEN up >= 0.8 THEN 0.8 WHEN up >= 0.4 AND e < 0 THEN 0 WHEN down <= -0.5 THEN -0.5 ELSE e END), 4) AS break_even FROM x WHERE whole GROUP BY 1""")
def exit_shapes(spark, d):
    b = bars(spark, d).where("close > 0")
    x = rolling.excursions(b, "event_type", "bar", "close", "high", "low", 6).withColumn("e", F.lead("close", 6).over(Window.partitionBy("event_type").orderBy("bar")) / F.col("close") - 1)
    x = x.where("mfe_long IS NOT NULL").withColumns({"up": F.col("mfe_long") / 10_000, "down": F.col("mae_long") / 10_000})
    shapes = evaluate.exit_shapes("up", "down", "e", 0.8, 0.5, F.lit("long"))
    return x.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(c), k, 4) for k, c in shapes.items()])


@query("""WITH x AS (SELECT (l_returnflag = 'R')::INTEGER::DOUBLE AS y, unnest([{'feature': 'l_quantity', 'v': l_quantity}, {'feature': 'l_extendedprice', 'v': l_extendedprice}], recursive := true) FROM lineitem),
c AS (SELECT feature, unnest([0.1, 0.5, 0.9])::DOUBLE AS quantile, unnest(quantile_cont(v, [0.1, 0.5, 0.9])) AS cut FROM x GROUP BY 1), s AS (SELECT feature, quantile, count(*) AS n, avg(y) FILTER (v >= cut) AS hi, avg(y) FILTER (v < cut) AS lo FROM x JOIN c USING (feature) GROUP BY ALL)
SELECT feature, quantile, 'high' AS direction, n, round(hi - lo, 6) AS separation FROM s UNION ALL SELECT feature, quantile, 'low', n, round(lo - hi, 6) FROM s""")
def threshold_scan(spark, d):
    x = t(spark, d, "lineitem").withColumn("y", (F.col("l_returnflag") == "R").cast("int"))
    return evaluate.threshold_scan(x, ["l_quantity", "l_extendedprice"], "y", [0.1, 0.5, 0.9]).select("feature", "quantile", "direction", "n", r("separation"))


@query(f"""{_B}, f AS (SELECT a.event_type, n.close / nullif(a.close, 0) - 1 AS ret FROM b a LEFT JOIN b n ON a.event_type = n.event_type AND n.bar = a.bar + INTERVAL 4 HOUR)
SELECT event_type, count(*) AS events, count(ret) AS n, count(*) - count(ret) AS missing, round(avg(ret), 4) AS mean, round(stddev_pop(ret), 3) AS std, round(avg((ret > 0)::INTEGER), 6) AS positive, round(quantile_cont(ret, 0.05), 6) AS q05, round(quantile_cont(ret, 0.95), 4) AS q95 FROM f GROUP BY 1""")
def forward_stats(spark, d):
    x = joins.offset(bars(spark, d), "event_type", "bar", "close", F.expr("bar + INTERVAL 4 HOURS"), "later")
    x = x.withColumn("ret", F.col("later") / F.nullif(F.col("close"), F.lit(0.0)) - 1)
    s = evaluate.return_stats(x, ["event_type"], "ret", {"q05": 0.05, "q95": 0.95})
    return s.select("event_type", "events", "n", "missing", r("mean", places=4), r("std", places=3), r("positive"), r("q05"), r("q95", places=4))


@query("""WITH q AS (SELECT event_type, date_trunc('month', ts) AS month, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.98) AS hi FROM events GROUP BY ALL) SELECT event_id, CASE WHEN value >= hi THEN 'high' ELSE 'low' END AS rule FROM events e JOIN q ON e.event_type = q.event_type AND date_trunc('month', ts) = month WHERE value >= hi OR value <= lo""")
def month_threshold_events(spark, d):
    x = studies.month_thresholds(t(spark, d, "events"), ["event_type"], "ts", {"lo": ("value", 0.05), "hi": ("value", 0.98)})
    x = x.where((F.col("value") >= F.col("hi")) | (F.col("value") <= F.col("lo")))
    return x.select("event_id", F.when(F.col("value") >= F.col("hi"), "high").otherwise("low").alias("rule"))


@query(f"""WITH m AS (SELECT side, month, round(avg(net), 6) AS v FROM {_M} GROUP BY ALL), o AS (SELECT side, round(avg(net), 6) AS obs FROM {_M} GROUP BY 1) SELECT side, count(*) AS n, round(avg((v <= obs)::INTEGER), 6) AS rank, round((1 + count(*) FILTER (v >= obs)) / (1 + count(*)), 6) AS p, avg((v <= obs)::INTEGER) >= 0.95 AS passed FROM m JOIN o USING (side) GROUP BY 1""")
def null_gate(spark, d):
    x = _months(spark, d)
    m = x.groupBy("side", "month").agg(r(F.avg("net"), "v")).join(x.groupBy("side").agg(r(F.avg("net"), "obs")), "side")
    return nulls.gate(m, F.col("obs"), "v", ["side"]).select("side", "n", r("rank"), r("p"), "passed")


@query(f"""WITH x AS (SELECT *, epoch_us(bar) // (48 * 3600000000) AS b, CASE WHEN close > open THEN 1 ELSE -1 END AS s, high - low AS v FROM ({BARS}) WHERE event_type = 'view'), y AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY bar, event_type) AS j FROM x),
z AS (SELECT round, b FROM (SELECT DISTINCT b FROM y), (SELECT unnest(range(0, 30)) AS round)), p AS (SELECT *, row_number() OVER (PARTITION BY round ORDER BY b) AS a, row_number() OVER (PARTITION BY round ORDER BY md5('blk-1:' || round || ':' || b)) AS c FROM z),
m AS (SELECT p.round, p.b, q.b AS f FROM p JOIN p q ON p.round = q.round AND p.a = q.c) SELECT m.round::INTEGER AS round, round(avg(y.s * w.v), 6) AS null_mean, count(*) AS n FROM y JOIN m ON y.b = m.b JOIN y w ON w.b = m.f AND w.j = y.j GROUP BY 1""")
def block_shuffle(spark, d):
    x = bars(spark, d).where("event_type = 'view'").withColumn("s", F.when(F.col("close") > F.col("open"), 1).otherwise(-1)).withColumn("v", F.col("high") - F.col("low"))
    return nulls.block_shuffle(x, "bar", "event_type", "s", "v", 48 * 3600, 30, "blk-1").select("round", r("null_mean"), "n")


@query("""WITH x AS (SELECT *, user_id % 11 = 0 AS ev FROM events), k AS (SELECT event_type, sum(ev::INTEGER) AS k FROM x GROUP BY 1), y AS (SELECT x.*, k, round FROM x JOIN k USING (event_type), (SELECT unnest(range(0, 20)) AS round) WHERE NOT ev),
z AS (SELECT *, row_number() OVER (PARTITION BY round, event_type ORDER BY md5('bal-1:' || round || ':' || event_type || ':' || event_id)) AS r FROM y) SELECT round::INTEGER AS round, round(avg(value), 6) AS null_mean, count(*) AS n FROM z WHERE r <= k GROUP BY 1""")
def balanced_null(spark, d):
    ev = F.col("user_id") % 11 == 0
    return stats.permuted_means(t(spark, d, "events"), ["event_type"], "event_id", ev, "value", 20, "bal-1", event=ev).select("round", r("null_mean"), "n")


def _boot(block: int, seed: str) -> str:
    start = f"floor({_u(f'{chr(39)}{seed}:{chr(39)} || round || {chr(39)}:{chr(39)} || side || {chr(39)}:{chr(39)} || (i // {block})')} * n)::BIGINT"
    return f"SELECT z.side, z.round, avg(x.net) AS m FROM (SELECT side, round, ({start} + i % {block}) % n AS at FROM x, (SELECT unnest(range(0, 25)) AS round)) z JOIN x ON x.side = z.side AND x.i = z.at GROUP BY ALL"


_X = f"x AS (SELECT side, net, o_orderdate, o_orderkey, row_number() OVER (PARTITION BY side ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM ({PNL}))"


def _u4(seed: str, *parts: str) -> str:
    """four_uniform() of rounds, in SQL."""
    text = f"'{seed}' || ':' || (round // 4)" + "".join(f" || ':' || {p}" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), (1 + 8 * (round % 4))::BIGINT, 8) AS BIGINT)::DOUBLE / 4294967296.0::DOUBLE)"


def _poisson(u: str) -> str:
    return f"len(list_filter({nulls.POISSON}, lambda p: {u} >= p))"


_ROW = ("side", "o_orderdate", "o_orderkey")


@query(f"""WITH {_X}, y AS (SELECT x.*, round FROM x, (SELECT unnest(range(0, 25)) AS round)), w AS (SELECT *, {_u4('row-1', *_ROW)} AS u FROM y), a AS (SELECT side, round, sum(net * k) / sum(k) AS m FROM (SELECT *, {_poisson('u')} AS k FROM w) GROUP BY ALL),
b AS ({_boot(24, 'circ-1')}), c AS (SELECT side, round, avg(CASE WHEN {_u4('flip-1', *_ROW)} < 0.5 THEN -net ELSE net END) AS m FROM y GROUP BY ALL)
SELECT method, side, round::INTEGER AS round, round(m, 6) AS mean FROM (SELECT 'rows' AS method, * FROM a UNION ALL SELECT 'circular_blocks', * FROM b UNION ALL SELECT 'sign_flips', * FROM c)""")
def bootstrap_methods(spark, d):
    x = _trades(spark, d)
    order = ["o_orderdate", "o_orderkey"]
    all_ = {"rows": nulls.bootstrap(x, ["side"], order, "net", 25, "row-1"), "circular_blocks": nulls.bootstrap(x, ["side"], order, "net", 25, "circ-1", block=24), "sign_flips": nulls.bootstrap(x, ["side"], order, "net", 25, "flip-1", flip=True)}
    parts = [v.select(F.lit(k).alias("method"), "side", "round", r("mean")) for k, v in all_.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH y AS (SELECT *, (move > 0)::INTEGER AS s FROM ({PNL})), z AS (SELECT y.*, round FROM y, (SELECT unnest(range(0, 40)) AS round)), w AS (SELECT *, {_u4('ci-1', 'side', 's', 'o_orderdate', 'o_orderkey')} AS u FROM z),
m AS (SELECT side, s, round, sum(net * k) / sum(k) AS m FROM (SELECT *, {_poisson('u')} AS k FROM w) GROUP BY ALL),
e AS (SELECT side, round, max(m) FILTER (s = 1) - max(m) FILTER (s = 0) AS d FROM m GROUP BY ALL), b AS (SELECT side, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM e GROUP BY 1)
SELECT side, round(avg(net) FILTER (s = 1) - avg(net) FILTER (s = 0), 6) AS diff, round(any_value(lo), 6) AS low, round(any_value(hi), 6) AS high FROM y JOIN b USING (side) GROUP BY 1""")
def difference_interval(spark, d):
    x = _trades(spark, d)
    up = F.col("o_orderkey") % 21 > 10
    return nulls.difference_interval(x, ["side"], ["o_orderdate", "o_orderkey"], "net", up, 40, "ci-1").select("side", r("diff"), r("low"), r("high"))


@query("""WITH c AS (SELECT l_returnflag, l_quantity, count(*) FILTER (l_linenumber = 1) AS a, count(*) FILTER (l_linenumber <> 1) AS b FROM lineitem GROUP BY ALL), k AS (SELECT *, sum(a + b) OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - (a + b - 1) / 2 AS rk FROM c),
s AS (SELECT l_returnflag, sum(a) AS n1, sum(b) AS n2, sum(a * rk) AS r1, sum(((a + b)::DOUBLE ** 3) - (a + b)) AS ties FROM k GROUP BY 1), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2 AS mid, n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS v FROM s),
z AS (SELECT *, (abs(u - mid) - 0.5) / sqrt(v) * sign(u - mid) AS z FROM u) SELECT l_returnflag, n1::BIGINT AS n1, n2::BIGINT AS n2, u, round(z, 6) AS z, round(""" + _p("greatest(abs(z), 0)") + """, 6) AS p, round(1 - 2 * u / (n1 * n2), 6) AS effect FROM z""")
def mann_whitney(spark, d):
    m = nulls.mann_whitney(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linenumber") == 1)
    return m.select("l_returnflag", "n1", "n2", F.col("u").cast("double").alias("u"), r("z"), r("p"), r("effect"))


@query("""WITH s AS (SELECT l_returnflag, count(*) FILTER (l_linenumber = 1) AS n1, count(*) FILTER (l_linenumber <> 1) AS n2, avg(l_extendedprice) FILTER (l_linenumber = 1) - avg(l_extendedprice) FILTER (l_linenumber <> 1) AS diff, var_samp(l_extendedprice) FILTER (l_linenumber = 1) AS v1, var_samp(l_extendedprice) FILTER (l_linenumber <> 1) AS v2 FROM lineitem GROUP BY 1),
t AS (SELECT *, v1 / n1 AS a, v2 / n2 AS b FROM s), z AS (SELECT *, diff / sqrt(a + b) AS z, (a + b) ** 2 / (a ** 2 / (n1 - 1) + b ** 2 / (n2 - 1)) AS df FROM t) SELECT l_returnflag, n1, n2, round(diff, 4) AS diff, round(z, 5) AS t, round(df, 3) AS df, round(""" + _t_p("z", "df") + """, 5) AS p FROM z""")
def welch_test(spark, d):
    w = nulls.welch(t(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", F.col("l_linenumber") == 1)
    return w.select("l_returnflag", "n1", "n2", r("diff", places=4), r("t", places=5), r("df", places=3), r("p", places=5))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(sqrt(regr_r2(l_extendedprice, l_quantity) * (regr_count(l_extendedprice, l_quantity) - 2) / (1 - regr_r2(l_extendedprice, l_quantity))) * sign(regr_slope(l_extendedprice, l_quantity)), 3) AS t FROM lineitem GROUP BY 1""")
def ols_tests(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_returnflag").agg(*stats.ols(F.col("l_extendedprice"), F.col("l_quantity")))
    return x.select("l_returnflag", r("slope", places=5), r("intercept", places=3), r("t", places=3))


@query("""WITH t AS (SELECT p_brand, p_size, round(((count(*) * 7919) % 1000 + 1) / 1000.0, 6) AS p FROM part GROUP BY ALL) SELECT p_brand, p_size, round(least(1.0, p * count(*) OVER (PARTITION BY p_brand)), 6) AS bonferroni FROM t""")
def bonferroni(spark, d):
    x = t(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("c")).select("p_brand", "p_size", F.round((F.col("c") * 7919 % 1000 + 1) / 1000.0, 6).alias("p"))
    return stats.adjusted(x, ["p_brand"], "p", tie="p_size").select("p_brand", "p_size", r("bonferroni"))


@query(f"""WITH x AS (SELECT *, o_custkey % 4 AS g FROM ({PNL})), k AS (SELECT g, count(*) FILTER (side = 'long') AS k FROM x GROUP BY 1), y AS (SELECT x.*, k, round FROM x JOIN k USING (g), (SELECT unnest(range(0, 40)) AS round)),
z AS (SELECT *, row_number() OVER (PARTITION BY round, g ORDER BY md5('lab-1:' || round || ':' || g || ':' || o_orderkey)) AS r FROM y), m AS (SELECT round, avg(net) FILTER (r <= k) AS m FROM z GROUP BY 1), o AS (SELECT avg(net) FILTER (side = 'long') AS obs, avg(net) AS mid FROM x)
SELECT count(*) AS rounds, round(any_value(obs), 6) AS observed, round((1 + count(*) FILTER (round(abs(m - mid), 9) >= round(abs(obs - mid), 9))) / (1 + count(*)), 6) AS p FROM m, o""")
def label_permutation(spark, d):
    """Labels change places within their stratum only; two-sided, around the mean of all."""
    x = _trades(spark, d).withColumn("g", F.col("o_custkey") % 4)
    m = stats.permuted_means(x, ["g"], "o_orderkey", F.col("side") == "long", "net", 40, "lab-1")
    o = x.agg(F.avg(F.when(F.col("side") == "long", F.col("net"))).alias("obs"), F.avg("net").alias("mid"))
    far = F.round(F.abs(F.col("null_mean") - F.col("mid")), 9) >= F.round(F.abs(F.col("obs") - F.col("mid")), 9)
    return m.crossJoin(o).agg(F.count(F.lit(1)).alias("rounds"), r(F.max("obs"), "observed"), r((1 + F.count(F.when(far, 1))) / (1 + F.count(F.lit(1))), "p"))  # one row


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('neg-1:' || o_orderkey)) AS r, count(*) OVER (PARTITION BY side) AS n FROM ({PNL})) SELECT side, count(*) AS n, round(avg(net), 6) AS mean, round(avg(-(net + 2.0) - 2.0), 6) AS flipped FROM x WHERE r <= floor(n * 0.1) GROUP BY 1""")
def negative_control(spark, d):
    """A tenth of the trades of each side by hash, as they are and with their direction turned."""
    x = _trades(spark, d)
    k = x.groupBy("side").agg(F.floor(F.count(F.lit(1)) * 0.1).alias("k"))
    s = stats.drawn(x.join(k, "side"), ["side"], stats.seeded("neg-1", "o_orderkey"), F.col("k"), 1)
    return s.groupBy("side").agg(F.count(F.lit(1)).alias("n"), r(F.avg("net"), "mean"), r(F.avg(-F.col("gross") - F.col("cost")), "flipped"))


_G = f"(sqrt(-2 * ln(greatest({_u(chr(39) + 'syn-1-u:' + chr(39) + ' || model || ' + chr(39) + ':' + chr(39) + ' || round || ' + chr(39) + ':' + chr(39) + ' || j')}, 1e-12))) * cos(2 * 3.141592653589793::DOUBLE * {_u(chr(39) + 'syn-1-v:' + chr(39) + ' || model || ' + chr(39) + ':' + chr(39) + ' || round || ' + chr(39) + ':' + chr(39) + ' || j')}))"


@query(f"""WITH m AS (SELECT month, sum(net) AS v FROM {_M} GROUP BY 1), b AS (SELECT avg(v) AS m, stddev_samp(v) AS s FROM m), g AS (SELECT model, shift, scale, round, j FROM (VALUES ('same', 1.0, 1.0), ('centred', 0.0, 1.0), ('wide', 0.0, 2.0)) x(model, shift, scale), (SELECT unnest(range(0, 20)) AS round), (SELECT unnest(range(0, 12)) AS j))
SELECT model, round::INTEGER AS round, round(sum(m * shift::DOUBLE + s * scale::DOUBLE * {_G}), 4) AS total, round(avg((m * shift::DOUBLE + s * scale::DOUBLE * {_G} > 0)::INTEGER), 6) AS positive FROM g, b GROUP BY ALL""")
def synthetic_months(spark, d):
    m = _months(spark, d).groupBy("month").agg(F.sum("net").alias("v"))
    return nulls.synthetic_months(m, "v", {"same": (1.0, 1.0), "centred": (0.0, 1.0), "wide": (0.0, 2.0)}, 20, 12, "syn-1").select("model", "round", r("total", places=4), r("positive"))


@query(f"""WITH x AS (SELECT *, extract(year FROM o_orderdate)::BIGINT AS y, CASE WHEN epoch_us(o_orderdate) < (SELECT (min(epoch_us(o_orderdate)) + max(epoch_us(o_orderdate))) / 2 FROM orders) THEN 'first_half' ELSE 'second_half' END AS half FROM ({PNL})),
s AS (SELECT half AS slice, net FROM x UNION ALL SELECT y::VARCHAR, net FROM x UNION ALL SELECT side, net FROM x) SELECT slice, count(*) AS n, round(avg(net), 6) AS mean FROM s GROUP BY 1""")
def robustness_slices(spark, d):
    x = studies.robustness_slices(_trades(spark, d), "o_orderdate", "net", groups={"side": F.col("side")})
    return x.select(F.when(F.col("dimension") == "half", F.concat("slice", F.lit("_half"))).otherwise(F.col("slice")).alias("slice"), "n", r("mean"))


@query("""WITH l AS (SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b FROM orders GROUP BY 1) SELECT CASE WHEN a >= TIMESTAMP '1993-01-01' AND b < TIMESTAMP '1998-01-01' THEN 'both' WHEN a >= TIMESTAMP '1993-01-01' THEN 'late_listing' WHEN b < TIMESTAMP '1998-01-01' THEN 'delisted' ELSE 'whole' END AS state, count(*) AS n,
(SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)) AS never FROM l GROUP BY 1""")
def survivorship(spark, d):
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    return studies.listing_audit(t(spark, d, "orders"), "o_custkey", "o_orderdate", at("1993-01-01"), at("1998-01-01"), t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")))


@query("""WITH m AS (SELECT l_suppkey, date_trunc('month', l_shipdate) AS month, sum(l_tax) AS f FROM lineitem GROUP BY ALL), w AS (SELECT *, sum(f) OVER v AS s, count(*) OVER v AS k FROM m WINDOW v AS (PARTITION BY l_suppkey ORDER BY month RANGE BETWEEN INTERVAL 11 MONTH PRECEDING AND CURRENT ROW))
SELECT l_suppkey, month::TIMESTAMP AS month, CASE WHEN k >= 10 THEN round(s, 6) END AS carry_12m FROM w""")
def carry_sum(spark, d):
    """Twelve months of cash flow, where at least 80 % of the months have any."""
    m = t(spark, d, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.sum("l_tax").alias("f"))
    return studies.rolling_cash(m, "l_suppkey", "month", "f").select("l_suppkey", "month", r("carry", "carry_12m"))


@query("""WITH p AS (SELECT l_returnflag AS g, l_linenumber AS s, l_shipmode_ AS c, sum(l_extendedprice) AS x, count(*) AS n FROM (SELECT *, CASE WHEN l_quantity >= 40 THEN 'big' WHEN l_quantity < 10 THEN 'small' ELSE 'base' END AS l_shipmode_ FROM lineitem) GROUP BY ALL),
w AS (SELECT g, c, sum(x) / sum(n) AS m, sum(n) AS n FROM p GROUP BY ALL), a AS (SELECT g, sum(x) / sum(n) AS al FROM p GROUP BY 1), e AS (SELECT w.g, w.c, w.n, w.m - b.m AS eb, w.m - al AS ea FROM w JOIN w b ON w.g = b.g AND b.c = 'base' JOIN a ON a.g = w.g WHERE w.c <> 'base'),
v AS (SELECT q.g, q.s, q.c, q.x / q.n - b.x / b.n AS ed FROM p q JOIN p b ON q.g = b.g AND q.s = b.s AND b.c = 'base' WHERE q.c <> 'base')
SELECT e.g AS l_returnflag, e.c AS category, any_value(e.n)::BIGINT AS n, round(any_value(eb), 3) AS vs_baseline, round(any_value(ea), 3) AS vs_all, round(avg((sign(ed) = sign(eb))::INTEGER), 6) AS sign_match FROM e LEFT JOIN v ON v.g = e.g AND v.c = e.c GROUP BY ALL""")
def category_effects(spark, d):
    x = t(spark, d, "lineitem").withColumn("category", F.when(F.col("l_quantity") >= 40, "big").when(F.col("l_quantity") < 10, "small").otherwise("base"))
    return evaluate.effects(x, ["l_returnflag"], ["l_linenumber"], "category", "base", "l_extendedprice").select("l_returnflag", "category", "n", r("vs_baseline", places=3), r("vs_all", places=3), r("sign_match"))


@query(f"""WITH x AS (SELECT *, net < -60 AS bad FROM ({PNL})), g AS (SELECT net, bad, unnest([{{'guard': 'long_only', 'keep': side = 'long'}}, {{'guard': 'no_urgent', 'keep': o_orderpriority <> '1-URGENT'}}, {{'guard': 'small_moves', 'keep': abs(move) <= 0.055}}], recursive := true) FROM x)
SELECT guard, count(*) FILTER (keep) AS kept, round(sum(net) FILTER (keep), 3) AS pnl_kept, round(sum(net) FILTER (keep) - sum(net), 3) AS delta, round(count(*) FILTER (bad AND NOT keep) / nullif(count(*) FILTER (bad), 0), 6) AS bad_removed FROM g GROUP BY 1""")
def guard_search(spark, d):
    guards = {"long_only": F.col("side") == "long", "no_urgent": F.col(_PRIO) != "1-URGENT", "small_moves": F.abs((F.col("o_orderkey") % 21 - 10) / 100.0) <= 0.055}
    return evaluate.guard_search(_trades(spark, d), guards, "net", F.col("net") < -60).select("guard", "kept", r("pnl_kept", places=3), r("delta", places=3), r("bad_removed"))


@query(f"""{_B}, x AS (SELECT *, close / nullif(lag(close, 6) OVER ({_W}), 0) - 1 AS past, lead(close, 3) OVER ({_W}) / nullif(close, 0) - 1 AS nxt FROM b), y AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY bar) * 0.4), 1) AS k, row_number() OVER (PARTITION BY bar ORDER BY past, event_type) AS u, row_number() OVER (PARTITION BY bar ORDER BY past DESC, event_type) AS v FROM x WHERE past IS NOT NULL AND nxt IS NOT NULL),
w AS (SELECT *, CASE WHEN u <= k THEN 0.5 / k ELSE 0 END - CASE WHEN v <= k THEN 0.5 / k ELSE 0 END AS w FROM y), t AS (SELECT bar, lead(bar) OVER (ORDER BY bar) AS nb FROM (SELECT DISTINCT bar FROM w)), h AS (SELECT bar, event_type, w FROM w WHERE w <> 0), c AS (SELECT bar, event_type, sum(w) AS c FROM (SELECT * FROM h UNION ALL SELECT nb, event_type, -w FROM h JOIN t USING (bar) WHERE nb IS NOT NULL) GROUP BY ALL),
o AS (SELECT bar, sum(abs(c)) AS turnover FROM c GROUP BY 1), g AS (SELECT bar, count(*) AS n, sum(w * nxt) AS gross FROM w GROUP BY 1) SELECT bar::TIMESTAMP AS bar, n, round(gross, 4) AS gross, round(turnover, 6) AS turnover, round(gross - 0.001 * turnover, 4) AS net FROM g JOIN o USING (bar)""")
def reversal_portfolio(spark, d):
    return evaluate.reversal(bars(spark, d), "event_type", "bar", "close", "event_type", 6, 3, 0.4, 0.001).select("bar", "n", r("gross", places=4), r("turnover"), r("net", places=4))


@query(f"""{_B}, p AS (SELECT a.bar, ln(a.close) AS y, ln(c.close) AS x FROM b a JOIN b c ON a.bar = c.bar AND c.event_type = 'click' WHERE a.event_type = 'view' AND a.close > 0 AND c.close > 0), h AS (SELECT regr_slope(y, x) AS s, regr_intercept(y, x) AS i FROM p WHERE bar < (SELECT min(bar) + INTERVAL 14 DAY FROM p)),
e AS (SELECT bar, y - i - s * x AS sp FROM p, h), z AS (SELECT *, avg(sp) OVER w AS m, stddev_samp(sp) OVER w AS sd, count(sp) OVER w AS k FROM e WINDOW w AS (ORDER BY bar ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING)) SELECT bar::TIMESTAMP AS bar, round(sp, 6) AS spread, CASE WHEN k >= 24 AND sd > 0 THEN round((sp - m) / sd, 6) END AS z FROM z""")
def pair_spread(spark, d):
    """Log spread of two keys: the hedge ratio from the first 14 days alone, then a z-score over the 48 rows before."""
    b = bars(spark, d).where("close > 0")
    of = lambda k, n: b.where(F.col("event_type") == k).select("bar", F.log("close").alias(n))
    p = of("view", "y").join(of("click", "x"), "bar")
    first = p.agg(F.min("bar").alias("b0"))
    h = p.crossJoin(F.broadcast(first)).where(F.col("bar") < F.expr("b0 + INTERVAL 14 DAYS")).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i"))
    e = p.crossJoin(F.broadcast(h)).select("bar", F.lit("pair").alias("pair"), (F.col("y") - F.col("i") - F.col("s") * F.col("x")).alias("spread"))  # one row
    return series.prior_zscore(e, "pair", "bar", "spread", 48, 24).select("bar", r("spread"), r("z"))


@query("""WITH s AS (SELECT count(*) AS n, count(DISTINCT user_id) AS users, avg((value IS NULL)::INTEGER) AS nulls, max(value) AS top FROM events) SELECT name, severity, round(value::DOUBLE, 6) AS value, passed, CASE WHEN max(CASE WHEN passed THEN 0 WHEN severity = 'critical' THEN 2 ELSE 1 END) OVER () = 2 THEN 'CRITICAL' WHEN max(CASE WHEN passed THEN 0 ELSE 1 END) OVER () = 1 THEN 'ATTENTION' ELSE 'PASS' END AS state
FROM (SELECT 'rows' AS name, 'critical' AS severity, n AS value, n >= 500 AS passed FROM s UNION ALL SELECT 'users', 'critical', users, users >= 5 FROM s UNION ALL SELECT 'nulls', 'critical', nulls, nulls <= 0.01 FROM s UNION ALL SELECT 'top', 'warning', top, top < 10 FROM s)""")
def quality_gates(spark, d):
    v = F.col("value")
    checks = {"rows": (F.count(F.lit(1)), v >= 500, "critical"), "users": (F.count_distinct("user_id"), v >= 5, "critical"), "nulls": (F.avg(v.isNull().cast("int")), v <= 0.01, "critical"), "top": (F.max("value"), v < 10, "warning")}
    return quality.gates(t(spark, d, "events"), checks).select("name", "severity", r("value"), "passed", "state")


@query(f"""{_B} SELECT event_type, min(bar)::TIMESTAMP AS first, max(bar)::TIMESTAMP AS last, count(*) AS n, ((epoch_us(max(bar)) - epoch_us(min(bar))) // 3600000000 + 1 - count(*))::BIGINT AS missing FROM b GROUP BY 1""")
def missing_intervals(spark, d):
    return quality.missing_intervals(bars(spark, d), "event_type", "bar", 3600)


@query(f"""{_B}, x AS (SELECT *, (epoch_us(bar) - lag(epoch_us(bar)) OVER ({_W})) / 1e6 AS g, (close / nullif(lag(close) OVER ({_W}), 0) - 1) * 10000 AS ret FROM b) SELECT event_type, date_trunc('month', bar)::TIMESTAMP AS month, count(*) AS n, count(*) FILTER (g = 0) AS repeated, count(*) FILTER (g > 5400) AS over_1h, count(*) FILTER (g > 12600) AS over_3h, count(*) FILTER (abs(ret) >= 2000) AS outliers FROM x GROUP BY ALL""")
def panel_coverage(spark, d):
    c = quality.coverage(bars(spark, d), "event_type", "bar", "close", {"over_1h": 5400, "over_3h": 12_600}, 2000)
    return c.withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("""WITH x AS (SELECT *, coalesce(o_orderdate > lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), true) AS up FROM orders) SELECT o_custkey, count(*) AS n, bool_and(up) AS increasing, bool_and(epoch_us(o_orderdate) % 86400000000 = 0) AS aligned, bool_and(up) AND bool_and(epoch_us(o_orderdate) % 86400000000 = 0) AS valid FROM x GROUP BY 1""")
def partition_review(spark, d):
    o = t(spark, d, "orders").withColumn("place", F.struct("o_orderdate", "o_orderkey"))
    return quality.revalidated(o, "o_custkey", "o_orderdate", "place", "o_totalprice", 86_400).select("o_custkey", "n", "increasing", "aligned", "valid")


@query("""WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'P' THEN 1 WHEN 'O' THEN 0 END AS rk, floor(o_totalprice / 1000)::BIGINT AS size FROM orders), t AS (SELECT *, rk - lag(rk) OVER w AS rank_delta, size - lag(size) OVER w AS size_delta, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, rank_delta, size_delta, CASE WHEN i = 1 THEN NULL WHEN rank_delta < 0 THEN 'downgrade' WHEN rank_delta > 0 THEN 'upgrade' WHEN size_delta <> 0 THEN 'change' ELSE 'none' END AS alert FROM t""")
def snapshot_changes(spark, d):
    o = t(spark, d, "orders").withColumn("size", F.floor(F.col("o_totalprice") / 1000))
    return quality.snapshot_diff(o, "o_custkey", ["o_orderdate", "o_orderkey"], "o_orderstatus", {"F": 2, "P": 1, "O": 0}, ["size"]).select("o_orderkey", "rank_delta", "size_delta", "alert")


@query("""WITH RECURSIVE a AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_partkey * 7 % 101 END AS at FROM part WHERE p_partkey <= 200), n AS (SELECT k, k // 2 AS needs FROM a WHERE k >= 2), d AS (SELECT a.k, a.at IS NULL OR coalesce(bool_or(coalesce(b.at > a.at, true)) FILTER (n.k IS NOT NULL), false) AS direct FROM a LEFT JOIN n USING (k) LEFT JOIN a b ON b.k = n.needs GROUP BY a.k, a.at),
t AS (SELECT k, k AS root, 0 AS depth FROM a UNION ALL SELECT n.k, t.root, t.depth + 1 FROM t JOIN n ON n.needs = t.k) SELECT t.k AS artifact, any_value(x.direct) AS direct, bool_or(d.direct) AS stale, max(t.depth)::INTEGER AS depth FROM t JOIN d ON d.k = t.root JOIN d x ON x.k = t.k GROUP BY 1""")
def staleness(spark, d):
    a = t(spark, d, "part").where("p_partkey <= 200").select(F.col("p_partkey").alias("artifact"), F.when(F.col("p_partkey") % 17 != 0, F.col("p_partkey") * 7 % 101).alias("built_at"))
    return quality.stale(a, a.where("artifact >= 2").select("artifact", F.floor(F.col("artifact") / 2).alias("needs")))


@query(f"""WITH s AS (SELECT o_custkey, side, count(*) AS n, round(sum(net), 6) AS pnl FROM ({PNL}) GROUP BY ALL), x AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY pnl DESC, side) AS r FROM s) SELECT o_custkey, side, CASE WHEN n >= 5 AND pnl > 0 THEN 'live' WHEN pnl > 0 THEN 'candidate' ELSE 'retired' END AS stage FROM x WHERE r = 1""")
def lifecycle_best(spark, d):
    s = _trades(spark, d).groupBy("o_custkey", "side").agg(F.count(F.lit(1)).alias("n"), r(F.sum("net"), "pnl"))
    stage = F.when((F.col("n") >= 5) & (F.col("pnl") > 0), "live").when(F.col("pnl") > 0, "candidate").otherwise("retired")
    return quality.best_rows(s, ["o_custkey"], stage, [F.desc("pnl"), F.asc("side")]).select("o_custkey", "side", "stage")


@query("""WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS f, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 30) / 20.0::DOUBLE END AS q FROM customer) SELECT c_custkey, CASE WHEN f > 0 THEN f WHEN q > 0 AND q <= 1 THEN q * 1000 ELSE 100 END AS notional FROM c""")
def sizing_contract(spark, d):
    k = F.col("c_custkey")
    c = t(spark, d, "customer").withColumns({"f": F.when(k % 3 == 0, F.col("c_acctbal")), "q": F.when(k % 2 == 0, (k % 30) / 20.0)})
    return c.select("c_custkey", quality.sizing("f", "q", 1000.0, 100.0).alias("notional"))


@query("""SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal / 100 END, CASE WHEN c_custkey % 3 = 1 THEN c_acctbal / 50 END, c_acctbal / 10) AS bps, CASE WHEN c_custkey % 3 = 0 THEN 'native' WHEN c_custkey % 3 = 1 THEN 'row' ELSE 'proposed' END AS source FROM customer""")
def gross_bps_sources(spark, d):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    bps, source = quality.derived_bps([("native", F.when(k % 3 == 0, b / 100)), ("row", F.when(k % 3 == 1, b / 50)), ("proposed", b / 10)])
    return t(spark, d, "customer").select("c_custkey", bps.alias("bps"), source.alias("source"))


@query("""WITH x AS (SELECT s_suppkey, s_nationkey::VARCHAR AS a, CASE WHEN s_suppkey % 4 = 0 THEN 'x' ELSE s_nationkey::VARCHAR END AS b FROM supplier WHERE s_suppkey % 10 <> 9), y AS (SELECT s_suppkey, s_nationkey::VARCHAR AS a FROM supplier)
SELECT s_suppkey, 'nation' AS field, x.b AS was, y.a AS now FROM y LEFT JOIN x USING (s_suppkey) WHERE x.b IS DISTINCT FROM y.a""")
def config_changes(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    was = s.where("s_suppkey % 10 <> 9").withColumn("nation", F.when(F.col("s_suppkey") % 4 == 0, "x").otherwise(F.col("nation")))
    return quality.config_diff(was, s, "s_suppkey", ["nation"])


@query(f"""{_B} SELECT {_AT}, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper_wick, round((least(open, close) - low) / nullif(high - low, 0), 6) AS lower_wick, round(abs(close - open) / nullif(high - low, 0), 6) AS body, round((close - low) / nullif(high - low, 0), 6) AS close_at,
coalesce(((high - greatest(open, close)) / nullif(high - low, 0) >= 0.5)::INTEGER, 0) + coalesce(((close - low) / nullif(high - low, 0) <= 0.3)::INTEGER, 0) AS score FROM b""")
def candle_geometry(spark, d):
    g = scalars.candle()
    score = F.coalesce((g["upper_wick"] >= 0.5).cast("int"), F.lit(0)) + F.coalesce((g["close_at"] <= 0.3).cast("int"), F.lit(0))
    return bars(spark, d).select("event_type", "bar", *[r(c, k) for k, c in g.items()], score.alias("score"))


@query("""SELECT event_id, round(ln(1 + abs(value)), 9) AS log1p, sign(value - 50)::INTEGER AS side, greatest(-10, least(10, value))::DOUBLE AS clipped, floor(value)::BIGINT AS low, ceil(value)::BIGINT AS high, CASE WHEN user_id % 5 = 0 THEN NULL ELSE round(value / (user_id % 5), 9) END AS ratio FROM events""")
def scalar_math(spark, d):
    v = F.col("value")
    return t(spark, d, "events").select("event_id", F.round(F.log1p(F.abs(v)), 9).alias("log1p"), scalars.sign_of(v - 50).alias("side"), F.greatest(F.lit(-10.0), F.least(F.lit(10.0), v)).alias("clipped"), F.floor(v).alias("low"), F.ceil(v).alias("high"), F.round(scalars.safe_div(v, F.col("user_id") % 5), 9).alias("ratio"))


@query("""SELECT event_id, isodow(ts)::INTEGER - 1 AS weekday, hour(ts)::INTEGER AS hour, week(ts)::INTEGER AS iso_week, quarter(ts)::INTEGER AS quarter, strftime(ts, '%Y-%m') AS month, strftime(date_trunc('month', ts) + INTERVAL 3 MONTH, '%Y-%m') AS later, epoch_ms(ts) AS ms FROM events""")
def scalar_dates(spark, d):
    m = F.date_format("ts", "yyyy-MM")
    return t(spark, d, "events").select("event_id", F.weekday("ts").alias("weekday"), F.hour("ts").alias("hour"), F.weekofyear("ts").alias("iso_week"), F.quarter("ts").alias("quarter"), m.alias("month"), scalars.month_add(m, 3).alias("later"), scalars.epoch_ms(F.col("ts")).alias("ms"))


@query("""WITH x AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN ' Yes' WHEN 1 THEN '0' WHEN 2 THEN '1,234.5' WHEN 3 THEN 'nan' WHEN 4 THEN '' ELSE event_type END AS s, props FROM events) SELECT event_id, CASE event_id % 6 WHEN 0 THEN true WHEN 1 THEN false END AS flag, CASE event_id % 6 WHEN 1 THEN 0.0 WHEN 2 THEN 1234.5 END::DOUBLE AS number, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.k.z') AS deep FROM x""")
def scalar_parsing(spark, d):
    i = F.col("event_id") % 6
    s = F.when(i == 0, " Yes").when(i == 1, "0").when(i == 2, "1,234.5").when(i == 3, "nan").when(i == 4, "").otherwise(F.col("event_type"))
    return t(spark, d, "events").withColumn("s", s).select("event_id", scalars.parsed_bool(F.col("s")).alias("flag"), scalars.parsed_number(F.col("s")).alias("number"), scalars.dotted("props", "k").alias("k"), scalars.dotted("props", "k.z").alias("deep"))


@query("""WITH g AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS a FROM events WHERE value > 30 GROUP BY 1) SELECT user_id, array_to_string(a, '|') AS kinds, len(a)::INTEGER AS n, list_contains(a, 'view') AS has_view, array_to_string(list_sort(list_distinct(list_concat(a, ['view', 'x']))), '|') AS united, CAST('0x' || substr(sha256(user_id || '|' || array_to_string(a, ',')), 1, 15) AS BIGINT) AS seed FROM g""")
def scalar_arrays(spark, d):
    g = t(spark, d, "events").where("value > 30").groupBy("user_id").agg(F.sort_array(F.collect_set("event_type")).alias("a"))
    return g.select("user_id", F.array_join("a", "|").alias("kinds"), F.size("a").alias("n"), F.array_contains("a", "view").alias("has_view"), F.array_join(F.sort_array(F.array_union("a", F.array(F.lit("view"), F.lit("x")))), "|").alias("united"), scalars.seed_of(F.col("user_id").cast("string"), F.array_join("a", ",")).alias("seed"))


@query(f"""{_B}, x AS (SELECT *, (close / nullif(lag(close, 3) OVER ({_W}), 0) - 1) * 100 AS r3, lead(close) OVER ({_W}) / nullif(close, 0) - 1 AS nxt FROM b), y AS (SELECT CASE WHEN r3 IS NULL THEN 'unknown' WHEN r3 < -50 THEN 'crash' WHEN r3 < -5 THEN 'down' WHEN r3 <= 5 THEN 'flat' WHEN r3 <= 100 THEN 'up' ELSE 'surge' END AS ret_bucket, CASE WHEN hour(bar) < 8 THEN 'asia' WHEN hour(bar) < 16 THEN 'europe' ELSE 'america' END AS hours, nxt FROM x)
SELECT ret_bucket, hours, count(*) AS n, round(avg(nxt), 3) AS mean, round(avg((nxt > 0)::INTEGER), 6) AS positive FROM y GROUP BY ALL""")
def regime_buckets(spark, d):
    w = Window.partitionBy("event_type").orderBy("bar")
    x = bars(spark, d).withColumns({"r3": (F.col("close") / F.nullif(F.lag("close", 3).over(w), F.lit(0.0)) - 1) * 100, "nxt": F.lead("close").over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1})
    b = studies.ladder(F.col("r3"), [(-50, "crash"), (-5, "down")], "surge", "unknown")
    b = F.when(F.col("r3") < -5, b).otherwise(studies.ladder(F.col("r3"), [(5, "flat"), (100, "up")], "surge", "unknown", closed=True))
    h = studies.ladder(F.hour("bar"), [(8, "asia"), (16, "europe")], "america")
    return studies.outcome_table(x, {"ret_bucket": b, "hours": h}, "nxt").select("ret_bucket", "hours", "n", r("mean", places=3), r("positive"))


@query(f"""WITH c AS (SELECT unnest([0.02, 0.05, 0.08])::DOUBLE AS cut), x AS (SELECT DISTINCT o_custkey, o_orderdate, side, move, net FROM ({PNL})) SELECT cut, count(*) AS n, round(avg(net), 6) AS mean, round(avg((net > 0)::INTEGER), 6) AS win_rate FROM x, c WHERE abs(move) >= cut - 1e-9 GROUP BY 1""")
def threshold_sweep(spark, d):
    x = _trades(spark, d).withColumn("move", (F.col("o_orderkey") % 21 - 10) / 100.0)
    return studies.threshold_sweep(x, ["o_custkey", "o_orderdate", "side"], "move", "net", [0.02, 0.05, 0.08]).select("cut", "n", r("mean"), r("win_rate"))


@query(f"""WITH x AS (SELECT side || '_' || o_orderpriority AS rule, month, o_custkey, net, month < TIMESTAMP '1996-01-01' AS train FROM {_M}), m AS (SELECT rule, month, sum(net) AS s FROM x GROUP BY ALL), p AS (SELECT rule, count(*) AS months, count(*) FILTER (round(s, 6) > 0) AS good FROM m GROUP BY 1), b AS (SELECT sha256('long_1-URGENT') AS h),
k AS (SELECT rule, max(c) / nullif(sum(c), 0) AS top FROM (SELECT rule, o_custkey, sum(abs(net)) AS c FROM x GROUP BY ALL) GROUP BY 1) SELECT x.rule, count(*) AS n, round(avg(net) FILTER (train), 5) AS train_mean, round(avg(net) FILTER (NOT train), 5) AS oos_mean, any_value(months) AS months, any_value(good) AS positive_months, round(any_value(top), 6) AS top_share
FROM x JOIN p USING (rule) JOIN k USING (rule) WHERE sha256(x.rule) NOT IN (SELECT h FROM b) GROUP BY 1""")
def rule_scan(spark, d):
    """Rules with train and later means, months, concentration; rules whose hash is blocked are left out."""
    x = _months(spark, d).withColumn("rule", F.concat_ws("_", "side", _PRIO))
    blocked = spark.createDataFrame([("long_1-URGENT",)], "rule string").select(F.sha2("rule", 256).alias("h"))
    s = studies.rule_scan(x, "rule", "month", "o_custkey", "net", F.col("month") < F.lit("1996-01-01").cast("timestamp_ntz"), blocked)
    return s.select("rule", "n", r("train_mean", places=5), r("oos_mean", places=5), "months", "positive_months", r("top_share"))


@query(f"""WITH x AS (SELECT o_orderpriority AS g, o_custkey, net FROM ({PNL})), s AS (SELECT g, o_custkey, count(*) AS n, sum(net) AS p FROM x GROUP BY ALL) SELECT g, sum(n)::BIGINT AS n, count(*) AS members, round(avg((round(p, 6) > 0)::INTEGER), 6) AS positive_members, round(max(abs(p)) / sum(abs(p)), 6) AS top_share,
CASE WHEN sum(n) < 50 THEN 'thin' WHEN avg((round(p, 6) > 0)::INTEGER) >= 0.5 AND max(abs(p)) / sum(abs(p)) < 0.2 THEN 'accept' ELSE 'reject' END AS verdict FROM s GROUP BY 1""")
def subset_validation(spark, d):
    s = studies.subset_validation(_trades(spark, d).withColumn("g", F.col(_PRIO)), ["g"], "o_custkey", "net", 50, 0.5, 0.2)
    return s.select("g", "n", "members", r("positive_members"), r("top_share"), "verdict")


@query("""WITH s AS (SELECT user_id, lag(event_type) OVER w AS a, event_type AS b, value, lead(value) OVER w AS nxt FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), m AS (SELECT a || '>' || b AS motif, count(*) AS n, avg(nxt - value) AS outcome FROM s WHERE a IS NOT NULL GROUP BY 1 HAVING count(*) >= 10)
SELECT motif, n, round(outcome, 5) AS outcome FROM m ORDER BY n DESC, motif LIMIT 15""")
def motif_outcomes(spark, d):
    return studies.motif_outcomes(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", "value", 2, 10, 15).select("motif", "n", r("outcome", places=5))


@query(f"""WITH e AS (SELECT side, count(*) AS k FROM ({PNL}) WHERE o_orderkey % 9 = 0 GROUP BY 1), y AS (SELECT x.*, k, round FROM ({PNL}) x JOIN e USING (side), (SELECT unnest(range(0, 15)) AS round)), z AS (SELECT *, row_number() OVER (PARTITION BY round, side ORDER BY md5('key-1:' || round || ':' || side || ':' || o_orderkey)) AS r FROM y)
SELECT round::INTEGER AS round, round(avg(net), 6) AS null_mean, count(*) AS n FROM z WHERE r <= k GROUP BY 1""")
def same_key_baseline(spark, d):
    return stats.permuted_means(_trades(spark, d), ["side"], "o_orderkey", F.col("o_orderkey") % 9 == 0, "net", 15, "key-1").select("round", r("null_mean"), "n")


@query(f"""WITH q AS (SELECT abs(move) AS v, count(*) AS n FROM ({TRADES}) GROUP BY 1) SELECT CASE WHEN v < 0.025 THEN 'small' WHEN v < 0.065 THEN 'middle' ELSE 'large' END AS class, sum(n)::BIGINT AS n FROM q GROUP BY 1""")
def size_classes(spark, d):
    v = F.abs((F.col("o_orderkey") % 21 - 10) / 100.0)
    return t(spark, d, "orders").groupBy(studies.ladder(v, [(0.025, "small"), (0.065, "middle")], "large").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH RECURSIVE o AS (SELECT o_custkey, o_orderkey, side, epoch_us(o_orderdate) AS a, epoch_us(o_orderdate) + 200 * 86400000000 AS z, o_orderkey % 5 AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderpriority, o_orderkey) AS i FROM ({TRADES})),
g AS (SELECT o_custkey, o_orderkey, i, [{{'z': z, 'm': m, 's': side}}] AS open, 'accept' AS decision FROM o WHERE i = 1
UNION ALL SELECT o.o_custkey, o.o_orderkey, o.i, CASE WHEN dec = 'accept' THEN list_append(kept, {{'z': o.z, 'm': o.m, 's': o.side}}) ELSE kept END, dec FROM (
 SELECT n.*, kept, CASE WHEN len(list_filter(kept, lambda x: x.m = n.m)) > 0 THEN 'overlap' WHEN len(kept) >= 3 THEN 'total' WHEN len(list_filter(kept, lambda x: x.s = n.side)) >= 2 THEN 'side' ELSE 'accept' END AS dec FROM (SELECT o.*, list_filter(g.open, lambda x: x.z > o.a) AS kept FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.i = g.i + 1) n) o)
SELECT o_orderkey, decision FROM g""")
def admission_gate(spark, d):
    from tidemark.operators import admission

    x = _trades(spark, d).withColumn("until", F.expr("o_orderdate + INTERVAL 200 DAYS")).withColumn("member", F.col("o_orderkey") % 5)
    return admission.admitted(x, "o_custkey", ["o_orderdate", _PRIO, "o_orderkey"], "o_orderdate", "until", "member", {"side": 2}, 3).select("o_orderkey", "decision")


@query("""WITH f AS (SELECT l_suppkey, avg(l_quantity) AS a, CASE WHEN l_suppkey % 7 <> 0 THEN avg(l_discount) END AS b FROM lineitem GROUP BY 1), q AS (SELECT quantile_cont(a, 0.25) AS a1, median(a) AS a2, quantile_cont(a, 0.75) AS a3, quantile_cont(b, 0.25) AS b1, median(b) AS b2, quantile_cont(b, 0.75) AS b3 FROM f),
z AS (SELECT l_suppkey, greatest(-8, least(8, coalesce((a - a2) / nullif(a3 - a1, 0), 0))) AS za, greatest(-8, least(8, coalesce((b - b2) / nullif(b3 - b1, 0), 0))) AS zb FROM f, q) SELECT l_suppkey, round(za, 5) AS a_z, round(zb, 5) AS b_z FROM z""")
def robust_scaling(spark, d):
    from tidemark.functions import clusters

    f = t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("b")).withColumn("b", F.when(F.col("l_suppkey") % 7 != 0, F.col("b")))
    return clusters.robust_scaled(f, ["a", "b"]).select("l_suppkey", r("a_z", places=5), r("b_z", places=5))


@query("""WITH v AS (SELECT o_custkey % 10 AS run, CASE o_orderkey % 3 WHEN 0 THEN 'gap' WHEN 1 THEN 'null' ELSE 'cost' END AS validator, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) AS res FROM orders GROUP BY ALL)
SELECT run, max(res) FILTER (validator = 'gap') AS gap, max(res) FILTER (validator = 'null') AS "null", max(res) FILTER (validator = 'cost') AS cost, count(*) FILTER (res = 'F') AS passed FROM v GROUP BY 1""")
def validator_synthesis(spark, d):
    """The latest result of each validator by run, side by side."""
    v = t(spark, d, "orders").withColumn("run", F.col("o_custkey") % 10).withColumn("validator", F.when(F.col("o_orderkey") % 3 == 0, "gap").when(F.col("o_orderkey") % 3 == 1, "null").otherwise("cost"))
    return studies.latest_results(v, "run", "validator", ["o_orderdate", "o_orderkey"], "o_orderstatus", ["gap", "null", "cost"], "F")


@query(f"""WITH e AS (SELECT *, round(sum(net) OVER w, 6) AS eq FROM ({PNL}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)), m AS (SELECT *, coalesce(min(eq) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS worst FROM e)
SELECT o_orderkey, CASE WHEN worst <= -150 THEN 'killed' WHEN worst <= -80 THEN 'halved' ELSE 'full' END AS capital FROM m""")
def loss_stops(spark, d):
    """What the losses before a trade leave of its capital."""
    return studies.loss_stops(_trades(spark, d), "o_custkey", ["o_orderdate", "o_orderkey"], "net", [(-150, "killed"), (-80, "halved")], "full").select("o_orderkey", "capital")


@query("""WITH x AS (SELECT o_orderkey, o_totalprice AS v, o_custkey % 3 = 0 AS f FROM orders WHERE o_totalprice IS NOT NULL), k AS (SELECT count(*) FILTER (f) AS k FROM x),
y AS (SELECT x.*, k, round, row_number() OVER (PARTITION BY round ORDER BY md5('plc-1:' || round || ':' || o_orderkey)) AS r FROM x, k, (SELECT unnest(range(0, 20)) AS round)),
l AS (SELECT round, v, r <= k AS f FROM y UNION ALL SELECT -1, v, f FROM x), c AS (SELECT round, v, count(*) FILTER (f) AS a, count(*) FILTER (NOT f) AS b FROM l GROUP BY ALL), m AS (SELECT *, sum(a + b) OVER (PARTITION BY round ORDER BY v) - (a + b - 1) / 2 AS rk FROM c),
s AS (SELECT round, sum(a) AS n1, sum(b) AS n2, sum(a * rk) AS r1, sum(((a + b)::DOUBLE ** 3) - (a + b)) AS ties FROM m GROUP BY 1), u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u, n1 * n2 / 2 AS mid, n1 * n2 / 12.0::DOUBLE * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1))) AS w FROM s),
z AS (SELECT round, (abs(u - mid) - 0.5) / sqrt(w) AS z FROM u), p AS (SELECT round, """ + _p("greatest(abs(z), 0)") + """ AS p FROM z)
SELECT count(*) FILTER (round >= 0) AS rounds, round(avg((p < 0.05)::INTEGER) FILTER (round >= 0), 6) AS significant, round(max(p) FILTER (round < 0), 6) AS p FROM p""")
def placebo_share(spark, d):
    x = nulls.placebo(t(spark, d, "orders"), "o_orderkey", "o_totalprice", F.col("o_custkey") % 3 == 0, 20, "plc-1")
    return x.select("rounds", r("significant"), r("p"))


@query("""WITH x AS (SELECT 'p_size' AS "column", p_size::DOUBLE AS v FROM part UNION ALL SELECT 'p_retailprice', p_retailprice FROM part) SELECT "column", count(*) AS n, min(v) AS least, max(v) AS most, round(avg(v), 5) AS mean FROM x GROUP BY 1""")
def candidate_profile(spark, d):
    """The numeric columns that look like features (no keys, no words of the future), profiled."""
    from tidemark.operators import filters, sections

    p = t(spark, d, "part")
    return sections.audit(p, filters.feature_columns(p)).select("column", "n", "least", "most", r("mean", places=5))
