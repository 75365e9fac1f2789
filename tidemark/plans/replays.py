"""Queries of replays, joint nulls and control baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import replays
from tidemark.plans.evaluation import _M, _months, _trades, _u
from tidemark.plans.registry import PNL, query, r, t


def _of(seed: str, *parts: str) -> str:
    """uniform() of a seed and parts, in SQL."""
    return _u(f"'{seed}'" + "".join(f" || ':' || {p}" for p in parts))


@query(f"""WITH x AS (SELECT side, round(net, 6) AS v, row_number() OVER (PARTITION BY side ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY side) AS n FROM ({PNL})),
g AS (SELECT side, n, least(200, n) AS m, greatest(10, least(100, least(200, n) // 4)) AS len FROM x GROUP BY ALL), d0 AS (SELECT g.*, round, unnest(range(0, m)) AS j FROM g, (SELECT unnest(range(0, 20)) AS round)),
d AS (SELECT side, round, j, 'rows' AS k, floor({_of('rep-rows', 'round', 'side', 'j')} * n)::BIGINT AS i FROM d0 UNION ALL SELECT side, round, j, 'labels', floor({_of('rep-labels', 'round', 'side', 'j')} * n)::BIGINT FROM d0
 UNION ALL SELECT side, round, j, 'entries', floor({_of('rep-entries', 'round', 'side', 'j')} * n)::BIGINT FROM d0 UNION ALL SELECT side, round, j, 'block', floor({_of('rep-block', 'round', 'side')} * (n - len))::BIGINT + j FROM d0 WHERE j < len AND n > len),
y AS (SELECT d.*, v FROM d JOIN x USING (side, i)), q AS (SELECT side, round, quantile_cont(abs(v), 0.7) AS far, quantile_cont(v, [0.25, 0.5, 0.75]) AS q FROM y WHERE k = 'rows' GROUP BY ALL),
z AS (SELECT y.*, far, q, {_of('rep-member', 'round', 'side', 'j')} > 0.25 AS kept, CASE WHEN {_of('rep-sign', 'round', 'side', 'j')} < 0.5 THEN -v ELSE v END AS sv FROM y JOIN q USING (side, round)),
s AS (SELECT side, round, any_value(q) AS q, sqrt(count(*) FILTER (k = 'rows')) AS root, avg(v) FILTER (k = 'rows') * sqrt(count(*) FILTER (k = 'rows')) AS ro, avg(v) FILTER (k = 'labels') * sqrt(count(*) FILTER (k = 'labels')) AS la,
 avg(v) FILTER (k = 'entries') * sqrt(count(*) FILTER (k = 'entries')) AS en, avg(v) FILTER (k = 'block') * sqrt(count(*) FILTER (k = 'block')) AS bl, avg(v) FILTER (k = 'rows' AND kept) * sqrt(count(*) FILTER (k = 'rows' AND kept)) AS mo,
 avg(v) FILTER (k = 'rows' AND abs(v) >= far * (1 - 1e-12)) * sqrt(count(*) FILTER (k = 'rows' AND abs(v) >= far * (1 - 1e-12))) AS lg, avg(sv) FILTER (k = 'rows') * sqrt(count(*) FILTER (k = 'rows')) AS si FROM z GROUP BY ALL),
u AS (SELECT side, round, unnest([{{'method': 'rows', 'score': ro}}, {{'method': 'labels', 'score': la}}, {{'method': 'entries', 'score': en}}, {{'method': 'signs', 'score': si}}, {{'method': 'large', 'score': lg}}, {{'method': 'flipped', 'score': -ro}},
 {{'method': 'medians', 'score': q[2] * root}}, {{'method': 'quarters', 'score': q[floor({_of('rep-quarter', 'round', 'side')} * 3)::INTEGER + 1] * root}}, {{'method': 'members_out', 'score': coalesce(mo, ro)}}, {{'method': 'block', 'score': coalesce(bl, ro)}},
 {{'method': 'groups_out', 'score': CASE WHEN {_of('rep-group', 'round', 'side')} < 0.25 THEN 0 ELSE ro END}}, {{'method': 'costs', 'score': ro - (5.0 + 30.0 * {_of('rep-cost', 'round', 'side')})}}], recursive := true) FROM s)
SELECT side, round::INTEGER AS round, method, round(score, 5) AS score FROM u""")
def replay_methods(spark, d):
    x = _trades(spark, d).withColumn("net", F.round("net", 6))
    return replays.replays(x, ["side"], ["o_orderdate", "o_orderkey"], "net", 20, 200, "rep").select("side", "round", "method", r("score", places=5))


_PERIODS = [f"{y}-{m:02d}" for y in (1995, 1996) for m in range(1, 13)]
_STEPS = ", ".join(f"'{a}>{b}'" for a, b in replays.STEPS)


@query(f"""WITH days AS (SELECT o_orderdate AS day, strftime(o_orderdate, '%Y-%m') AS period, count(*)::DOUBLE AS orders, round(avg(o_totalprice), 6) AS price FROM orders GROUP BY ALL),
pos AS (SELECT *, row_number() OVER (ORDER BY day) - 1 AS i FROM days), c0 AS (SELECT i, 'orders' AS state, orders AS v FROM pos UNION ALL SELECT i, 'price', price FROM pos WHERE price IS NOT NULL),
cuts AS (SELECT state, round(quantile_cont(v, 0.33), 9) AS a, round(quantile_cont(v, 0.67), 9) AS b FROM c0 GROUP BY 1 HAVING count(*) >= 100), cells AS (SELECT i, state, CASE WHEN v <= a THEN 0 WHEN v >= b THEN 2 ELSE 1 END AS bucket FROM c0 JOIN cuts USING (state)),
places AS (SELECT i, period FROM pos), known AS (SELECT unnest({_PERIODS}) AS period), ro AS (SELECT unnest(range(0, 12)) AS round),
nm AS (SELECT round, period, row_number() OVER (PARTITION BY round ORDER BY period) AS k, row_number() OVER (PARTITION BY round ORDER BY md5('joint-periods:' || round || ':' || period), period) AS rk FROM known, ro),
renamed AS (SELECT ro.round, i, i AS pl, coalesce(y.period, p.period) AS period FROM places p CROSS JOIN ro LEFT JOIN nm x ON x.round = ro.round AND x.period = p.period LEFT JOIN nm y ON y.round = ro.round AND y.rk = x.k),
bk AS (SELECT i // 28 AS b, count(*) AS len FROM places GROUP BY 1),
b1 AS (SELECT round, b, sum(len) OVER (PARTITION BY round ORDER BY md5('joint-blocks:' || round || ':' || b), b ROWS UNBOUNDED PRECEDING)::BIGINT - len AS start FROM bk, ro),
b2 AS (SELECT round, state, b, sum(len) OVER (PARTITION BY round, state ORDER BY md5('joint-alone:' || round || ':' || state || ':' || b), b ROWS UNBOUNDED PRECEDING)::BIGINT - len AS start FROM bk, ro, (SELECT state FROM cuts)),
m1 AS (SELECT round, p.i, start + p.i % 28 AS pl, w.period FROM places p JOIN b1 ON b = p.i // 28 JOIN places w ON w.i = start + p.i % 28), m2 AS (SELECT round, state, p.i, start + p.i % 28 AS pl, w.period FROM places p JOIN b2 ON b = p.i // 28 JOIN places w ON w.i = start + p.i % 28),
ins AS (SELECT i, period, row_number() OVER (PARTITION BY period ORDER BY i) AS k FROM places JOIN known USING (period)), dr AS (SELECT round, period, i, row_number() OVER (PARTITION BY round, period ORDER BY md5('joint-within:' || round || ':' || period || ':' || i), i) AS k FROM ins, ro),
wi AS (SELECT round, dr.i, ins.i AS pl, dr.period FROM dr JOIN ins USING (period, k) UNION ALL SELECT round, i, i, period FROM places, ro WHERE period NOT IN (SELECT period FROM known)),
al AS (SELECT 'observed' AS model, 0 AS round, state, i AS pl, period, bucket FROM cells JOIN places USING (i) UNION ALL SELECT 'periods', round, state, pl, period, bucket FROM cells JOIN renamed USING (i) UNION ALL SELECT 'blocks', round, state, pl, period, bucket FROM cells JOIN m1 USING (i)
 UNION ALL SELECT 'alone', round, state, pl, period, bucket FROM cells JOIN m2 USING (i, state) UNION ALL SELECT 'within', round, state, pl, period, bucket FROM cells JOIN wi USING (i)),
lg AS (SELECT *, lag(bucket) OVER (PARTITION BY model, round, state ORDER BY pl) AS p FROM al), c AS (SELECT model, round, state, period, p || '>' || bucket AS step, count(*) AS c FROM lg WHERE p IS NOT NULL GROUP BY ALL),
a AS (SELECT model, round, state, sum(c) AS a FROM c GROUP BY ALL), s AS (SELECT model, round, state, step, sum(c) AS s FROM c GROUP BY ALL), tt AS (SELECT model, round, state, period, sum(c) AS t FROM c GROUP BY ALL),
g AS (SELECT model, round, state, step, period, t, coalesce(c / t, 0)::DOUBLE AS rate, greatest(0.001, least(0.999, coalesce(s, 0) / a))::DOUBLE AS base FROM a CROSS JOIN (SELECT unnest([{_STEPS}]) AS step) CROSS JOIN known LEFT JOIN s USING (model, round, state, step) LEFT JOIN tt USING (model, round, state, period) LEFT JOIN c USING (model, round, state, period, step)),
sc AS (SELECT *, round(least(4.0, abs(rate - base) / greatest(sqrt(base * (1 - base) / greatest(coalesce(t, 0), 1)), 1e-6) / 3), 9) AS score FROM g), ax AS (SELECT model, round, state, step, count(t) AS active, count(*) FILTER (score >= 0.3) AS good, round(sum(score), 6) AS total FROM sc GROUP BY ALL),
runs AS (SELECT model, round, count(*) FILTER (active >= 12 AND good >= 12 AND total >= 6.0) AS axes, max(total) AS best FROM ax GROUP BY ALL), o AS (SELECT axes AS observed_axes, best AS observed_best FROM runs WHERE model = 'observed')
SELECT model, observed_axes, round(observed_best, 5) AS observed_best, count(*) AS rounds, round(avg((axes >= observed_axes)::INTEGER), 6) AS p_count, round(avg((best >= observed_best)::INTEGER), 6) AS p_best, round(avg((axes >= observed_axes AND best >= observed_best)::INTEGER), 6) AS p_joint
FROM runs, o WHERE model <> 'observed' GROUP BY ALL""")
def joint_null(spark, d):
    days = t(spark, d, "orders").groupBy("o_orderdate").agg(F.count(F.lit(1)).cast("double").alias("orders"), F.round(F.avg("o_totalprice"), 6).alias("price"))
    days = days.withColumn("period", F.date_format("o_orderdate", "yyyy-MM"))
    x = replays.joint_null(days, "o_orderdate", "period", ["orders", "price"], _PERIODS, 12, 28, "joint", replays.Strict(0.3, 6.0, 12))
    return x.select("model", "observed_axes", r("observed_best", places=5), "rounds", r("p_count"), r("p_best"), r("p_joint"))


_MODES = {
    "as_drawn": replays.Mode(),
    "scaled": replays.Mode(scale=(0.75, 1.25), steps=(-1, 0, 0, 1)),
    "noisy": replays.Mode(noise=(0.2, 100.0), steps=(-2, -1, 0, 1, 2)),
    "redrawn": replays.Mode(scale=(0.5, 1.5), redrawn=True),
    "flipped": replays.Mode(flipped=True),
    "costly": replays.Mode(cost=75.0, steps=(0, 0, -1)),
}


def _strategies(where: str, key: str) -> str:
    return f"(SELECT k, sum(v) AS total, count(*) FILTER (v > 0) AS positive, count(*) AS active, sum(n) AS events FROM (SELECT {key} AS k, month(o_orderdate) AS m, round(sum(net), 4) AS v, count(*) AS n FROM {_M} WHERE {where} GROUP BY ALL) GROUP BY 1)"


def _mode_sql(name: str, m: replays.Mode) -> str:
    u = lambda k, *more: _of(f"ctl-{k}", f"'{name}'", "round", "slot", *more)
    noise = f"+ sqrt(-2 * ln(greatest({u('noise-u')}, 1e-12))) * cos(2 * 3.141592653589793::DOUBLE * {u('noise-v')}) * greatest(abs(total) * {m.noise[0]}, {m.noise[1]})" if m.noise != (0.0, 0.0) else ""
    total = f"total * {-1.0 if m.flipped else 1.0} * ({m.scale[0]} + {m.scale[1] - m.scale[0]} * {u('scale')}) {noise} - {m.cost} * {u('cost')} * greatest(1.0, events / 100)"
    good = "+".join(f"({u('good', chr(39) + str(k) + chr(39))} < positive / 12)::INTEGER" for k in range(12)) if m.redrawn else "12 - positive" if m.flipped else "positive"
    step = f"({list(m.steps)})[floor({u('step')} * {len(m.steps)})::INTEGER + 1]"
    return f"SELECT '{name}' AS mode, round, ({total})::DOUBLE AS total, greatest(0, least(12, {good} + {step})) AS positive, active FROM (SELECT round, slot, floor({u('pick')} * n)::BIGINT AS i FROM sl) JOIN pool USING (i)"


@query(f"""WITH cand AS {_strategies("side = 'long'", "o_custkey % 7")}, pool AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i FROM {_strategies("true", "o_custkey % 40")}), b AS (SELECT quantile_cont(total, 0.95) AS p95, max(total) AS top, count(*) AS n FROM pool),
re AS (SELECT count(*) AS slots, max(total) AS best, count(*) FILTER (active >= 8 AND positive >= 8 AND total > 0) AS st, count(*) FILTER (active >= 8 AND positive >= 8 AND total > 0 AND total > p95 AND total > top) AS ad FROM cand, b),
sl AS (SELECT n, round, unnest(range(0, slots)) AS slot FROM b, re, (SELECT unnest(range(0, 40)) AS round)), x AS ({" UNION ALL ".join(_mode_sql(k, m) for k, m in _MODES.items())}),
runs AS (SELECT mode, round, count(*) FILTER (active >= 8 AND positive >= 8 AND total > 0) AS s, count(*) FILTER (active >= 8 AND positive >= 8 AND total > 0 AND total > p95 AND total > top) AS a, max(total) AS t FROM x, b GROUP BY ALL),
o AS (SELECT mode, count(*) AS rounds, avg((s > 0)::INTEGER) AS any_strict, avg((a > 0)::INTEGER) AS any_adjusted, avg(s) AS mean_strict, quantile_cont(t, 0.5) AS p50, quantile_cont(t, 0.95) AS p95, (1 + count(*) FILTER (t >= best)) / (1 + count(*)) AS p_best,
 (1 + count(*) FILTER (s >= st)) / (1 + count(*)) AS p_strict, (1 + count(*) FILTER (a >= ad)) / (1 + count(*)) AS p_adjusted FROM runs, re GROUP BY 1)
SELECT mode, rounds, round(any_strict, 6) AS any_strict, round(any_adjusted, 6) AS any_adjusted, round(mean_strict, 6) AS mean_strict, round(p50, 3) AS p50_best, round(p95, 3) AS p95_best, round(p_best, 6) AS p_best, round(p_strict, 6) AS p_strict, round(p_adjusted, 6) AS p_adjusted,
 CASE WHEN any_adjusted > 0.1 OR any_strict > 0.25 THEN 'HIGH' WHEN any_adjusted > 0.02 OR any_strict > 0.05 THEN 'MODERATE' ELSE 'LOW' END AS risk FROM o""")
def control_baseline(spark, d):
    def strategies(rows, n):
        m = rows.groupBy((F.col("o_custkey") % n).alias("k"), F.month("month").alias("m")).agg(F.round(F.sum("net"), 4).alias("v"), F.count(F.lit(1)).alias("n"))
        return m.groupBy("k").agg(F.sum("v").alias("total"), F.count(F.when(F.col("v") > 0, 1)).alias("positive"), F.count(F.lit(1)).alias("active"), F.sum("n").alias("events"))

    x = _months(spark, d)
    out = replays.control_baseline(strategies(x.where("side = 'long'"), 7), strategies(x, 40), _MODES, 40, "ctl", ["k"], need=8)
    return out.select("mode", "rounds", r("any_strict"), r("any_adjusted"), r("mean_strict"), r("p50_best", places=3), r("p95_best", places=3), r("p_best"), r("p_strict"), r("p_adjusted"), "risk")
