"""Queries of predicates, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import filters, joins, relations, tables
from tidemark.plans.registry import BARS, PNL, TWO, bars, near, query, r, t

_B = f"WITH b AS ({BARS})"
_AT = "event_type, bar::TIMESTAMP AS bar"


def _two(spark, d):
    from tidemark.plans.catalogue import _two as two

    return two(spark, d)


_SPEC = {"l_quantity": {"min": 10, "under": 40}, "l_discount": {"max": 0.05}, "l_returnflag": {"among": ["A", "N"]}}


@query("""SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 40 AND l_discount <= 0.05 AND l_returnflag IN ('A', 'N') AND l_tax > 0.02 AND l_tax <= 0.06""")
def spec_mask(spark, d):
    return t(spark, d, "lineitem").where(filters.mask(_SPEC) & filters.mask({"l_tax": {"over": 0.02, "max": 0.06}})).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT filter, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM (SELECT l_extendedprice, unnest(list_filter([CASE WHEN l_quantity >= 25 THEN 'q25' END, CASE WHEN l_quantity >= 40 THEN 'q40' END, CASE WHEN l_discount >= 0.05 AND l_quantity >= 25 THEN 'q25_d5' END, CASE WHEN l_tax = 0 THEN 'untaxed' END], lambda x: x IS NOT NULL)) AS filter FROM lineitem) GROUP BY 1""")
def filter_fan_out(spark, d):
    q, x = F.col("l_quantity"), F.col("l_discount")
    rows = filters.fan_out(t(spark, d, "lineitem"), {"q25": q >= 25, "q40": q >= 40, "q25_d5": (x >= 0.05) & (q >= 25), "untaxed": F.col("l_tax") == 0})
    return rows.groupBy("filter").agg(F.count(F.lit(1)).alias("n"), r(F.avg("l_extendedprice"), "mean", 4))


@query(f"""WITH b AS (SELECT event_type, bar, CASE WHEN n % 5 = 0 THEN high + 1 ELSE open END AS open, high, CASE WHEN n % 7 = 0 THEN NULL ELSE low END AS low, CASE WHEN n % 11 = 0 THEN -1 ELSE close END AS close FROM ({BARS}))
SELECT faults, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN high < greatest(open, low, close) THEN 'high_low' END, CASE WHEN low > least(open, high, close) THEN 'low_high' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'not_positive' END, CASE WHEN low IS NULL THEN 'missing' END) AS faults FROM b) GROUP BY 1""")
def bar_sanity(spark, d):
    n = F.col("n")
    b = bars(spark, d).withColumns({"open": F.when(n % 5 == 0, F.col("high") + 1).otherwise(F.col("open")), "low": F.when(n % 7 != 0, F.col("low")), "close": F.when(n % 11 == 0, -1.0).otherwise(F.col("close"))})
    return b.groupBy(filters.bar_faults().alias("faults")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type, count(*) FILTER (epoch_us(ts) % 60000000 = 0) AS on_minute, count(*) FILTER (epoch_us(ts) % 1000000 = 0) AS on_second, count(*) AS n FROM events GROUP BY 1""")
def alignment(spark, d):
    return t(spark, d, "events").groupBy("event_type").agg(F.count(F.when(filters.aligned("ts", 60), 1)).alias("on_minute"), F.count(F.when(filters.aligned("ts", 1), 1)).alias("on_second"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND o_orderstatus IN ('F', 'P') AND o_custkey NOT IN (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, o_custkey LIMIT 20)""")
def without_top_members(spark, d):
    o = t(spark, d, "orders")
    top = o.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s")).orderBy(F.desc("s"), "o_custkey").limit(20)
    o = o.where("o_orderdate >= TIMESTAMP_NTZ '1996-01-01' AND o_orderdate < TIMESTAMP_NTZ '1997-01-01'").where(F.col("o_orderstatus").isin("F", "P"))
    return filters.without(o, top, ["o_custkey"]).select("o_orderkey")


@query("""WITH s AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN s_suppkey::VARCHAR WHEN 1 THEN 'BTC3L' WHEN 2 THEN '  eth ' WHEN 3 THEN 'A-B/C' WHEN 4 THEN NULL ELSE upper(replace(s_name, '#', '')) END AS sym FROM supplier), u AS (SELECT *, upper(trim(sym)) AS c FROM s)
SELECT s_suppkey, CASE WHEN c IS NULL OR c = '' THEN 'missing' WHEN regexp_matches(c, '^[0-9]+$') THEN 'numeric' WHEN NOT regexp_matches(c, '^[A-Z0-9]{1,20}$') THEN 'malformed' WHEN regexp_matches(c, '([235][LS]|UP|DOWN|BULL|BEAR)$') THEN 'leveraged' ELSE 'plain' END AS class FROM u""")
def symbol_classes(spark, d):
    k = F.col("s_suppkey")
    sym = F.when(k % 6 == 0, k.cast("string")).when(k % 6 == 1, "BTC3L").when(k % 6 == 2, "  eth ").when(k % 6 == 3, "A-B/C").when(k % 6 == 5, F.upper(F.replace("s_name", F.lit("#"), F.lit(""))))
    return t(spark, d, "supplier").withColumn("sym", sym).select("s_suppkey", filters.symbol_class("sym").alias("class"))


@query("""SELECT p_partkey, contains(lower(p_type), 'brass') AS brass, regexp_matches(p_name, '^[a-m]') AS early, p_type ILIKE 'standard%' AS standard FROM part WHERE contains(lower(p_type), 'brass') OR p_type ILIKE 'standard%'""")
def string_predicates(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.lower("p_type").contains("brass").alias("brass"), F.col("p_name").rlike("^[a-m]").alias("early"), F.col("p_type").ilike("standard%").alias("standard"))
    return p.where("brass OR standard")


@query("""WITH g AS (SELECT q AS least_q, x AS least_d FROM (VALUES (10), (20), (30), (40)) a(q), (VALUES (0.0), (0.03), (0.06)) b(x)) SELECT least_q, least_d::DOUBLE AS least_d, count(*) AS n, round(avg(l_extendedprice), 4) AS mean FROM lineitem JOIN g ON l_quantity >= least_q AND l_discount >= least_d::DOUBLE GROUP BY ALL""")
def rule_grid(spark, d):
    grid = spark.createDataFrame([(q, x) for q in (10, 20, 30, 40) for x in (0.0, 0.03, 0.06)], "least_q int, least_d double")
    met = (F.col("l_quantity") >= F.col("least_q")) & (F.col("l_discount") >= F.col("least_d"))
    return relations.graded(t(spark, d, "lineitem"), grid, met, ["least_q", "least_d"], "l_extendedprice").select("least_q", "least_d", "n", r("mean", places=4))


@query(f"""WITH {TWO} SELECT l.event_id, r.event_id AS r_event_id, false AS looks_ahead FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts - INTERVAL 2 HOUR >= r.ts""")
def asof_lagged(spark, d):
    l, x = _two(spark, d)
    return relations.asof_lagged(l, x, "user_id", "ts", ["event_id"], 7200, tie="event_id").select("event_id", "r_event_id", "looks_ahead")


@query(f"""WITH {TWO}, x AS (SELECT l.event_id, CASE WHEN l.event_id % 10 <> 0 THEN l.user_id END AS user_id, CASE WHEN l.event_id % 7 <> 0 THEN l.ts END AS ts FROM l), y AS (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN user_id END AS user_id, CASE WHEN event_id % 8 <> 0 THEN ts END AS ts FROM r)
SELECT x.event_id, y.event_id AS r_event_id FROM x ASOF LEFT JOIN y ON x.user_id = y.user_id AND x.ts >= y.ts""")
def asof_with_nulls(spark, d):
    l, x = _two(spark, d)
    hide = lambda df, a, b: df.withColumns({"user_id": F.when(F.col("event_id") % a != 0, F.col("user_id")), "ts": F.when(F.col("event_id") % b != 0, F.col("ts"))})
    return joins.asof(hide(l, 10, 7), hide(x, 9, 8), "user_id", "ts", ["event_id"], tie="event_id").select("event_id", "r_event_id")


@query(f"""WITH {TWO}, f AS (SELECT r.user_id, l.ts, r.value FROM r ASOF JOIN l ON r.user_id = l.user_id AND r.ts >= l.ts) SELECT user_id, ts, count(*) AS n, round(sum(value), 6) AS total FROM f GROUP BY ALL""")
def snapshot_flow(spark, d):
    l, x = _two(spark, d)
    return relations.in_snapshots(x, l, "user_id", "ts", [F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")]).select("user_id", "ts", "n", r("total"))


@query(f"""WITH {TWO}, a AS (SELECT l.*, r.value AS before FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts), b AS (SELECT a.*, r.value AS p0 FROM a ASOF LEFT JOIN r ON a.user_id = r.user_id AND a.ts + INTERVAL 1 HOUR <= r.ts),
c AS (SELECT b.*, r.value AS p1 FROM b ASOF LEFT JOIN r ON b.user_id = r.user_id AND b.ts + INTERVAL 25 HOUR <= r.ts) SELECT event_id, before, p0, p1, round((p1 / nullif(p0, 0) - 1) * 10000, 3) AS ret_bps FROM c""")
def delayed_return(spark, d):
    l, x = _two(spark, d)
    return relations.delayed_return(l, x, "user_id", "ts", "value", 3600, 86_400, "event_id").select("event_id", "before", "p0", "p1", r("ret_bps", places=3))


@query(f"""WITH RECURSIVE {TWO}, p AS (SELECT l.user_id, l.event_id AS a, r.event_id AS b, (epoch_us(r.ts) - epoch_us(l.ts)) / 1e6 AS distance_s, row_number() OVER (PARTITION BY l.user_id ORDER BY abs(epoch_us(r.ts) - epoch_us(l.ts)), l.event_id, r.event_id) AS i
 FROM l JOIN r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 24 HOUR AND l.ts + INTERVAL 24 HOUR),
g AS (SELECT user_id, 1 AS i, [a] AS ua, [b] AS ub, a, b, distance_s, true AS taken FROM p WHERE i = 1
 UNION ALL SELECT g.user_id, g.i + 1, CASE WHEN list_contains(ua, p.a) OR list_contains(ub, p.b) THEN ua ELSE list_append(ua, p.a) END, CASE WHEN list_contains(ua, p.a) OR list_contains(ub, p.b) THEN ub ELSE list_append(ub, p.b) END, p.a, p.b, p.distance_s, NOT (list_contains(ua, p.a) OR list_contains(ub, p.b)) FROM g JOIN p ON p.user_id = g.user_id AND p.i = g.i + 1)
SELECT user_id, a AS l_id, b AS r_id, distance_s FROM g WHERE taken""")
def greedy_pairs(spark, d):
    l, x = _two(spark, d)
    return relations.greedy_pairs(l, x, "user_id", "ts", 24 * 3600, "event_id", "event_id")


@query(f"""WITH {TWO} SELECT l.event_id, round(coalesce(sum(r.value), 0), 6) AS sum_around, count(r.value) AS n_around FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts BETWEEN l.ts - INTERVAL 12 HOUR AND l.ts + INTERVAL 6 HOUR GROUP BY 1""")
def around_sum(spark, d):
    l, x = _two(spark, d)
    return relations.around(l, x, "user_id", "ts", "value", 12 * 3600, 6 * 3600).select("event_id", r("sum_around"), "n_around")


@query(f"""WITH {TWO} SELECT l.event_id, """ + ", ".join(f"count(r.value) FILTER (r.ts > l.ts - INTERVAL {h} HOUR) AS count_{h * 3600}, round(coalesce(sum(CASE WHEN r.event_id % 2 = 0 THEN r.value ELSE -r.value END) FILTER (r.ts > l.ts - INTERVAL {h} HOUR), 0) / nullif(sum(r.value) FILTER (r.ts > l.ts - INTERVAL {h} HOUR), 0), 6) AS imbalance_{h * 3600}, max(r.value) FILTER (r.ts > l.ts - INTERVAL {h} HOUR) AS max_{h * 3600}, count(*) FILTER (r.value >= 20 AND r.ts > l.ts - INTERVAL {h} HOUR) AS large_{h * 3600}" for h in (6, 48)) + """
 FROM l LEFT JOIN r ON l.user_id = r.user_id AND r.ts <= l.ts AND r.ts > l.ts - INTERVAL 48 HOUR GROUP BY 1""")
def trailing_windows(spark, d):
    l, x = _two(spark, d)
    sign = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    out = relations.trailing_windows(l, x, "user_id", "ts", "value", sign, [6 * 3600, 48 * 3600], 20)
    return out.select("event_id", *[c for s in (21600, 172800) for c in (F.col(f"count_{s}"), r(f"imbalance_{s}"), F.col(f"max_{s}"), F.col(f"large_{s}"))])


@query("""WITH f AS (SELECT a.event_id, arg_min(b.value, (b.ts, b.event_id)) AS p FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts + INTERVAL 24 HOUR GROUP BY 1), m AS (SELECT a.event_id, max(b.value) AS hi, min(b.value) AS lo FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 24 HOUR GROUP BY 1)
SELECT event_id, round((p / nullif(value, 0) - 1) * 10000, 3) AS fwd_bps, round((hi / nullif(value, 0) - 1) * 10000, 3) AS best_bps, round((lo / nullif(value, 0) - 1) * 10000, 3) AS worst_bps FROM events LEFT JOIN f USING (event_id) LEFT JOIN m USING (event_id)""")
def forward_moves(spark, d):
    return relations.forward_moves(t(spark, d, "events"), "user_id", "ts", "value", 86_400, "event_id").select("event_id", r("fwd_bps", places=3), r("best_bps", places=3), r("worst_bps", places=3))


@query("""WITH a AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, event_type, max(value) AS v FROM events GROUP BY ALL) SELECT user_id, day, max(v) FILTER (event_type = 'view') AS view_v, max(v) FILTER (event_type = 'click') AS click_v, max(v) FILTER (event_type = 'signup') AS signup_v, string_agg(event_type, ',' ORDER BY event_type) AS sources
FROM a WHERE event_type IN ('view', 'click', 'signup') GROUP BY ALL""")
def merged_sources(spark, d):
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    part = lambda k: e.where(F.col("event_type") == k).groupBy("user_id", "day").agg(F.max("value").alias(f"{k}_v"))
    return relations.merge_sources({k: part(k) for k in ("view", "click", "signup")}, ["user_id", "day"])


@query(f"""{_B} SELECT a.bar::TIMESTAMP AS bar, a.close AS l_value, c.close AS r_value, n.close AS next_value FROM b a JOIN b c ON a.bar = c.bar AND c.event_type = 'click' LEFT JOIN b n ON n.event_type = 'view' AND n.bar = a.bar + INTERVAL 1 HOUR WHERE a.event_type = 'view'""")
def intersected_times(spark, d):
    b = bars(spark, d)
    of = lambda k: b.where(F.col("event_type") == k).withColumn("one", F.lit(1))
    return relations.intersected(of("view"), of("click"), "one", "bar", 3600, "close").select("bar", "l_value", "r_value", "next_value")


@query("""SELECT coalesce(a, b) AS suppkey, CASE WHEN b IS NULL THEN 'left' WHEN a IS NULL THEN 'right' ELSE 'both' END AS "where" FROM (SELECT DISTINCT l_suppkey AS a FROM lineitem WHERE l_quantity = 50 AND l_tax = 0) FULL JOIN (SELECT DISTINCT l_suppkey AS b FROM lineitem WHERE l_quantity = 1 AND l_tax = 0) ON a = b""")
def key_inventory(spark, d):
    x = t(spark, d, "lineitem").where("l_tax = 0").withColumnRenamed("l_suppkey", "suppkey")
    return relations.inventory(x.where("l_quantity = 50"), x.where("l_quantity = 1"), ["suppkey"])


@query("""WITH l AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity = 50), r AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity = 1 AND l_tax = 0)
SELECT 'left' AS side, count(*) AS n, coalesce(sum(k), 0)::BIGINT AS total FROM (SELECT k FROM l EXCEPT SELECT k FROM r) UNION ALL SELECT 'both', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM l INTERSECT SELECT k FROM r) UNION ALL SELECT 'any', count(*), coalesce(sum(k), 0)::BIGINT FROM (SELECT k FROM l UNION SELECT k FROM r)""")
def set_operations(spark, d):
    x = t(spark, d, "lineitem")
    l, b = x.where("l_quantity = 50").select("l_suppkey").distinct(), x.where("l_quantity = 1 AND l_tax = 0").select("l_suppkey").distinct()
    of = lambda df, k: df.agg(F.lit(k).alias("side"), F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("l_suppkey"), F.lit(0)).alias("total"))
    return of(relations.apart(l, b).where("side = 'left'"), "left").unionByName(of(l.intersect(b), "both")).unionByName(of(l.union(b).distinct(), "any"))


@query("""WITH m AS (SELECT date_trunc('month', o_orderdate) AS month, round(avg(o_totalprice), 2) AS level FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice / level, 6) AS relative FROM orders LEFT JOIN m ON date_trunc('month', o_orderdate) = month""")
def month_dimension(spark, d):
    o = t(spark, d, "orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    return tables.with_level(o, ["month"], "o_totalprice", places=2).select("o_orderkey", r(F.col("o_totalprice") / F.col("level"), "relative"))


@query("""SELECT o_orderpriority, count(*) AS n, round(avg((o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 48))::INTEGER), 6) AS rate FROM orders GROUP BY 1""")
def key_match_rate(spark, d):
    right = t(spark, d, "lineitem").where("l_quantity >= 48").withColumnRenamed("l_orderkey", "o_orderkey")
    return relations.match_rate(t(spark, d, "orders"), right, ["o_orderkey"], ["o_orderpriority"]).select("o_orderpriority", "n", r("rate"))


@query("""WITH p AS (SELECT user_id, arg_max(value, (ts, event_id)) AS mark FROM events GROUP BY 1), o AS (SELECT event_id, user_id, value AS entry, CASE WHEN event_id % 2 = 0 THEN 'short' ELSE 'long' END AS side FROM events WHERE event_type = 'signup')
SELECT event_id, mark, round(CASE WHEN side = 'short' THEN -1 ELSE 1 END * (mark / nullif(entry, 0) - 1) * 10000, 3) AS mtm_bps FROM o LEFT JOIN p USING (user_id)""")
def mark_to_market(spark, d):
    e = t(spark, d, "events")
    o = e.where("event_type = 'signup'").select("event_id", "user_id", F.col("value").alias("entry"), F.when(F.col("event_id") % 2 == 0, "short").otherwise("long").alias("side"))
    return relations.marked_to_market(o, e, "user_id", "ts", "value", "event_id", "entry", "side").select("event_id", "mark", near("mtm_bps", places=3))


@query("""SELECT l_orderkey, l_linenumber, count(*) AS times, count(DISTINCT l_partkey) AS versions, CASE WHEN count(DISTINCT l_partkey) > 1 THEN 'conflicting' ELSE 'exact' END AS kind FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, d):
    return relations.duplicates(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_partkey"])


@query("""SELECT l_orderkey, l_linenumber, max(l_shipdate) AS l_shipdate, arg_max(l_partkey, (l_shipdate, l_partkey)) AS l_partkey FROM lineitem GROUP BY ALL""")
def duplicates_resolved(spark, d):
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey")
    return relations.resolved(x, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey"])


@query("""WITH x AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN value END AS a, CASE WHEN event_id % 4 = 0 THEN event_type END AS b FROM events) SELECT user_id, arg_max(a, (ts, event_id)) FILTER (a IS NOT NULL) AS a, arg_max(b, (ts, event_id)) FILTER (b IS NOT NULL) AS b FROM x GROUP BY 1""")
def collapsed_columns(spark, d):
    i = F.col("event_id")
    x = t(spark, d, "events").withColumns({"a": F.when(i % 3 == 0, F.col("value")), "b": F.when(i % 4 == 0, F.col("event_type"))})
    return relations.collapsed(x, "user_id", ["ts", "event_id"], ["a", "b"])


@query(f"""SELECT o_custkey, coalesce(sum(net) FILTER (side = 'long'), 0) > 0 AS long_pays, count(DISTINCT side) AS sides FROM ({PNL}) GROUP BY 1""")
def side_flags(spark, d):
    from tidemark.plans.catalogue import _trades

    x = _trades(spark, d).withColumn("side", F.when(F.col("o_orderkey") % 2 == 0, "long").otherwise("short"))
    return tables.sides_paid(x, ["o_custkey"], ["o_orderkey"], "side", "net", "long").select("o_custkey", F.col("pays").alias("long_pays"), "sides")
