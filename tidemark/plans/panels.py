"""Queries of cross-sections, groups, shares, bins and order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import sections, series, tables
from tidemark.plans.registry import BARS, MONTHS, PNL, bars, near, query, r, t

_K = ["event_type", "bar"]
_B = f"WITH b AS ({BARS})"
_AT = "event_type, bar::TIMESTAMP AS bar"


def _months(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("month")).agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"))


def _trades(spark, d):
    from tidemark.plans.catalogue import _trades as trades

    return trades(spark, d)


@query(f"""SELECT month, count(revenue) AS members, round(avg(revenue), 6) AS mean, round(stddev_samp(revenue), 6) AS std, round(median(revenue), 6) AS median, round(quantile_cont(revenue, 0.1), 6) AS q10, round(quantile_cont(revenue, 0.25), 6) AS q25,
round(quantile_cont(revenue, 0.75), 6) AS q75, round(quantile_cont(revenue, 0.9), 6) AS q90 FROM ({MONTHS}) GROUP BY 1""")
def section_stats(spark, d):
    s = sections.section_stats(_months(spark, d), ["month"], "revenue", {"q10": 0.1, "q25": 0.25, "q75": 0.75, "q90": 0.9})
    return s.select("month", "members", *[near(c) for c in ("mean", "std", "median", "q10", "q25", "q75", "q90")])


@query(f"""WITH p AS ({MONTHS}), s AS (SELECT month, avg(revenue) AS m, stddev_samp(revenue) AS sd, median(revenue) AS q FROM p GROUP BY 1) SELECT l_suppkey, p.month, round(m, 4) AS sec_mean, round(q, 4) AS sec_median, CASE WHEN sd > 0 THEN round((revenue - m) / sd, 6) END AS sec_z FROM p JOIN s USING (month)""")
def section_zscores(spark, d):
    return sections.with_section(_months(spark, d), ["month"], "revenue").select("l_suppkey", "month", near("sec_mean", places=4), near("sec_median", places=4), near("sec_z"))


@query(f"""{_B} SELECT bar::TIMESTAMP AS bar, round(avg((close > open)::INTEGER), 6) AS rising, round(avg((close > 1.02 * open)::INTEGER), 6) AS over_2pct, round(avg((total > 100)::INTEGER), 6) AS busy FROM b GROUP BY 1""")
def breadth(spark, d):
    c, o = F.col("close"), F.col("open")
    return sections.breadth(bars(spark, d), ["bar"], {"rising": c > o, "over_2pct": c > 1.02 * o, "busy": F.col("total") > 100}).select("bar", r("rising"), r("over_2pct"), r("busy"))


@query(f"""{_B}, i AS (SELECT bar, avg(close) AS m FROM b GROUP BY 1) SELECT date_trunc('day', bar)::TIMESTAMP AS day, count(m) AS n, round(sum(m), 8) AS total, round(avg(m), 8) AS mean FROM i GROUP BY 1""")
def two_level_means(spark, d):
    x = bars(spark, d).withColumn("day", F.date_trunc("day", "bar").cast("timestamp_ntz"))
    return sections.two_level(x, ["bar"], ["day"], "close").select("day", "n", near("total", places=8), near("mean", places=8))


@query("""SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS month, round(avg(l_quantity), 6) AS l_quantity_mean, round(stddev_samp(l_quantity), 6) AS l_quantity_std, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_samp(l_extendedprice), 4) AS l_extendedprice_std,
round(avg(l_discount), 6) AS l_discount_mean, round(stddev_samp(l_discount), 6) AS l_discount_std FROM lineitem GROUP BY 1""")
def month_profile(spark, d):
    x = t(spark, d, "lineitem").withColumn("month", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz"))
    p = sections.profile(x, ["month"], ["l_quantity", "l_extendedprice", "l_discount"])
    return p.select("month", *[r(c, places=4 if "price" in c else 6) for c in p.columns[1:]])


@query(f"""WITH p AS (SELECT *, lag(revenue) OVER (PARTITION BY l_suppkey ORDER BY month) AS before FROM ({MONTHS})), q AS (SELECT *, revenue - before AS move FROM p WHERE before IS NOT NULL),
l AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY revenue DESC, l_suppkey) AS r, count(*) OVER (PARTITION BY month) AS n FROM q), m AS (SELECT * FROM l WHERE r <= ceil(n * 0.5)),
s AS (SELECT *, floor(count(*) OVER (PARTITION BY month) * 0.2) AS k, row_number() OVER (PARTITION BY month ORDER BY move DESC, l_suppkey) AS u, row_number() OVER (PARTITION BY month ORDER BY move, l_suppkey) AS v FROM m),
x AS (SELECT l_suppkey, month, CASE WHEN u <= k THEN 'long' WHEN v <= k THEN 'short' END AS side, revenue > 1.5 * before AS c FROM s) SELECT l_suppkey, month, side FROM x WHERE (side = 'long' AND c) OR (side = 'short' AND NOT c)""")
def two_stage_tail(spark, d):
    p = _months(spark, d).withColumn("before", F.lag("revenue").over(Window.partitionBy("l_suppkey").orderBy("month"))).where("before IS NOT NULL").withColumn("move", F.col("revenue") - F.col("before"))
    return sections.two_stage_tail(p, ["month"], "revenue", "move", "l_suppkey", 0.5, 0.2, F.col("revenue") > 1.5 * F.col("before")).select("l_suppkey", "month", "side")


@query(f"""WITH p AS ({MONTHS}), s AS (SELECT month, list_sort(list(revenue)) AS v, count(*) AS n FROM p GROUP BY 1), c AS (SELECT month, CASE WHEN n >= 5 THEN v[ceil(n * 0.2)::BIGINT] END AS low, CASE WHEN n >= 5 THEN v[least(floor(n * 0.8)::BIGINT, n - 1) + 1] END AS high FROM s)
SELECT l_suppkey, month, CASE WHEN revenue >= high THEN 'high' WHEN revenue <= low THEN 'low' END AS gate FROM p JOIN c USING (month) WHERE revenue >= high OR revenue <= low""")
def rank_gate(spark, d):
    x = sections.order_statistics(_months(spark, d), ["month"], "revenue", 0.2, 0.8, 5)
    gate = F.when(F.col("revenue") >= F.col("high"), "high").when(F.col("revenue") <= F.col("low"), "low")
    return x.withColumn("gate", gate).where("gate IS NOT NULL").select("l_suppkey", "month", "gate")


@query(f"""WITH p AS ({MONTHS}), r AS (SELECT *, count(*) OVER (PARTITION BY month) AS k, row_number() OVER (PARTITION BY month ORDER BY revenue DESC, l_suppkey) AS u, row_number() OVER (PARTITION BY month ORDER BY revenue, l_suppkey) AS v, lead(revenue) OVER (PARTITION BY l_suppkey ORDER BY month) / nullif(revenue, 0) - 1 AS ret FROM p),
s AS (SELECT *, CASE WHEN u <= floor(k * 0.2) THEN 'long' WHEN v <= floor(k * 0.2) THEN 'short' END AS side FROM r WHERE k >= 5), m AS (SELECT month, avg(CASE WHEN side = 'long' THEN ret END) AS l, avg(CASE WHEN side = 'short' THEN ret END) AS h FROM s WHERE side IS NOT NULL GROUP BY 1)
SELECT month, round(l - h, 4) AS gross, round(l - h - 0.02, 4) AS net FROM m WHERE l IS NOT NULL AND h IS NOT NULL""")
def tail_spread(spark, d):
    nxt = F.lead("revenue").over(Window.partitionBy("l_suppkey").orderBy("month"))
    p = _months(spark, d).withColumn("ret", nxt / F.nullif(F.col("revenue"), F.lit(0.0)) - 1)
    return sections.spread(series.tails(p, ["month"], "revenue", "l_suppkey", 0.2, 5), ["month"], "side", "ret", 0.01).select("month", r("gross", places=4), r("net", places=4))


@query(f"""{_B}, m AS (SELECT bar FROM b GROUP BY 1 ORDER BY count(*) DESC, bar LIMIT 1) SELECT {_AT}, close FROM b WHERE bar = (SELECT bar FROM m)""")
def mode_time(spark, d):
    return sections.at_mode(bars(spark, d), "bar").select("event_type", "bar", "close")


@query(f"""{_B} SELECT a.event_type, a.bar::TIMESTAMP AS bar, c.close AS bench, round(a.close - c.close, 6) AS excess FROM b a LEFT JOIN b c ON a.bar = c.bar AND c.event_type = 'view'""")
def benchmark_excess(spark, d):
    return sections.excess(bars(spark, d), *_K, "close", "view").select(*_K, "bench", r("excess"))


@query(f"""{_B}, m AS (SELECT bar, avg(close) AS market, count(*) AS members FROM b GROUP BY 1) SELECT {_AT}, round(close - market, 6) AS apart, members FROM b LEFT JOIN m USING (bar)""")
def market_join(spark, d):
    b = tables.with_level(bars(spark, d), ["bar"], "close", "market")
    return b.select(*_K, r(F.col("close") - F.col("market"), "apart"), "members")


@query("""SELECT p_partkey, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'middle' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END AS size_bin,
 1 + (p_retailprice > a)::INTEGER + (p_retailprice > b)::INTEGER AS tertile FROM part JOIN (SELECT p_brand, quantile_cont(p_retailprice, 1 / 3.0::DOUBLE) AS a, quantile_cont(p_retailprice, 2 / 3.0::DOUBLE) AS b FROM part GROUP BY 1) USING (p_brand)""")
def value_bins(spark, d):
    p = sections.quantile_bins(t(spark, d, "part"), ["p_brand"], "p_retailprice", 3, "tertile")
    return p.select("p_partkey", sections.binned(F.col("p_size"), [0, 10, 30, 50], ["small", "middle", "large"]).alias("size_bin"), "tertile")


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_quantity - 25 AS v FROM lineitem), u AS (SELECT median(abs(v)) AS u FROM x), y AS (SELECT v / u AS z FROM x, u)
SELECT CASE WHEN z < -1.5 THEN 'big_down' WHEN z < -0.25 THEN 'down' WHEN z <= 0.25 THEN 'flat' WHEN z <= 1.5 THEN 'up' ELSE 'big_up' END AS bin, count(*) AS n FROM y GROUP BY 1""")
def signed_bins(spark, d):
    x = t(spark, d, "lineitem").withColumn("v", F.col("l_quantity") - 25)
    return sections.signed_bins(x, "v").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_id, event_type FROM events JOIN (SELECT event_type, quantile_cont(value, 0.9) AS q FROM events GROUP BY 1) USING (event_type) WHERE value >= q""")
def quantile_filter(spark, d):
    return sections.over_quantile(t(spark, d, "events"), "value", 0.9, ["event_type"]).select("event_id", "event_type")


@query(f"""{_B}, x AS (SELECT *, lead(close) OVER (PARTITION BY event_type ORDER BY bar) / nullif(close, 0) - 1 AS f1, lead(close, 4) OVER (PARTITION BY event_type ORDER BY bar) / nullif(close, 0) - 1 AS f4, row_number() OVER (PARTITION BY event_type ORDER BY total, bar) - 1 AS p, count(total) OVER (PARTITION BY event_type) AS k FROM b)
SELECT event_type, (p * 4 // k + 1)::INTEGER AS bucket, count(*) AS n, round(avg(f1), 4) AS f1, round(avg(f4), 4) AS f4 FROM x GROUP BY ALL""")
def bucket_diagnostic(spark, d):
    w = Window.partitionBy("event_type").orderBy("bar")
    x = bars(spark, d).withColumns({f"f{k}": F.lead("close", k).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1 for k in (1, 4)})
    return sections.count_bins(x, ["event_type"], "total", "bar", 4).groupBy("event_type", "bucket").agg(F.count(F.lit(1)).alias("n"), r(F.avg("f1"), "f1", 4), r(F.avg("f4"), "f4", 4))


@query(f"""{_B}, x AS (SELECT *, close / nullif(lag(close, 4) OVER w, 0) - 1 AS r4, close / nullif(lag(close, 24) OVER w, 0) - 1 AS r24 FROM b WINDOW w AS (PARTITION BY event_type ORDER BY bar)),
m AS (SELECT bar, max(CASE WHEN event_type = 'view' THEN r4 END) AS a4, max(CASE WHEN event_type = 'click' THEN r4 END) AS b4, max(CASE WHEN event_type = 'view' THEN r24 END) AS a24, max(CASE WHEN event_type = 'click' THEN r24 END) AS b24, avg(CASE WHEN r4 > 0.02 THEN 1.0 ELSE 0.0 END) AS br, median(r4) AS med FROM x GROUP BY 1)
SELECT bar::TIMESTAMP AS bar, array_to_string(list_filter([CASE WHEN a4 > 0.015 AND b4 > 0.015 THEN 'both_4h' END, CASE WHEN a24 > 0.04 AND b24 > 0.04 THEN 'both_24h' END, CASE WHEN br > 0.35 THEN 'breadth' END, CASE WHEN med > 0.01 THEN 'median' END], lambda s: s IS NOT NULL), ',') AS reasons FROM m""")
def context_veto(spark, d):
    v = tables.vetoes(bars(spark, d), "event_type", "bar", "close", ("view", "click"), (4, 24), (0.015, 0.04), (0.02, 0.35), 0.01)
    return v.select("bar", F.regexp_replace(F.regexp_replace("reasons", "both_short", "both_4h"), "both_long", "both_24h").alias("reasons"))


@query("""WITH s AS (SELECT date_trunc('month', l_shipdate) AS month, list_sort(list(DISTINCT l_suppkey)) AS m FROM lineitem WHERE l_quantity >= 49 GROUP BY 1), x AS (SELECT *, lag(m) OVER (ORDER BY month) AS b FROM s)
SELECT month::TIMESTAMP AS month, len(m)::INTEGER AS n, round(1 - len(list_intersect(m, b)) / len(list_distinct(list_concat(m, b))), 6) AS turnover FROM x WHERE b IS NOT NULL""")
def set_turnover(spark, d):
    x = t(spark, d, "lineitem").where("l_quantity >= 49").withColumn("month", F.date_trunc("month", "l_shipdate").cast("timestamp_ntz"))
    return sections.set_turnover(x, "month", "l_suppkey").select("month", "n", r("turnover"))


@query("""WITH x AS (SELECT *, date_trunc('day', l_shipdate) AS day, CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END AS sign FROM lineitem), q AS (SELECT day, quantile_cont(l_extendedprice, 0.95) AS q FROM x GROUP BY 1)
SELECT day::TIMESTAMP AS day, round(coalesce(sum(CASE WHEN l_extendedprice >= q THEN sign * l_extendedprice END), 0) / nullif(sum(l_extendedprice), 0), 6) AS large_flow FROM x JOIN q USING (day) GROUP BY 1""")
def large_flow(spark, d):
    x = t(spark, d, "lineitem").withColumn("day", F.date_trunc("day", "l_shipdate").cast("timestamp_ntz"))
    return tables.large_flow(x, ["day"], "l_extendedprice", F.col("l_returnflag") == "R", 0.95).select("day", r("large_flow"))


@query("""SELECT l_suppkey, """ + ", ".join(f"round(coalesce(sum(CASE WHEN l_linenumber = {i} AND l_returnflag {'=' if s == 'sell' else '<>'} 'R' THEN l_quantity END), 0), 4) AS {s}_{i}" for i in (1, 2, 3) for s in ("buy", "sell")) + " FROM lineitem GROUP BY 1")
def bucket_pivot(spark, d):
    sold = F.col("l_returnflag") == "R"
    cells = {f"{s}_{i}": (F.col("l_linenumber") == i) & (sold if s == "sell" else ~sold) for i in (1, 2, 3) for s in ("buy", "sell")}
    return tables.pivot_sums(t(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", cells).select("l_suppkey", *[r(c, places=4) for c in cells])


@query("""SELECT o_custkey % 20 AS grp, date_trunc('month', o_orderdate)::TIMESTAMP AS month, arg_min(o_totalprice, (o_orderdate, o_orderkey))::DECIMAL(18, 2)::VARCHAR AS open, max(o_totalprice)::DECIMAL(18, 2)::VARCHAR AS high, min(o_totalprice)::DECIMAL(18, 2)::VARCHAR AS low,
arg_max(o_totalprice, (o_orderdate, o_orderkey))::DECIMAL(18, 2)::VARCHAR AS close, sum(o_totalprice::DECIMAL(18, 2))::DECIMAL(28, 2)::VARCHAR AS total, count(*) AS n_rows, count(*) >= 5 AS complete FROM orders GROUP BY ALL""")
def decimal_bars(spark, d):
    o = t(spark, d, "orders").withColumn("grp", F.col("o_custkey") % 20).withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    b = series.bars(o, "grp", "o_orderdate", "price", "month", "o_orderkey")
    return b.select("grp", F.col("bar").cast("timestamp_ntz").alias("month"), *[F.col(c).cast("string").alias(c) for c in ("open", "high", "low", "close", "total")], F.col("n").alias("n_rows"), (F.col("n") >= 5).alias("complete"))


@query("""SELECT user_id, date_trunc('hour', ts)::TIMESTAMP AS hour, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY ALL""")
def hour_last(spark, d):
    e = t(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return tables.last_in(e, ["user_id", "hour"], ["ts", "event_id"], "event_type", "last_type")


@query("""WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderpriority, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_orderstatus) = 1 AS is_mode FROM c""")
def value_counts(spark, d):
    return tables.value_shares(t(spark, d, "orders"), ["o_orderpriority"], "o_orderstatus").withColumn("share", F.round("share", 6))


@query("""WITH e AS (SELECT s_nationkey, l_suppkey, sum(l_quantity) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), f AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY v DESC, l_suppkey) AS r FROM e)
SELECT s_nationkey, count(*) AS members, round(max(v) / sum(v), 6) AS top_share, round(sum(CASE WHEN r <= 3 THEN v END) / sum(v), 6) AS top3_share, round(sum(v * v) / (sum(v) * sum(v)), 6) AS hhi FROM f GROUP BY 1""")
def top_shares(spark, d):
    x = t(spark, d, "lineitem").join(t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return sections.top_shares(x, ["s_nationkey"], "l_suppkey", "l_quantity", 3).select("s_nationkey", "members", r("top_share"), r("top3_share"), r("hhi"))


@query(f"""SELECT o_orderpriority, count(net) AS n, round(avg(net), 6) AS mean, round(stddev_pop(net), 5) AS std, round(count(*) FILTER (move <> 0 AND sign(net) = sign(move)) / nullif(count(*) FILTER (move <> 0), 0), 6) AS match_rate FROM ({PNL}) GROUP BY 1""")
def merged_partials(spark, d):
    x = _trades(spark, d).withColumn("move", (F.col("o_orderkey") % 21 - 10) / 100.0).withColumn("month", F.date_trunc("month", "o_orderdate"))
    return sections.merged(sections.partials(x, ["o_orderpriority", "month"], "net", "move"), ["o_orderpriority"]).select("o_orderpriority", "n", r("mean"), r("std", places=5), r("match_rate"))


@query(f"""WITH p AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS month, count(net) AS n, sum(net) AS s FROM ({PNL}) GROUP BY ALL), a AS (SELECT o_orderpriority, sum(s) / sum(n) AS mean FROM p GROUP BY 1)
SELECT o_orderpriority, round(mean, 6) AS mean, count(*) AS groups, round(avg((sign(s) = sign(mean))::INTEGER), 6) AS stability FROM p JOIN a USING (o_orderpriority) WHERE n >= 3 GROUP BY 1, mean""")
def stability_rate(spark, d):
    x = _trades(spark, d).withColumn("month", F.date_trunc("month", "o_orderdate"))
    return sections.stability(x, ["o_orderpriority"], "month", "net", 3).select("o_orderpriority", r("mean"), "groups", r("stability"))


@query("""SELECT l_suppkey, count(*) AS n, round(CASE WHEN count(*) >= 50 AND var_pop(l_quantity) > 1e-12 THEN covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) ELSE 1 END, 4) AS beta,
round(CASE WHEN count(*) >= 50 AND var_pop(l_quantity) > 1e-12 AND var_pop(l_extendedprice) > 1e-12 THEN covar_pop(l_extendedprice, l_quantity) / sqrt(var_pop(l_quantity) * var_pop(l_extendedprice)) ELSE 0 END, 6) AS corr FROM lineitem GROUP BY 1""")
def group_beta(spark, d):
    return sections.beta(t(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice", "l_quantity", 50).select("l_suppkey", "n", r("beta", places=4), r("corr"))


@query(f"""WITH x AS (SELECT net, move, epoch(o_orderdate) / 86400.0 AS days, o_orderkey % 97 AS k FROM ({PNL} ) ) SELECT round(corr(net, move), 6) AS c_move, round(corr(net, days), 6) AS c_days, round(corr(net, k), 6) AS c_k FROM x""")
def feature_correlation(spark, d):
    x = _trades(spark, d).withColumns({"move": (F.col("o_orderkey") % 21 - 10) / 100.0, "days": F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 86_400e6, "k": (F.col("o_orderkey") % 97).cast("double")})
    return tables.correlations(x, "net", ["move", "days", "k"]).select(*[r(f"c_{c}") for c in ("move", "days", "k")])


@query("""WITH x AS (SELECT l_returnflag = 'R' AS bad, unnest([{'feature': 'l_discount', 'v': l_discount}, {'feature': 'l_quantity', 'v': l_quantity}, {'feature': 'l_tax', 'v': l_tax}], recursive := true) FROM lineitem)
SELECT feature, count(v) FILTER (NOT bad) AS n_good, count(v) FILTER (bad) AS n_bad, round(avg(v) FILTER (NOT bad) - avg(v) FILTER (bad), 6) AS mean_diff, round(median(v) FILTER (NOT bad) - median(v) FILTER (bad), 6) AS p50_diff,
round(quantile_cont(v, 0.1) FILTER (NOT bad) - quantile_cont(v, 0.1) FILTER (bad), 6) AS p10_diff, round(quantile_cont(v, 0.9) FILTER (NOT bad) - quantile_cont(v, 0.9) FILTER (bad), 6) AS p90_diff FROM x GROUP BY 1""")
def day_contrast(spark, d):
    c = sections.contrast(t(spark, d, "lineitem"), F.col("l_returnflag") != "R", ["l_discount", "l_quantity", "l_tax"])
    return c.select("feature", "n_good", "n_bad", *[r(x) for x in ("mean_diff", "p50_diff", "p10_diff", "p90_diff")])


@query(f"""SELECT coalesce(date_trunc('month', o_orderdate)::TIMESTAMP, NULL) AS month, o_orderpriority, round(sum(CASE WHEN net < 0 THEN net ELSE 0 END), 4) AS damage, count(*) FILTER (net < 0) AS losers, grouping(o_orderpriority)::INTEGER AS whole_month FROM ({PNL}) GROUP BY GROUPING SETS ((date_trunc('month', o_orderdate), o_orderpriority), (date_trunc('month', o_orderdate)))""")
def damage_decomposition(spark, d):
    x = _trades(spark, d).withColumn("month", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return tables.damage(x, "month", "o_orderpriority", "net").select("month", "o_orderpriority", r("damage", places=4), "losers", F.col("is_whole").alias("whole_month"))


@query("""SELECT l_suppkey, CASE WHEN a >= greatest(a, b, c) THEN 'l_discount' WHEN b >= greatest(a, b, c) THEN 'l_tax' ELSE 'l_part' END AS largest FROM (SELECT l_suppkey, round(avg(l_discount), 6) AS a, round(avg(l_tax), 6) AS b, round(avg(l_quantity) / 1000, 6) AS c FROM lineitem GROUP BY 1)""")
def column_argmax(spark, d):
    x = t(spark, d, "lineitem").groupBy("l_suppkey").agg(r(F.avg("l_discount"), "l_discount"), r(F.avg("l_tax"), "l_tax"), r(F.avg("l_quantity") / 1000, "l_part"))
    return x.select("l_suppkey", sections.argmax(["l_discount", "l_tax", "l_part"]).alias("largest"))


_AUDIT = "count(*) AS n, count(*) FILTER (v IS NULL OR isnan(v)) AS missing, count(*) FILTER (isinf(v)) AS infinite, min(v) FILTER (isfinite(v)) AS least, max(v) FILTER (isfinite(v)) AS most, round(avg(v) FILTER (isfinite(v)), 5) AS mean, round(quantile_cont(v, 0.999) FILTER (isfinite(v)), 5) AS p999"


@query(f"""WITH x AS (SELECT CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 53 = 0 THEN 'inf'::DOUBLE ELSE value END AS value, user_id::DOUBLE AS user_id FROM events),
y AS (SELECT 'value' AS "column", value AS v FROM x UNION ALL SELECT 'user_id', user_id FROM x) SELECT "column", {_AUDIT} FROM y GROUP BY 1""")
def column_audit(spark, d):
    i = F.col("event_id")
    x = t(spark, d, "events").withColumn("value", F.when(i % 50 == 0, F.lit(None)).when(i % 51 == 0, F.lit(float("nan"))).when(i % 53 == 0, F.lit(float("inf"))).otherwise(F.col("value")))
    return sections.audit(x, ["value", "user_id"]).select("column", "n", "missing", "infinite", "least", "most", r("mean", places=5), r("p999", places=5))


@query("""SELECT user_id, array_to_string(list(event_type ORDER BY ts, event_id), '>') AS path, count(*) AS n FROM events GROUP BY 1""")
def ordered_lists(spark, d):
    return tables.paths(t(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("""WITH x AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY md5('res-1:' || event_id)) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS sampled, round(quantile_cont(value, 0.05), 5) AS q05, round(quantile_cont(value, 0.5), 5) AS q50, round(quantile_cont(value, 0.95), 5) AS q95, n FROM x WHERE r <= 300 GROUP BY event_type, n""")
def sampled_quantiles(spark, d):
    h = F.md5(F.concat_ws(":", F.lit("res-1"), "event_id"))
    return sections.sampled_quantiles(t(spark, d, "events"), ["event_type"], "value", h, 300, {"q05": 0.05, "q50": 0.5, "q95": 0.95}).select("event_type", "sampled", r("q05", places=5), r("q50", places=5), r("q95", places=5), "n")


@query(f"""WITH s AS (SELECT o_custkey, sum(net) AS pnl, count(*) AS n, avg((net > 0)::INTEGER) AS win FROM ({PNL}) GROUP BY 1) SELECT o_custkey, row_number() OVER (ORDER BY (round(pnl, 6) > 0) DESC, n >= 10 DESC, round(win, 6) DESC, n DESC, o_custkey) AS place FROM s ORDER BY place LIMIT 100""")
def composite_ranking(spark, d):
    s = _trades(spark, d).groupBy("o_custkey").agg(F.sum("net").alias("pnl"), F.count(F.lit(1)).alias("n"), r(F.avg((F.col("net") > 0).cast("int")), "win"))
    order = [F.desc(F.round("pnl", 6) > 0), F.desc(F.col("n") >= 10), F.desc("win"), F.desc("n"), F.asc("o_custkey")]
    return tables.ranked(s, order, 100).select("o_custkey", "place")


@query(f"""WITH x AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY round(net, 6), o_orderkey) AS r, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS p, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM ({PNL}))
SELECT o_orderpriority, round(sum(CASE WHEN r > 10 THEN net END), 4) AS without_worst, round(sum(CASE WHEN p <= floor(n * 0.7) THEN net END), 4) AS first_70, round(sum(CASE WHEN p > n - floor(n * 0.3) THEN net END), 4) AS last_30, count(*) FILTER (r <= ceil(n * 0.05)) AS cut FROM x GROUP BY 1""")
def positional_splits(spark, d):
    s = tables.split_sums(_trades(spark, d), ["o_orderpriority"], ["o_orderdate", "o_orderkey"], [F.round("net", 6), "o_orderkey"], "net", 10, 0.7, 0.3, 0.05)
    return s.select("o_orderpriority", r("without_worst", places=4), r("first_part", "first_70", 4), r("last_part", "last_30", 4), "cut")
