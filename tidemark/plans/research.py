"""Queries of folds, stored partial sums, t tests, nested configurations, gross basis points, order books and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import nulls, quality, scalars, stats, studies
from tidemark.operators import folds, rolling, series
from tidemark.operators.shared import fresh_path
from tidemark.plans.evaluation import _t_p, _trades
from tidemark.plans.registry import BARS, PNL, SQL, bars, near, query, r, t
from tidemark.plans.replays import _of
from tidemark.sources import sinks
from tidemark.streaming import flows

_DAY = 86_400_000_000


@query(f"""WITH x AS (SELECT net, epoch_us(o_orderdate::TIMESTAMP) - epoch_us(TIMESTAMP '1992-01-01') AS us FROM ({PNL})), f AS (SELECT unnest(range(0, 20)) AS fold),
y AS (SELECT fold, net, us - fold * 90 * {_DAY} AS o FROM x, f) SELECT fold::INTEGER AS fold, CASE WHEN o < 180 * {_DAY} THEN 'discovery' WHEN o < 270 * {_DAY} THEN 'validation' ELSE 'test' END AS part, count(*) AS n, round(avg(net), 6) AS mean FROM y WHERE o >= 0 AND o < 360 * {_DAY} GROUP BY ALL""")
def rolling_folds(spark, d):
    """Discovery over 180 days, validation over 90, test over 90, a step of 90."""
    x = folds.rolling_windows(_trades(spark, d), "o_orderdate", F.lit("1992-01-01").cast("timestamp_ntz"), (180, 90, 90), ("discovery", "validation", "test"), 90, 20)
    return x.groupBy(F.col("fold").cast("int").alias("fold"), "part").agg(F.count(F.lit(1)).alias("n"), r(F.avg("net"), "mean"))


@query(f"""WITH x AS (SELECT net, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM ({PNL})), y AS (SELECT net, least(i // (n // 7), 6) AS run FROM x), f AS (SELECT unnest(range(1, 7)) AS fold)
SELECT fold::INTEGER AS fold, CASE WHEN run = fold THEN 'test' ELSE 'train' END AS part, count(*) AS n, round(avg(net), 6) AS mean FROM y JOIN f ON run <= fold GROUP BY ALL""")
def quantile_folds(spark, d):
    x = folds.quantile_folds(_trades(spark, d), ["o_orderdate", "o_orderkey"], 7)
    return x.groupBy(F.col("fold").cast("int").alias("fold"), "part").agg(F.count(F.lit(1)).alias("n"), r(F.avg("net"), "mean"))


@query(f"""SELECT o_orderpriority, count(*) AS n, round(avg(net), 6) AS mean, round(stddev_pop(net), 4) AS std, round(count(*) FILTER (sign(net) = sign(move) AND move <> 0) / count(*) FILTER (move <> 0), 6) AS match_rate FROM ({PNL}) GROUP BY 1""")
def resumed_scan(spark, d):
    """Half of the years first, then the whole history again: only the years that are not there yet are added up."""
    x = _trades(spark, d).withColumns({"year": F.year("o_orderdate"), "move": F.col("o_orderkey") % 21 - 10})
    path, manifest = fresh_path(spark, "partials"), fresh_path(spark, "manifest")
    for part in (x.where("year % 2 = 0"), x):
        sinks.scan_partials(part, path, manifest, ["year"], ["o_orderpriority"], "net", "move")
    return sinks.stored_partials(spark, path, manifest, ["year"], ["o_orderpriority"]).select("o_orderpriority", "n", r("mean"), r("std", places=4), r("match_rate"))


@query("""WITH s AS (SELECT l_suppkey, regr_slope(l_discount, l_quantity) AS slope, regr_count(l_discount, l_quantity) AS n, regr_r2(l_discount, l_quantity) AS r2 FROM lineitem WHERE l_discount IS NOT NULL GROUP BY 1),
t AS (SELECT l_suppkey, n, sqrt(r2 * (n - 2) / (1 - r2)) * sign(slope) AS t FROM s) SELECT l_suppkey, n, round(t, 5) AS t, round(""" + _t_p("t", "n - 2") + """, 6) AS p FROM t""")
def slope_p_values(spark, d):
    """Two-sided p of a slope by supplier, of Student's t."""
    x = t(spark, d, "lineitem").groupBy("l_suppkey").agg(*stats.ols(F.col("l_discount"), F.col("l_quantity")))
    return stats.with_p(x).select("l_suppkey", "n", r("t", places=5), r("p"))


def _config(second: bool) -> str:
    limit = "CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey + 1 ELSE s_suppkey END" if second else "s_suppkey"
    extra = ", 'note': 'n' || s_nationkey" if second else ", 'old': s_suppkey % 2 = 0"
    return f"SELECT s_suppkey, to_json({{'name': s_name, 'risk': {{'limit': {limit}, 'steps': json_array(s_nationkey, {{'deep': {limit} % 7}})}}{extra}}}) AS body FROM supplier WHERE s_suppkey % 10 <> {9 if second else 8}"


@query(f"""WITH a AS (SELECT s_suppkey, fullkey AS path, atom::VARCHAR AS was FROM ({_config(False)}) x, json_tree(x.body) WHERE atom IS NOT NULL), b AS (SELECT s_suppkey, fullkey AS path, atom::VARCHAR AS now FROM ({_config(True)}) x, json_tree(x.body) WHERE atom IS NOT NULL)
SELECT s_suppkey, path, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' ELSE 'changed' END AS kind, was, now FROM a FULL JOIN b USING (s_suppkey, path) WHERE was IS DISTINCT FROM now""")
def nested_changes(spark, d):
    """What differs between two nested configurations, leaf by leaf."""
    s, k = t(spark, d, "supplier"), F.col("s_suppkey")

    def config(second: bool):
        limit = F.when(k % 3 == 0, k + 1).otherwise(k) if second else k
        deep = F.to_json(F.struct((limit % 7).alias("deep")))
        extra = F.concat(F.lit(',"note":"n'), F.col("s_nationkey").cast("string"), F.lit('"')) if second else F.concat(F.lit(',"old":'), (k % 2 == 0).cast("string"))
        steps = F.concat(F.lit('"steps":['), F.col("s_nationkey").cast("string"), F.lit(","), deep, F.lit("]"))
        body = F.concat(F.lit('{"name":"'), F.col("s_name"), F.lit('","risk":{"limit":'), limit.cast("string"), F.lit(","), steps, F.lit("}"), extra, F.lit("}"))
        return s.where(k % 10 != (9 if second else 8)).select("s_suppkey", body.alias("body"))

    return quality.nested_diff(config(False), config(True), "s_suppkey", "body")


_SOURCES = """CASE WHEN o_orderkey % (o_custkey % 5 + 1) = 0 THEN net / 10 END AS native, CASE WHEN o_orderkey % (o_custkey % 3 + 1) = 0 THEN net / 20 END AS per_row, net / 50 AS proposed"""


def _sources():
    k, c, net = F.col("o_orderkey"), F.col("o_custkey"), F.col("net")
    return [("native", F.when(k % (c % 5 + 1) == 0, net / 10)), ("row_notional", F.when(k % (c % 3 + 1) == 0, net / 20)), ("proposed", net / 50)]


@query(f"""WITH x AS (SELECT o_orderkey, o_custkey % 15 AS family, {_SOURCES} FROM ({PNL})), c AS (SELECT family, CASE WHEN count(native) >= greatest(10, count(*) // 2) THEN 'native' WHEN count(per_row) >= greatest(10, count(*) // 2) THEN 'row_notional' ELSE 'proposed' END AS basis FROM x GROUP BY 1),
y AS (SELECT family, basis, CASE basis WHEN 'native' THEN native WHEN 'row_notional' THEN per_row ELSE proposed END AS bps FROM x JOIN c USING (family)) SELECT family, basis, count(*) AS n, round(avg(bps), 6) AS mean_bps FROM y WHERE bps IS NOT NULL GROUP BY ALL""")
def gross_ladder(spark, d):
    """A family takes its basis points from the first source that covers half of its rows."""
    x = _trades(spark, d).withColumn("family", F.col("o_custkey") % 15)
    *first, last = _sources()
    return quality.gross_ladder(x, ["family"], first, last).groupBy("family", "basis").agg(F.count(F.lit(1)).alias("n"), r(F.avg("gross_bps"), "mean_bps"))


@query(f"""WITH x AS (SELECT o_custkey % 15 AS family, {_SOURCES} FROM ({PNL})), y AS (SELECT family, coalesce(native, per_row, CASE WHEN family % 4 > 0 THEN proposed END) AS bps, CASE WHEN native IS NOT NULL THEN 'n' WHEN per_row IS NOT NULL THEN 'r' WHEN family % 4 > 0 THEN 'p' END AS s FROM x),
z AS (SELECT family, count(*) AS n, count(*) FILTER (s = 'n') / count(*) AS cn, count(*) FILTER (s = 'r') / count(*) AS cr, count(*) FILTER (s = 'p') / count(*) AS cp, avg(bps) AS mean_bps FROM y GROUP BY 1)
SELECT family, n, round(cn, 6) AS coverage_native, round(mean_bps, 6) AS mean_bps, CASE WHEN cn >= 0.8 THEN 'native_strong' WHEN cn >= 0.3 THEN 'native_partial' WHEN cr >= 0.5 THEN 'row_notional_estimated' WHEN cp >= 0.5 THEN 'proposed_estimated' ELSE 'insufficient' END AS tier,
 CASE WHEN cn >= 0.3 THEN 'native' WHEN cr >= 0.5 THEN 'row_notional' WHEN cp >= 0.5 THEN 'proposed' END AS main_source FROM z""")
def bps_quality(spark, d):
    x = _trades(spark, d).withColumn("family", F.col("o_custkey") % 15)
    native, row, (name, c) = _sources()
    q = quality.bps_quality(x, ["family"], [native, row, (name, F.when(F.col("family") % 4 > 0, c))])
    return q.select("family", "n", r("coverage_native"), r("mean_bps"), "tier", "main_source")


_SIDES = "CASE WHEN l_linenumber > 1 THEN l_quantity END AS bd, l_quantity * ((l_suppkey % 5) - 1) AS ad, l_extendedprice AS bn, l_extendedprice * ((l_suppkey % 5) - 1) * 1.01 AS an"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {_SIDES} FROM lineitem), p AS (SELECT *, CASE WHEN bd > 0 THEN bn / bd END AS bid, CASE WHEN ad > 0 THEN an / ad END AS ask FROM x)
SELECT l_orderkey, l_linenumber, round((bid + ask) / 2, 7) AS mid, round((ask - bid) / nullif((bid + ask) / 2, 0) * 10000, 6) AS spread_bps, round(CASE WHEN bd + ad > 0 THEN (bd - ad) / (bd + ad) END, 6) AS imbalance, round(CASE WHEN bd + ad > 0 THEN (bid * ad + ask * bd) / (bd + ad) END, 7) AS microprice FROM p""")
def book_geometry(spark, d):
    q, k, p = F.col("l_quantity"), F.col("l_suppkey") % 5 - 1, F.col("l_extendedprice")
    x = t(spark, d, "lineitem").withColumns({"bd": F.when(F.col("l_linenumber") > 1, q), "ad": q * k, "bn": p, "an": p * k * 1.01})
    g = scalars.book_geometry("bd", "ad", "bn", "an")
    return x.withColumns(g).select("l_orderkey", "l_linenumber", r("mid", places=7), r("spread_bps"), r("imbalance"), near("microprice", places=7))


@query(f"""WITH x AS (SELECT event_type, bar, avg(close) OVER w5 AS a, max(high) OVER w20 AS level FROM ({BARS}) WINDOW w5 AS (PARTITION BY event_type ORDER BY bar ROWS 4 PRECEDING), w20 AS (PARTITION BY event_type ORDER BY bar ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
y AS (SELECT event_type, bar, a - 0.7 * level AS now, lag(a - 0.7 * level) OVER (PARTITION BY event_type ORDER BY bar) AS before FROM x) SELECT event_type, bar::TIMESTAMP AS bar, CASE WHEN before <= 0 AND now > 0 THEN 'up' ELSE 'down' END AS "cross" FROM y WHERE before <= 0 AND now > 0 OR before >= 0 AND now < 0""")
def level_crosses(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("bar")
    x = bars(spark, d).withColumns({"a": F.avg("close").over(w.rowsBetween(-4, 0)), "level": 0.7 * F.max("high").over(w.rowsBetween(-20, -1))})
    return rolling.level_crosses(x, "event_type", "bar", "a", "level").where("cross IS NOT NULL").select("event_type", "bar", "cross")


_ENDED = "2100-01-01 00:00:00"
#: rows that a file of a stream holds at least, where its pieces hold more
FILE_ROWS = 250_000


def _stream(spark, d, parts: int = 2, **columns):
    """The events as a stream of files: their time in `parts` pieces, one after the other, then one row long after them, which closes what is open."""
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), "value").withColumns(columns)
    lo, hi = (x.timestamp() for x in e.agg(F.min("ts"), F.max("ts")).first())
    path = fresh_path(spark, "events")
    place = F.least(F.lit(parts - 1), F.floor((F.col("ts").cast("double") - lo) / ((hi - lo) / parts)))
    e = e.withColumn("_place", place.cast("int"))
    least = min([n for _, n in e.where("_place IS NOT NULL").groupBy("_place").count().collect()], default=0)  # a row a piece
    files = max(1, least // FILE_ROWS)  # as many of each piece, none of them empty: a micro-batch is a piece
    for i in range(parts):
        piece = e.where(F.col("_place") == i).drop("_place")
        (piece.repartition(files) if files > 1 else piece.coalesce(1)).write.mode("append").parquet(path)
    e = e.drop("_place")
    last = {c: F.lit(None).cast(kind) for c, kind in e.dtypes} | {"ts": F.lit(_ENDED).cast("timestamp"), "event_id": F.lit(-1).cast("long")}
    spark.range(1).select(*[last[c].alias(c) for c in e.columns]).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def _sunk(spark, flow):
    out = fresh_path(spark, "sink")
    flows.started(flow, out, fresh_path(spark, "progress")).awaitTermination()
    return spark.read.schema(flow.schema).parquet(out)


@query(f"SELECT event_type, bar::TIMESTAMP AS bar, open, high, low, close, round(total, 6) AS total, n FROM ({BARS})")
def stream_bars(spark, d):
    out = _sunk(spark, flows.tumbling_bars(_stream(spark, d), "event_type", "ts", "value", order="event_id"))
    return out.where(F.col("bar") < F.lit(_ENDED)).select("event_type", F.col("bar").cast("timestamp_ntz").alias("bar"), "open", "high", "low", "close", r("total"), "n")


@query(SQL["cooldown_6h"])
def stream_cooldown(spark, d):
    out = _sunk(spark, flows.cooldown(_stream(spark, d), "event_type", "ts", "event_id", 6 * 3600))
    return out.where("event_id >= 0").select("event_id", "event_type")


@query("""SELECT date_trunc('hour', ts)::TIMESTAMP AS at, round(avg(value), 6) AS mean, round(stddev_samp(value), 5) AS std, count(value) AS members FROM events GROUP BY 1 HAVING count(value) >= 3""")
def stream_sections(spark, d):
    """Cross-sections of an hour with three members at least."""
    rows = _stream(spark, d).withColumn("at", F.date_trunc("hour", "ts"))
    out = _sunk(spark, flows.cross_sections(rows, "at", "value", 3))
    return out.where(F.col("at") < F.lit(_ENDED)).select(F.col("at").cast("timestamp_ntz").alias("at"), r("mean"), r("std", places=5), "members")


@query("""WITH b AS (SELECT event_type, ts, value, unnest([0, 1, 2]) AS k FROM events), w AS (SELECT event_type, value, time_bucket(INTERVAL 2 HOUR, ts) - k * INTERVAL 2 HOUR AS start FROM b) SELECT event_type, start::TIMESTAMP AS start, round(sum(value), 6) AS total, count(value) AS n FROM w GROUP BY ALL""")
def stream_sliding(spark, d):
    """Sums over six hours, begun every two."""
    out = _sunk(spark, flows.sliding_sums(_stream(spark, d), "event_type", "ts", "value", "6 hours", "2 hours"))
    return out.where(F.col("event_type").isNotNull()).select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), r("total"), "n")


@query("""SELECT user_id, event_type, date_trunc('day', ts)::TIMESTAMP AS day FROM events GROUP BY ALL""")
def stream_first_seen(spark, d):
    """The first of the rows that share a user, a type and a day."""
    rows = _stream(spark, d).withColumn("day", F.date_trunc("day", "ts"))
    out = _sunk(spark, flows.first_seen(rows, ["user_id", "event_type", "day"], "ts", "2 days"))
    return out.where("event_id >= 0").select("user_id", "event_type", F.col("day").cast("timestamp_ntz").alias("day"))


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, CASE event_id % 3 WHEN 0 THEN 'signal' WHEN 1 THEN 'fill' ELSE 'exit' END AS kind, row_number() OVER (PARTITION BY user_id ORDER BY ts, CASE event_id % 3 WHEN 2 THEN 0 WHEN 1 THEN 1 ELSE 2 END) AS i FROM events),
s AS (SELECT user_id, 0::BIGINT AS i, '' AS now, 0::BIGINT AS since, NULL::VARCHAR AS told, NULL::BIGINT AS tm, NULL::BIGINT AS rejected FROM (SELECT DISTINCT user_id FROM e)
 UNION ALL SELECT user_id, i, CASE WHEN told IS NULL THEN was WHEN told = 'closed' THEN '' ELSE told END, CASE WHEN told IN ('pending', 'open') THEN t ELSE since END, told, t, rejected FROM
 (SELECT y.*, CASE WHEN was = '' AND kind = 'signal' THEN 'pending' WHEN was = 'pending' AND kind = 'fill' THEN 'open' WHEN was = 'open' AND kind = 'exit' THEN 'closed' END AS told FROM
  (SELECT e.user_id, e.i, e.t, e.kind, s.since, CASE WHEN s.now = 'pending' AND e.t - s.since > 21600000000 THEN '' ELSE s.now END AS was, CASE WHEN s.now = 'pending' AND e.t - s.since > 21600000000 THEN s.since + 21600000000 END AS rejected FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1) y)),
l AS (SELECT user_id, arg_max(now, i) AS now, arg_max(since, i) AS since FROM s GROUP BY 1)
SELECT user_id, state, make_timestamp(tm) AS at FROM (SELECT user_id, told AS state, tm FROM s WHERE told IS NOT NULL UNION ALL SELECT user_id, 'rejected', rejected FROM s WHERE rejected IS NOT NULL UNION ALL SELECT user_id, 'rejected', since + 21600000000 FROM l WHERE now = 'pending')""")
def stream_positions(spark, d):
    """Pending, open, closed and rejected positions by user, with six hours to wait for a fill."""
    kind = F.when(F.col("event_id") % 3 == 0, "signal").when(F.col("event_id") % 3 == 1, "fill").otherwise("exit")
    out = _sunk(spark, flows.positions(_stream(spark, d, kind=kind), "user_id", "ts", "kind", "1 hour", 6 * 3600))
    return out.where("user_id IS NOT NULL").select("user_id", "state", F.timestamp_micros("at").cast("timestamp_ntz").alias("at"))


_B = f"WITH b AS ({BARS})"


@query(f"""WITH x AS (SELECT *, o_orderkey % 21 / 1.0 AS size, net * 0.5 - 1 AS later FROM ({PNL})), m AS (SELECT (min(epoch_us(o_orderdate)) + max(epoch_us(o_orderdate))) / 2 AS mid, quantile_cont(o_totalprice, [1.0 / 3, 2.0 / 3]) AS q FROM orders),
y AS (SELECT x.*, o.o_totalprice AS price FROM x JOIN orders o USING (o_orderkey)), l AS (SELECT 'half' AS dimension, CASE WHEN epoch_us(o_orderdate) < mid THEN 'first' ELSE 'second' END AS slice, net AS v FROM y, m UNION ALL SELECT 'year', year(o_orderdate)::VARCHAR, net FROM y
 UNION ALL SELECT 'tercile', CASE WHEN price <= q[1] THEN 'small' WHEN price <= q[2] THEN 'middle' ELSE 'large' END, net FROM y, m UNION ALL SELECT 'threshold', c, net FROM y, (VALUES ('0.03', 0.03), ('0.08', 0.08)) t(c, k) WHERE abs(move) >= k
 UNION ALL SELECT 'horizon', 'now', net FROM y UNION ALL SELECT 'horizon', 'later', later FROM y UNION ALL SELECT 'drop', '10', net FROM (SELECT net, row_number() OVER (ORDER BY abs(net) DESC, o_orderkey) AS r FROM y) WHERE r > 10)
SELECT dimension, slice, count(*) AS n, round(avg(v), 5) AS mean, round(avg((v > 0)::INTEGER), 6) AS positive FROM l GROUP BY ALL""")
def robustness_table(spark, d):
    """Halves, years, terciles of size, thresholds, horizons, and without the ten most extreme trades."""
    x = _trades(spark, d).join(t(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price")), "o_orderkey")
    x = x.withColumns({"move": (F.col("o_orderkey") % 21 - 10) / 100.0, "later": F.col("net") * 0.5 - 1})
    s = studies.robustness_slices(x, "o_orderdate", "net", size="price", signal="move", thresholds=(0.03, 0.08), horizons={"now": "net", "later": "later"}, drop=10, tie="o_orderkey")
    return s.select("dimension", "slice", "n", r("mean", places=5), r("positive"))


@query(f"""{_B}, s AS (SELECT bar, close AS p, n FROM b WHERE event_type = 'view' AND close > 0), q AS (SELECT bar, close AS p, n FROM b WHERE event_type = 'click' AND close > 0), f AS (SELECT bar, sum(total) / 1e6 AS paid FROM b WHERE event_type = 'purchase' GROUP BY 1),
x AS (SELECT s.bar, s1.p / s.p - 1 AS sr, -(q1.p / q.p - 1) AS pr, coalesce(paid, 0) AS paid, q.p / s.p - 1 AS basis FROM s JOIN q USING (bar) JOIN s s1 ON s1.bar = s.bar + INTERVAL 1 HOUR JOIN q q1 ON q1.bar = s1.bar LEFT JOIN f ON f.bar = s.bar WHERE s.n >= 1 AND q.n >= 1)
SELECT bar::TIMESTAMP AS bar, round(sr + pr, 5) AS price_component, round(paid, 9) AS cash_flow, round(sr + pr + paid, 5) AS gross, round(basis, 5) AS basis FROM x""")
def carry_components(spark, d):
    """Price component and cash flow of a hedged pair, hour by hour."""
    b = bars(spark, d).withColumns({"pair": F.lit("pair"), "full": F.col("n") >= 1, "rate": F.col("total") / 1e6})
    of = lambda k: b.where(F.col("event_type") == k)
    c = studies.carry_components(of("view"), of("click"), of("purchase"), "pair", "bar", "close", 3600, "rate", "full")
    return c.select("bar", r("price_component", places=5), r("cash_flow", places=9), r("gross", places=5), r("basis", places=5))


@query(f"""{_B.replace("WITH", "WITH RECURSIVE")}, q AS (SELECT event_type, date_trunc('month', bar) AS month, quantile_cont(close, 0.3) AS lo, quantile_cont(n, 0.6) AS hi FROM b GROUP BY ALL),
v AS (SELECT b.*, coalesce(((least(open, close) - low) / nullif(high - low, 0) >= 0.5)::INTEGER, 0) + coalesce(((close - low) / nullif(high - low, 0) >= 0.6)::INTEGER, 0) AS score FROM b),
e AS (SELECT v.event_type, v.bar FROM v JOIN q ON q.event_type = v.event_type AND q.month = date_trunc('month', v.bar) WHERE close <= lo AND n >= hi AND score >= 1),
k AS (SELECT event_type, min(bar) AS bar FROM e GROUP BY 1 UNION ALL SELECT event_type, bar FROM (SELECT k.event_type, min(e.bar) AS bar FROM k JOIN e ON e.event_type = k.event_type AND e.bar >= k.bar + INTERVAL 6 HOUR GROUP BY k.event_type, k.bar)) SELECT event_type, bar::TIMESTAMP AS bar FROM k""")
def threshold_cooldown_events(spark, d):
    """Low closes on busy hours of a month, rejected by the bar's own shape, six hours apart."""
    x = bars(spark, d)
    score = studies.rejection_score("open", "high", "low", "close")["long"]
    return studies.threshold_events(x, ["event_type"], "bar", "event_type", ("close", 0.3), ("n", 0.6), score, 1, 6 * 3600).select("event_type", "bar")


def _reversal(back: int, hold: int) -> str:
    w = "PARTITION BY event_type ORDER BY bar"
    return f"""SELECT {back} AS back, {hold} AS hold, gross, gross - 0.001 * turnover AS net, turnover FROM (WITH x AS (SELECT *, close / nullif(lag(close, {back}) OVER ({w}), 0) - 1 AS past, lead(close, {hold}) OVER ({w}) / nullif(close, 0) - 1 AS nxt FROM b),
y AS (SELECT *, greatest(floor(count(*) OVER (PARTITION BY bar) * 0.4), 1) AS k, row_number() OVER (PARTITION BY bar ORDER BY past, event_type) AS u, row_number() OVER (PARTITION BY bar ORDER BY past DESC, event_type) AS v FROM x WHERE past IS NOT NULL AND nxt IS NOT NULL),
w AS (SELECT *, CASE WHEN u <= k THEN 0.5 / k ELSE 0 END - CASE WHEN v <= k THEN 0.5 / k ELSE 0 END AS w FROM y), t AS (SELECT bar, lead(bar) OVER (ORDER BY bar) AS nb FROM (SELECT DISTINCT bar FROM w)), h AS (SELECT bar, event_type, w FROM w WHERE w <> 0),
c AS (SELECT bar, event_type, sum(w) AS c FROM (SELECT * FROM h UNION ALL SELECT nb, event_type, -w FROM h JOIN t USING (bar) WHERE nb IS NOT NULL) GROUP BY ALL), o AS (SELECT bar, sum(abs(c)) AS turnover FROM c GROUP BY 1), g AS (SELECT bar, sum(w * nxt) AS gross FROM w GROUP BY 1) SELECT * FROM g JOIN o USING (bar))"""


@query(f"""{_B}, g AS ({" UNION ALL ".join(_reversal(b, h) for b in (3, 6) for h in (1, 4))}) SELECT back, hold, count(*) AS instants, round(avg(gross), 3) AS gross, round(avg(net), 3) AS net, round(avg(turnover), 6) AS turnover, round(avg((net > 0)::INTEGER), 6) AS positive FROM g GROUP BY ALL""")
def reversal_grid(spark, d):
    g = studies.reversal_grid(bars(spark, d), "event_type", "bar", "close", "event_type", (3, 6), (1, 4), 0.4, 0.001)
    return g.select("back", "hold", "instants", r("gross", places=3), r("net", places=3), r("turnover"), r("positive"))


@query(f"""WITH x AS (SELECT side || '_' || (o_orderkey % 21 // 3) AS rule, date_trunc('year', o_orderdate) AS period, o_custkey, net FROM ({PNL})), m AS (SELECT rule, period, sum(net) AS s FROM x GROUP BY ALL), p AS (SELECT rule, count(*) AS months, count(*) FILTER (round(s, 6) > 0) AS good FROM m GROUP BY 1),
k AS (SELECT rule, max(c) / nullif(sum(c), 0) AS top FROM (SELECT rule, o_custkey, sum(abs(net)) AS c FROM x GROUP BY ALL) GROUP BY 1)
SELECT rule, months, good AS positive_months, CASE WHEN top > 0.25 THEN 'crowded' WHEN months >= 7 AND good = months THEN 'strict' WHEN months >= 7 AND good = months - 1 THEN 'near' ELSE 'fail' END AS gate FROM p JOIN k USING (rule)""")
def rule_gates(spark, d):
    """Which rules are positive in all periods, or all but one."""
    x = _trades(spark, d).withColumns({"rule": F.concat_ws("_", "side", F.floor(F.col("o_orderkey") % 21 / 3).cast("string")), "period": F.date_trunc("year", "o_orderdate")})
    return studies.rule_scan(x, "rule", "period", "o_custkey", "net", F.col("period") < F.lit("1996-01-01"), months=7).select("rule", "months", "positive_months", "gate")


@query(f"""{_B}, t AS (SELECT *, lag(close) OVER (PARTITION BY event_type ORDER BY bar) AS pc FROM b), g AS (SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM t),
a AS (SELECT *, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS atr FROM g WINDOW w AS (PARTITION BY event_type ORDER BY bar ROWS 13 PRECEDING))
SELECT event_type, bar::TIMESTAMP AS bar, round((high - greatest(open, close)) / nullif(atr, 0), 5) AS upper_depth, round((least(open, close) - low) / nullif(atr, 0), 5) AS lower_depth, round((high - low) / nullif(atr, 0), 5) AS span_depth FROM a WHERE atr IS NOT NULL""")
def wick_depth(spark, d):
    """Wicks in average true ranges of 14 bars."""
    x = rolling.mean_range(bars(spark, d), "event_type", "bar", "high", "low", "close", 14).where("atr_sma IS NOT NULL")
    depths = scalars.depth_in_range("high", "low", "open", "close", "atr_sma")
    return x.select("event_type", "bar", *[r(c, k, 5) for k, c in depths.items()])


@query("""SELECT o_orderkey, epoch_us(TIMESTAMP '1998-01-01') / 1e6 - epoch_us(o_orderdate) / 1e6 AS late_s, CASE WHEN epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate) > 864000000000 * 30 THEN 'CRITICAL' ELSE 'WARN' END AS severity
FROM orders WHERE o_orderstatus = 'P' AND epoch_us(TIMESTAMP '1998-01-01') - epoch_us(o_orderdate) > 864000000000""")
def stale_orders(spark, d):
    """Orders that are pending ten days after their time, and those that are so ten months after it."""
    x = t(spark, d, "orders").where("o_orderstatus = 'P'")
    s = quality.stale_pending(x, "o_orderdate", F.lit("1998-01-01").cast("timestamp_ntz"), 864_000, ((1.0, "WARN"), (30.0, "CRITICAL")))
    return s.select("o_orderkey", "late_s", "severity")


@query(f"""WITH d AS (SELECT unnest([0, 1, 3]) AS delay), x AS (SELECT e.event_id, e.event_type, e.ts, delay, row_number() OVER (PARTITION BY e.event_type, delay ORDER BY e.ts, e.event_id) AS i FROM events e, d WHERE e.event_id % (delay + 1) = 0)
SELECT event_type, delay, count(*) AS n, count(DISTINCT event_id) AS ids FROM ({{}}) GROUP BY ALL""".format("""WITH RECURSIVE k AS (SELECT event_type, delay, event_id, ts FROM x WHERE i = 1
 UNION ALL SELECT event_type, delay, event_id, ts FROM (SELECT k.event_type, k.delay, arg_min(x.event_id, (x.ts, x.event_id)) AS event_id, min(x.ts) AS ts FROM k JOIN x ON x.event_type = k.event_type AND x.delay = k.delay AND x.ts >= k.ts + INTERVAL 6 HOUR GROUP BY k.event_type, k.delay, k.ts)) SELECT * FROM k"""))
def cooldown_by_delay(spark, d):
    """Each type and delay cools down on its own."""
    e = t(spark, d, "events").select("event_id", "event_type", "ts", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("delay")).where("event_id % (delay + 1) = 0")
    kept = series.cooldown(e, ["event_type", "delay"], "ts", 6 * 3600, "event_id")
    return kept.groupBy("event_type", "delay").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"))


def _model_sql(name: str, m: nulls.MonthModel) -> str:
    of = lambda what, *more: _of(f"mon-{what}", "side", f"'{name}'", "round", *more)
    normal = lambda what, *more: f"(sqrt(-2 * ln(greatest({_of(f'mon-{what}-u', 'side', chr(39) + name + chr(39), 'round', *more)}, 1e-12))) * cos(2 * 3.141592653589793::DOUBLE * {_of(f'mon-{what}-v', 'side', chr(39) + name + chr(39), 'round', *more)}))"
    one = lambda what, values: f"{list(values)}[floor({of(what)} * {len(values)})::INTEGER + 1]" if len(values) > 1 else str(values[0])
    within = lambda what, lo, hi: f"({lo} + {hi - lo} * {of(what)})" if hi > lo else str(lo)
    if m.signed:
        v = f"abs(scale * {m.signed[0]} + scale * {m.signed[1]} * {normal('month', 'j')}) * CASE WHEN j < positive THEN 1.0 ELSE -1.0 END"
    else:
        mu = f"{normal('drift')} * scale * {m.drift}" if m.drift is not None else f"total / 12 * {within('factor', *m.factor)} * {one('level', m.factors)} - {within('cost', *m.cost)}"
        v = f"{mu} + scale * {m.sigma} * {one('sigma', m.sigmas)} * " + (f"{normal('block', f'(j % {m.block[0]})')} + scale * {m.block[1]} * {normal('month', 'j')}" if m.block else normal("month", "j"))
        v = f"CASE WHEN j < {one('out', m.held_out)} THEN 0 ELSE {'-' if m.flipped else ''}({v}) END"
    return f"SELECT side, '{name}' AS model, round, ({v})::DOUBLE AS v FROM g"


@query(f"""WITH m AS (SELECT side, month(o_orderdate) AS k, round(sum(net), 4) AS v FROM ({PNL}) GROUP BY ALL), b AS (SELECT side, sum(v)::DOUBLE AS total, count(*) FILTER (v > 0) AS positive, min(v) AS worst, max(v) AS best FROM m GROUP BY 1),
g AS (SELECT b.*, greatest(250.0, abs(total) / 12, abs(worst), abs(best))::DOUBLE AS scale, round, j FROM b, (SELECT unnest(range(0, 15)) AS round), (SELECT unnest(range(0, 12)) AS j)), x AS ({" UNION ALL ".join(_model_sql(k, m) for k, m in nulls.MONTH_MODELS.items())})
SELECT side, model, round::INTEGER AS round, round(sum(v), 4) AS total, count(*) FILTER (v > 0) AS positive FROM x GROUP BY ALL""")
def month_models(spark, d):
    """A year of made-up months of each side, by twelve models."""
    m = _trades(spark, d).groupBy("side", F.month("o_orderdate").alias("k")).agg(F.round(F.sum("net"), 4).alias("v"))
    b = m.groupBy("side").agg(F.sum("v").alias("total"), F.count(F.when(F.col("v") > 0, 1)).alias("positive"), F.min("v").alias("worst"), F.max("v").alias("best"))
    return nulls.model_months(b, "side", nulls.MONTH_MODELS, 15, "mon").select("side", "model", "round", r("total", places=4), "positive")
