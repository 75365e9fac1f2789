"""Queries through the sources and sinks: the tables are written to the shared folder in each form and read back by the library's readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import filters, series
from tidemark.operators.shared import fresh_path
from tidemark.plans.registry import BARS, bars, query, r, t
from tidemark.plans.research import _sunk, _stream
from tidemark.sources import files, sinks
from tidemark.streaming import flows

_EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _events(spark, d):
    return t(spark, d, "events").select(*[f.split()[0] for f in _EVENTS.split(", ")])


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def csv_scan(spark, d):
    """All events as plain and gzipped CSV, appended one to the other, under a strict header contract."""
    path, e = fresh_path(spark, "csv"), _events(spark, d)
    sinks.append_csv(e.where("event_id % 2 = 0"), path)
    sinks.append_csv(e.where("event_id % 2 <> 0"), path, gzip=True)
    return files.csv(spark, path, _EVENTS)


@query("SELECT count(*) AS n_rows, least(count(*), 100) AS n_sampled, least(count(*), 100) AS n_known, 'event_id,ts,user_id,event_type,value,props' AS header FROM events")
def csv_sample(spark, d):
    """The first hundred rows of a CSV, as a look at it gives them, how many of them the table has, and the count of all rows."""
    path, e = fresh_path(spark, "csv"), _events(spark, d)
    sinks.append_csv(e, path, gzip=True)
    few, n = files.sampled_csv(spark, path, 100)
    known = F.broadcast(few.select(F.col("event_id").cast("long").alias("event_id"), F.lit(1).alias("found")))
    there = e.select("event_id").join(known, "event_id", "left_semi").agg(F.count(F.lit(1)).alias("n_known"))
    return few.agg(F.count(F.lit(1)).alias("n_sampled")).join(F.broadcast(there)).select(F.lit(n).cast("long").alias("n_rows"), "n_sampled", "n_known", F.lit(",".join(few.columns)).alias("header"))


_HASHED = """sha256(json_object('event_id', event_id, 'event_type', event_type, 'user_id', user_id)::VARCHAR)"""


@query(f"SELECT event_id, event_type, user_id, {_HASHED} AS hash, true AS intact, 'read' AS state FROM events UNION ALL SELECT event_id, NULL, NULL, NULL, NULL, 'broken' FROM events WHERE event_id % 97 = 0")
def json_lines_scan(spark, d):
    """Events as hashed JSON lines in two appends, among lines that break off: the hashes hold, and the broken lines are seen."""
    path, e = fresh_path(spark, "json"), t(spark, d, "events").select("event_id", "event_type", "user_id")
    sinks.append_json(e.where("event_id % 2 = 0"), path)
    sinks.append_json(e.where("event_id % 2 <> 0"), path)
    e.where("event_id % 97 = 0").select(F.format_string('{"event_id":%d,"user_id', "event_id").alias("value")).write.mode("append").text(path)
    good, bad = files.json_lines(spark, path, "event_id long, event_type string, user_id long, hash string")
    good = good.select("event_id", "event_type", "user_id", "hash", F.col("hash").eqNullSafe(sinks.row_hash(good.drop("hash"))).alias("intact"), F.lit("read").alias("state"))
    bad = bad.select(F.regexp_extract("line", '"event_id":([0-9]+)', 1).cast("long").alias("event_id"), F.lit("broken").alias("state"))
    return good.unionByName(bad, allowMissingColumns=True)


def _archives(rows, each: int):
    """ZIP archives of `each` event_ids, with a CSV member for the even and one for the odd users."""
    columns = rows.columns

    def pack(pdf):
        import io
        import zipfile

        import pandas as pd

        n = int(pdf["event_id"].iloc[0]) // each
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            for name, part in (("even.csv", pdf[pdf["user_id"] % 2 == 0]), ("odd.csv", pdf[pdf["user_id"] % 2 != 0])):
                z.writestr(name, part[columns].to_csv(index=False, header=name == "even.csv"))
        return pd.DataFrame({"path": [f"events-{n}.zip"], "content": [held.getvalue()]})

    return rows.groupBy(F.floor(F.col("event_id") / each)).applyInPandas(pack, "path string, content binary")


@query("""SELECT 'events-' || (event_id // 5000)::VARCHAR || '.zip' AS archive, CASE WHEN user_id % 2 = 0 THEN 'even.csv' ELSE 'odd.csv' END AS member, event_id::VARCHAR AS event_id, user_id::VARCHAR AS user_id, coalesce(event_type, '') AS event_type, coalesce(props, '') AS props FROM events""")
def zipped_csv_scan(spark, d):
    """Events in ZIP archives of 5,000, with and without a header, streamed out of them again."""
    e = t(spark, d, "events").select("event_id", "user_id", "event_type", "props")
    return files.unzipped(_archives(e, 5000), e.columns)


@query("""WITH x AS (SELECT *, year(l_shipdate)::INTEGER AS year FROM lineitem), k AS (SELECT year, string_agg(f || ':' || n, ',' ORDER BY f) AS flags FROM (SELECT year, l_returnflag AS f, count(*)::VARCHAR AS n FROM x GROUP BY ALL) GROUP BY 1),
h AS (SELECT year, count(*) AS n_rows, sum(('0x' || substr(sha256(json_object('l_linenumber', l_linenumber, 'l_orderkey', l_orderkey, 'l_returnflag', l_returnflag, 'l_suppkey', l_suppkey, 'year', year)::VARCHAR), 1, 12))::HUGEINT)::VARCHAR AS content_hash FROM x GROUP BY 1)
SELECT year, n_rows, content_hash, sha256('struct<l_orderkey:bigint,l_linenumber:int,l_suppkey:bigint,l_returnflag:string>') AS schema_hash, flags FROM h JOIN k USING (year)""")
def partition_manifest(spark, d):
    """The manifest of line items by year of shipping, built in two goes, the second of which leaves alone what the first has built."""
    x = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("year"))
    path, manifest = fresh_path(spark, "parts"), fresh_path(spark, "manifest")
    for part in (x.where("year % 2 = 0"), x):
        sinks.write_partitioned(sinks.unbuilt(part, manifest, ["year"]), path, manifest, ["year"], "l_returnflag")
    flags = F.array_join(F.transform(F.map_entries("category_counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return spark.read.parquet(manifest).select("year", "n_rows", "content_hash", "schema_hash", flags.alias("flags"))


@query(f"SELECT event_type, count(*) AS n_rows, min(bar)::TIMESTAMP AS first, max(bar)::TIMESTAMP AS last FROM ({BARS}) GROUP BY 1")
def panel_index(spark, d):
    """The index of a gzipped CSV panel of hourly bars, taken from what was written."""
    path, index = fresh_path(spark, "panel"), fresh_path(spark, "index")
    sinks.write_panel(bars(spark, d), path, index, "event_type", "bar")
    return spark.read.parquet(index)


@query(f"SELECT event_type, bar::TIMESTAMP AS bar, open, high, low, close, n FROM ({BARS})")
def panel_scan(spark, d):
    """The same panel read back: folders give the key, the header contract the rest."""
    path = fresh_path(spark, "panel")
    sinks.write_panel(bars(spark, d).select("event_type", "bar", "open", "high", "low", "close", "n"), path, fresh_path(spark, "index"), "event_type", "bar")
    return files.csv(spark, path, "bar timestamp_ntz, open double, high double, low double, close double, n long, event_type string").select("event_type", "bar", "open", "high", "low", "close", "n")


@query("SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 30 = 0 THEN '0 seconds' ELSE (o_orderkey % 30)::VARCHAR || ' days' END AS wait FROM orders")
def stored_table(spark, d):
    """Orders with a calendar interval, which Parquet has no type for: the sink falls back to CSV, and the reader finds it."""
    path = fresh_path(spark, "table")
    sinks.write_table(t(spark, d, "orders").select("o_orderkey", "o_orderpriority", F.make_interval(days=(F.col("o_orderkey") % 30).cast("int")).alias("wait")), path)
    return files.stored(spark, path, "o_orderkey long, o_orderpriority string, wait string")


def _by_year(spark, d):
    """Orders in folders by priority code and year; the columns are in the paths alone."""
    path = fresh_path(spark, "orders")
    x = t(spark, d, "orders").withColumns({"code": F.substring("o_orderpriority", 1, 1), "year": F.year("o_orderdate")})
    x.select("o_orderkey", "o_totalprice", "code", "year").write.partitionBy("code", "year").parquet(path)
    return path


@query("SELECT substr(o_orderpriority, 1, 1) AS code, max(year(o_orderdate))::INTEGER AS year FROM orders GROUP BY 1")
def file_discovery(spark, d):
    """The best file of each priority, where a later year in the path scores higher."""
    found = files.discovered(spark, _by_year(spark, d), {f"year={y}": y - 1900 for y in range(1980, 2040)}, "*.parquet")
    best = files.latest(found, F.regexp_extract("path", "code=([^/]+)", 1))
    return best.select(F.col("group").alias("code"), F.regexp_extract("path", "year=([0-9]+)", 1).cast("int").alias("year"))


@query("SELECT o_orderkey, o_totalprice, substr(o_orderpriority, 1, 1) AS code, year(o_orderdate)::VARCHAR AS year, NULL::VARCHAR AS venue FROM orders")
def path_columns(spark, d):
    rows = spark.read.option("recursiveFileLookup", True).parquet(_by_year(spark, d))
    return files.from_path(rows, code="code=([^/]+)", year="year=([0-9]+)", venue="venue=([^/]+)")


@query("SELECT o_orderkey AS order_id, o_totalprice AS price, CASE WHEN o_orderkey % 2 <> 0 THEN o_orderpriority END AS priority, NULL::VARCHAR AS venue FROM orders")
def aliased_scan(spark, d):
    """Two files that name their columns differently, read as one table."""
    path, o = fresh_path(spark, "orders"), t(spark, d, "orders")
    o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("Id"), F.col("o_totalprice").alias("Total")).write.mode("append").parquet(path)
    o.where("o_orderkey % 2 <> 0").select("o_orderkey", F.col("o_totalprice").alias("total_price"), F.col("o_orderpriority").alias("prio")).write.mode("append").parquet(path)
    names = {"order_id": ["id", "o_orderkey"], "price": ["total_price", "total"], "priority": ["priority", "prio"], "venue": ["venue", "exchange"]}
    return files.aliased(spark.read.option("mergeSchema", True).parquet(path), names, ["order_id", "price"])


@query("SELECT event_type, min(ts) AS first, max(ts) AS last, count(*) AS n_rows FROM events GROUP BY 1")
def scan_bounds(spark, d):
    """First and last instant by type: two columns are read."""
    return files.time_bounds(t(spark, d, "events"), "ts", ["event_type"])


@query("SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = 'click' INTERSECT SELECT user_id, date_trunc('day', ts)::TIMESTAMP FROM events WHERE event_type = 'view'")
def source_pairs(spark, d):
    """Users and days that both sources, the clicks and the views, have."""
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return files.pairs(e.where("event_type = 'click'"), e.where("event_type = 'view'"), ["user_id", "day"])


@query("""WITH x AS (SELECT user_id % 8 AS shard, event_type, ts, lag(ts) OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS before FROM events)
SELECT shard::INTEGER AS shard, count(*) AS n_rows, count(*) FILTER (event_type IS DISTINCT FROM 'click') AS other_symbol, count(*) FILTER (ts <= before) AS not_increasing FROM x GROUP BY 1""")
def file_faults(spark, d):
    """Files of events that ought to be clicks in order of time: how many rows of each are not."""
    path = fresh_path(spark, "shards")
    e = t(spark, d, "events").select("event_id", "ts", "event_type", (F.col("user_id") % 8).cast("int").alias("shard"))
    e.repartition("shard").write.partitionBy("shard").parquet(path)
    x = files.series_faults(spark.read.parquet(path), "event_type", F.lit("click"), "ts", "event_id")
    return x.select(F.regexp_extract("_file", "shard=([0-9]+)", 1).cast("int").alias("shard"), "n_rows", "other_symbol", "not_increasing")


@query("""WITH u AS (SELECT count(DISTINCT date_trunc('month', l_shipdate)) AS k FROM lineitem), p AS (SELECT avg(n) AS m FROM (SELECT count(*) AS n FROM lineitem WHERE year(l_shipdate) = 1995 GROUP BY date_trunc('month', l_shipdate)))
SELECT round(m * k, 4) AS rows, round(m * k * 120 / 1e9, 9) AS gb FROM u, p""")
def build_size(spark, d):
    """Rows and GB of a build of all months, from those of one year."""
    x = t(spark, d, "lineitem").select(F.trunc("l_shipdate", "month").alias("month"))
    months = x.agg(F.count_distinct("month")).first()[0]
    return sinks.size_estimate(x.where(F.year("month") == 1995), months, ["month"], 120.0).select(r("rows", places=4), r("gb", places=9))


@query(f"""WITH b AS ({BARS}) SELECT event_type, bar::TIMESTAMP AS bar, open, high, low, close, round(total, 6) AS total, n, round((close / nullif(lag(close) OVER (PARTITION BY event_type ORDER BY bar), 0) - 1) * 10000, 6) AS ret_bps FROM b""")
def feature_guard(spark, d):
    """Bars with returns and what comes after them: the guard lets the former through alone."""
    x = series.forward_extremes(series.lagged_return(bars(spark, d), "event_type", "bar", "close"), "event_type", "bar", "close", 6)
    x = x.withColumns({"total": F.round("total", 6), "ret_bps": F.round("ret_bps", 6)})
    return filters.checked_features(x, ["event_type", "bar", *filters.feature_columns(x)])


@query("SELECT event_id, event_type, date_trunc('hour', ts)::TIMESTAMP AS bar FROM events WHERE event_id % 3 <> 0 AND epoch_us(ts) >= epoch_us(date_trunc('hour', ts)) + 1800000000")
def stream_closed(spark, d):
    """Candles of half an hour, seen at any time of their hour: those that are confirmed and over go through the stream."""
    rows = _stream(spark, d).withColumns({"bar": F.date_trunc("hour", "ts"), "confirm": F.when(F.col("event_id") % 3 != 0, "1").otherwise("0")})
    out = _sunk(spark, flows.closed_bars(rows, "bar", "confirm", 1800, "ts"))
    return out.where("event_id >= 0").select("event_id", "event_type", F.col("bar").cast("timestamp_ntz").alias("bar"))


@query("SELECT 3 AS batches, count(*) AS n_rows, max(ts)::TIMESTAMP AS newest, count(*) FILTER (ts IS NULL) AS without_time FROM events")
def stream_heartbeat(spark, d):
    """What listeners of a stream are told of its micro-batches, added up; those that held rows are counted."""
    rows = _stream(spark, d, parts=3).where("event_id >= 0")
    q = flows.started(flows.observed(rows, "beat", "ts"), fresh_path(spark, "sink"), fresh_path(spark, "progress"))
    q.awaitTermination()
    beats = [p["observedMetrics"]["beat"] for p in q.recentProgress if "beat" in p["observedMetrics"]]
    told = spark.createDataFrame([(b["n_rows"], b["newest_us"], b["without_time"]) for b in beats], "n_rows long, newest_us long, without_time long")
    return told.agg(F.count_if(F.col("n_rows") > 0).cast("int").alias("batches"), F.sum("n_rows").alias("n_rows"), F.timestamp_micros(F.max("newest_us")).cast("timestamp_ntz").alias("newest"), F.sum("without_time").alias("without_time"))
