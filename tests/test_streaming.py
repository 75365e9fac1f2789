from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, series
from tidemark.streaming import flows

T0 = datetime(2024, 1, 1)
D = "/root/testdata/sf0.001"


def ran(spark, tmp_path, out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def source(spark, tmp_path, parts):
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


@pytest.fixture
def events(spark):
    return spark.read.parquet(f"{D}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def test_bars_equal_the_batch_form(spark, tmp_path, events):
    end = events.select(F.lit(-1).cast("long").alias("event_id"), "event_type", (F.lit("2030-01-01").cast("timestamp")).alias("ts"), F.lit(0.0).alias("value")).limit(1)
    rows = events.select("event_id", "event_type", "ts", "value")
    got = ran(spark, tmp_path, flows.tumbling_bars(source(spark, tmp_path, [rows, end]), "event_type", "ts", "value", order="event_id"), "bars")
    want = series.bars(rows, "event_type", "ts", "value", order="event_id")
    key = lambda r: (r.event_type, r.bar, r.open, r.high, r.low, r.close, r.n)
    assert sorted(map(key, got.where("bar < '2030-01-01'").collect())) == sorted(map(key, want.collect()))


def test_cooldown_equals_the_batch_form(spark, tmp_path, events):
    rows = events.select("event_id", "user_id", "ts")
    got = ran(spark, tmp_path, flows.cooldown(source(spark, tmp_path, [rows]), "user_id", "ts", "event_id", 6 * 3600), "cool")
    want = series.cooldown(rows, "user_id", "ts", 6 * 3600, "event_id")
    assert sorted(r.event_id for r in got.collect()) == sorted(r.event_id for r in want.collect())


def test_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([(1, T0), (1, T0), (2, T0)], "id int, ts timestamp")
    assert ran(spark, tmp_path, flows.first_seen(source(spark, tmp_path, [rows]), ["id"], "ts", "1 hour"), "seen").count() == 2


def test_positions(spark, tmp_path):
    m = lambda k: T0 + timedelta(minutes=k)
    a = spark.createDataFrame([("a", m(0), "signal"), ("a", m(1), "fill"), ("a", m(2), "signal"), ("a", m(9), "exit"), ("b", m(0), "signal"), ("c", m(0), "exit"), ("d", m(0), "signal"), ("d", m(30), "fill")], "k string, ts timestamp, kind string")
    b = spark.createDataFrame([("z", m(600), "fill")], a.schema)
    got = ran(spark, tmp_path, flows.positions(source(spark, tmp_path, [a, b]), "k", "ts", "kind", "1 minute", 600), "pos")
    found = sorted((r.k, r["at"] // 60_000_000 - int(T0.timestamp()) // 60, r.state) for r in got.collect())
    shift = found[0][1]
    assert [(k, t - shift, s) for k, t, s in found] == [("a", 0, "pending"), ("a", 1, "open"), ("a", 9, "closed"), ("b", 0, "pending"), ("b", 10, "rejected"), ("d", 0, "pending"), ("d", 10, "rejected")]


def test_ema_carries_over_nulls_and_wilder(spark):
    rows = spark.createDataFrame([("a", 1, None), ("a", 2, 10.0), ("a", 3, None), ("a", 4, 20.0)], "k string, t int, v double")
    assert [r.ema for r in folds.ema(rows, "k", ["t"], "v", 0.5).orderBy("t").collect()] == [None, 10.0, 10.0, 15.0]
    bars = spark.createDataFrame([("a", 1, 3.0, 1.0, 2.0), ("a", 2, 8.0, 6.0, 7.0)], "k string, t int, h double, l double, c double")
    assert [r.atr for r in folds.wilder_range(bars, "k", ["t"], "h", "l", "c", 2).orderBy("t").collect()] == [None, 4.0]


def test_pieces_of_several_files_are_one_batch_each(spark, monkeypatch):
    """A piece of many rows is written by many tasks and still read as one micro-batch, before the next piece."""
    import glob

    from tidemark.plans import catalogue, research

    d, paths, fresh = "/root/testdata/sf0.001", [], research.fresh_path
    monkeypatch.setattr(research, "fresh_path", lambda s, name: paths.append(fresh(s, name)) or paths[-1])
    files = lambda: [len(glob.glob(p.removeprefix("file:") + "/*.parquet")) for p in paths if "/events-" in p]
    want = {tuple(r) for r in catalogue.queries()["stream_positions"](spark, d).collect()}
    assert files()[0] <= 4  # two pieces, and the closing row with an empty file beside it
    monkeypatch.setattr(research, "FILE_ROWS", 100)
    assert {tuple(r) for r in catalogue.queries()["stream_positions"](spark, d).collect()} == want
    assert files()[1] - files()[0] >= 2 and (files()[1] - files()[0]) % 2 == 0
