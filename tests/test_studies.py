"""Studies and tables: edge cases that the queries over the driver's tables don't show."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import studies
from tidemark.operators import tables
from tidemark.sources import files, sinks

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def test_robustness_slices(spark):
    rows = [(i, at(i), float(i % 7 - 3), float(i), 0.1 * (i % 5)) for i in range(60)] + [(60, at(60), None, 1.0, 1.0), (61, None, 5.0, 1.0, 1.0), (62, at(62), 100.0, None, None)]
    df = spark.createDataFrame(rows, "i int, ts timestamp, v double, size double, s double")
    got = {(r.dimension, r.slice): r for r in studies.robustness_slices(df, "ts", "v", size="size", signal="s", thresholds=(0.3,), horizons={"later": "size"}, drop=1, tie="i").collect()}
    assert got["half", "first"].n + got["half", "second"].n == 61 and got["year", "2024"].n == 61
    assert [got["tercile", k].n for k in ("small", "middle", "large")] == [20, 20, 20]
    assert got["threshold", "0.3"].n == 24 and got["horizon", "later"].n == 60
    assert got["drop", "1"].n == 60 and abs(got["drop", "1"].mean - sum(r[2] for r in rows[:60]) / 60) < 1e-9
    assert studies.robustness_slices(df.limit(0), "ts", "v", size="size", drop=3, tie="i").count() == 0


def test_carry_components(spark):
    side = lambda p: spark.createDataFrame([("k", at(i), x, f) for i, (x, f) in enumerate(p)] + [(None, at(0), 1.0, True)], "k string, ts timestamp, p double, full boolean")
    spot, perp = side([(100.0, True), (101.0, True), (0.0, True), (103.0, True)]), side([(101.0, True), (101.0, False), (102.0, True), (103.0, True)])
    cash = spark.createDataFrame([("k", at(0), 0.01), ("k", at(0), 0.02), ("j", at(0), 9.0)], "k string, ts timestamp, r double")
    got = studies.carry_components(spot, perp, cash, "k", "ts", "p", 3600, "r", "full").collect()
    assert len(got) == 1 and abs(got[0].price_component - 0.01) < 1e-12 and got[0].cash_flow == 0.03 and abs(got[0].gross - 0.04) < 1e-12 and abs(got[0].basis - 0.01) < 1e-12 and got[0].next_basis == 0


def test_rolling_cash_needs_coverage(spark):
    months = [(f"{2023 + m // 12}-{m % 12 + 1:02d}-01", 1.0) for m in range(14) if m not in (1, 2, 3)]
    df = spark.createDataFrame([("k", d, v) for d, v in months], "k string, d string, v double").withColumn("m", F.to_date("d"))
    got = {str(r.m): r.carry for r in studies.rolling_cash(df, "k", "m", "v").collect()}
    assert got["2023-12-01"] is None and got["2024-02-01"] == 10.0  # nine of twelve, ten of twelve


def test_threshold_events_cool_down(spark):
    rows = [("k", i, at(i), float(i % 10), float(i % 10 == 0), 1) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, i int, ts timestamp, a double, b double, s int")
    got = studies.threshold_events(df, ["k"], "ts", "i", ("a", 0.05), ("b", 0.9), F.col("s"), 1, 15 * 3600)
    assert [r.i for r in got.orderBy("i").collect()] == [0, 20]
    assert studies.threshold_events(df, ["k"], "ts", "i", ("a", 0.05), ("b", 0.9), F.col("s"), 2, 1).count() == 0


def test_rejection_score(spark):
    df = spark.createDataFrame([(9.0, 10.0, 0.0, 9.5), (1.0, 10.0, 0.0, 0.5), (5.0, 5.0, 5.0, 5.0), (None, 10.0, 0.0, 9.0)], "o double, h double, l double, c double")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in studies.rejection_score("o", "h", "l", "c").items()]).collect()]
    assert got == [(2, 0), (0, 2), (0, 0), (2, 0)]


def test_rule_gates(spark):
    rows = [(rule, m, c, 1.0 if m >= bad else -1.0) for rule, bad in (("all", 0), ("one", 1), ("two", 2)) for m in range(12) for c in range(6)] + [("crowd", m, 0, 1.0) for m in range(12)] + [("short", 0, c, 1.0) for c in range(6)]
    df = spark.createDataFrame(rows, "rule string, m int, c int, v double")
    blocked = spark.createDataFrame([("two",)], "r string").select(F.sha2("r", 256).alias("h"))
    assert {r.rule: r.gate for r in studies.rule_scan(df, "rule", "m", "c", "v", F.col("m") < 6, blocked).collect()} == {"all": "strict", "one": "near", "crowd": "crowded", "short": "fail"}


def test_ledger_of_results(spark, tmp_path):
    rows = spark.createDataFrame([(1, "gap", at(0), "F"), (1, "gap", at(1), "P"), (1, "null", at(0), "P"), (2, "gap", at(0), "F")], "run int, validator string, ts timestamp, res string")
    got = {r.run: (r.gap, r.null, r.passed) for r in studies.latest_results(rows, "run", "validator", ["ts"], "res", ["gap", "null"], "P").collect()}
    assert got == {1: ("P", "P", 2), 2: ("F", None, 0)}
    for part in (rows.where("run = 1"), rows.where("run = 2")):
        studies.append_results(part, str(tmp_path / "ledger"), "run", ["ts", "validator"])
    assert spark.read.parquet(str(tmp_path / "ledger")).count() == 4


def test_ladder(spark):
    df = spark.createDataFrame([(None,), (1.0,), (2.0,), (3.0,)], "v double")
    steps = [(1.0, "a"), (2.0, "b")]
    assert [r[0] for r in df.select(studies.ladder(F.col("v"), steps, "c", "?")).collect()] == ["?", "b", "c", "c"]
    assert [r[0] for r in df.select(studies.ladder(F.col("v"), steps, "c", closed=True)).collect()] == [None, "a", "b", "c"]


def test_tables_with_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("a", 3.0, "y"), (None, 2.0, "x"), ("b", None, None)], "g string, v double, s string")
    assert {(r.g, r.level, r.members) for r in tables.with_level(df, ["g"], "v").collect()} == {("a", 2.0, 2), (None, 2.0, 1), ("b", None, 1)}
    assert {(r.g, r.large_flow) for r in tables.large_flow(df, ["g"], "v", F.col("s") == "x", 0.5).collect()} == {("a", 0.75), (None, -1.0), ("b", None)}
    shares = tables.value_shares(df, ["g"], "s").collect()
    assert sum(r.is_mode for r in shares) == 3 and {(r.g, r.s, r.share) for r in shares} == {("a", "x", 0.5), ("a", "y", 0.5), (None, "x", 1.0), ("b", None, 1.0)}
    assert tables.ranked(df, [F.desc_nulls_last("v")], 2).select("v", "place").collect() == [(3.0, 1), (2.0, 2)]


def test_category_counts_and_line_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, None), (2, "b")], "d int, c string")
    assert {r.d: r.counts for r in sinks.category_counts(df, ["d"], "c").collect()} == {1: {"": 1, "a": 2}, 2: {"b": 1}}
    with pytest.raises(ValueError):
        sinks.write_partitioned(df, str(tmp_path / "out"), str(tmp_path / "m"), ["d"], category="none")
    sinks.write_partitioned(df, str(tmp_path / "out"), str(tmp_path / "m"), ["d"], category="c")
    assert {r.d: r.category_counts for r in spark.read.parquet(str(tmp_path / "m")).collect()} == {1: {"": 1, "a": 2}, 2: {"b": 1}}
    p = tmp_path / "rows.csv"
    p.write_text("h1,h2\n" + "".join(f"{i},x\n" for i in range(250)))
    head, n = files.sampled_csv(spark, str(p), 5)
    assert [r.h1 for r in head.collect()] == ["0", "1", "2", "3", "4"] and n == 250
