"""Edge cases of the panel operators, and the operators that have no SQL."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import clusters, nulls, quality, replays, stats
from tidemark.operators import admission, filters, folds, joins, relations, rolling, sections, series
from tidemark.sources import files, sinks
from tidemark.streaming import flows

T0 = dt.datetime(2024, 1, 1)
H = dt.timedelta(hours=1)


def panel(spark, values, key="a"):
    return spark.createDataFrame([(key, T0 + i * H, v) for i, v in enumerate(values)], "key string, ts timestamp_ntz, v double")


def column(df, name, order="ts"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_null_keys_and_times_match_nothing(spark):
    l = spark.createDataFrame([(1, None, T0 + H), (2, "a", T0 + H), (3, "a", None)], "id int, key string, ts timestamp_ntz")
    x = spark.createDataFrame([(7, None, T0), (8, "a", None), (9, "a", T0)], "rid int, key string, ts timestamp_ntz").withColumn("v", F.lit(1.0))
    for forward in (False, True):
        got = {r.id: r.r_rid for r in joins.asof(l, x, "key", "ts", ["rid"], forward=forward).collect()}
        assert got == {1: None, 2: None if forward else 9, 3: None}
    assert {r.id: r.n_before for r in joins.trailing(l, x, "key", "ts", "v", 7200).collect()} == {1: 0, 2: 1, 3: 0}
    assert {r.id: r.n_around for r in relations.around(l, x, "key", "ts", "v", 7200, 0).collect()} == {1: 0, 2: 1, 3: 0}


def test_seeded_average(spark):
    x = panel(spark, [1.0, 2.0, None, 3.0, 10.0])
    assert column(folds.ema(x, "key", ["ts"], "v", 0.5, seed=3), "ema") == [None, None, None, 2.0, 6.0]
    assert column(folds.ema(x, "key", ["ts"], "v", 1.0), "ema") == [1.0, 2.0, 2.0, 3.0, 10.0]
    with pytest.raises(ValueError):
        folds.ema(x, "key", ["ts"], "v", 0.0)


def test_folds_over_batches_and_keys(spark):
    """State is a key's own, however the rows fall into Arrow batches and partitions."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.range(200).select((F.col("id") % 6).alias("key"), F.col("id").alias("i"), F.timestamp_seconds(F.col("id") * 100).alias("ts"))
        got = {r.key: r.n for r in series.cooldown(rows, "key", "ts", 1500, "i").groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
        chain = stats.chained(rows, "key", ["i"], ["i", "ts"])
        assert stats.verified(chain, "key").where("NOT whole").isEmpty()
        assert chain.where("seq = 1").count() == 6
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {}
    for k in range(6):
        last = None
        for i in range(k, 200, 6):
            if last is None or i * 100 - last >= 1500:
                last = i * 100
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_chain_tells_values_and_nulls_apart(spark):
    one = spark.createDataFrame([(1, 1, "a|b", "c")], "k int, i int, x string, y string")
    two = spark.createDataFrame([(1, 1, "a", "b|c")], "k int, i int, x string, y string")
    none = spark.createDataFrame([(1, 1, None, "a|bc")], "k int, i int, x string, y string")
    assert len({stats.chained(df, "k", ["i"], ["x", "y"]).first().hash for df in (one, two, none)}) == 3


def test_no_window_sees_the_future(spark):
    rng = random.Random(1)
    full = panel(spark, [rng.random() + 1 for _ in range(80)]).withColumns({c: F.col("v") for c in ("open", "high", "low", "close")}).cache()
    past = full.where(F.col("ts") < F.lit(T0 + 50 * H))
    for f in (lambda p: rolling.rolling(p, "key", "ts", "v", 10, 5), lambda p: rolling.timed_zscore(p, "key", "ts", "v", 36_000, 4), lambda p: rolling.spikes(p, "key", "ts", "v", 10, 5, 1.1),
              lambda p: rolling.pivots(p, "key", "ts", "high", "low", 3, 3), lambda p: folds.ema(p, "key", ["ts"], "v", 0.2, seed=5), lambda p: rolling.garman_klass(p, "key", "ts", 6, 3600),
              lambda p: rolling.persistence(p, "key", "ts", "v", 12, 4), lambda p: series.prior_zscore(p, "key", "ts", "v", 10, 5)):
        late = f(full).where(F.col("ts") < F.lit(T0 + 50 * H))
        assert late.exceptAll(f(past)).isEmpty()


def test_gaps_break_contiguity(spark):
    rows = spark.createDataFrame([("a", T0 + i * H, 1.0, 2.0) for i in (0, 1, 2, 3, 5, 6, 7, 8, 9, 10, 11, 12)], "key string, ts timestamp_ntz, part double, whole double")
    got = column(rolling.share_momentum(rows, "key", "ts", "part", "whole", 4, 3600), "momentum")
    assert got == [None] * 11 + [0.0]


def test_equal_times_go_by_the_tie(spark):
    rows = spark.createDataFrame([("a", T0, i) for i in range(5)], "key string, ts timestamp_ntz, i int")
    assert column(series.gaps(rows, "key", "ts", 10, tie="i"), "gap_s", "i") == [None, 0.0, 0.0, 0.0, 0.0]


def test_bins_of_ties_nulls_and_one_value(spark):
    x = spark.createDataFrame([(i, v) for i, v in enumerate([5.0, 5.0, 5.0, None])], "i int, v double").withColumn("g", F.lit(1))
    assert column(sections.quantile_bins(x, ["g"], "v", 4), "bin", "i") == [1, 1, 1, None]
    assert column(sections.signed_bins(x.withColumn("v", F.lit(0.0)), "v"), "bin", "i") == [None] * 4
    with pytest.raises(ValueError):
        sections.binned(F.col("v"), [0, 1], ["a", "b"])


def test_masks_and_names():
    with pytest.raises(ValueError):
        filters.mask({"v": {"about": 1}})
    assert filters.leaking_columns(["ret_fwd_4h", "close", "next_open", "forwarder", "y_label"]) == ["ret_fwd_4h", "next_open", "y_label"]


def test_null_bounds_meet_no_mask(spark):
    x = spark.createDataFrame([(1, None), (2, 3.0)], "i int, v double")
    assert [r.i for r in x.where(~filters.mask({"v": {"min": 1}})).collect()] == [1]


def test_greedy_pairs_take_the_nearest_first(spark):
    of = lambda xs: spark.createDataFrame([("k", T0 + dt.timedelta(seconds=s), s) for s in xs], "key string, ts timestamp_ntz, i int")
    got = {(r.l_id, r.r_id) for r in relations.greedy_pairs(of([0, 10]), of([4, 11]), "key", "ts", 20, "i", "i").collect()}
    assert got == {(10, 11), (0, 4)}
    assert relations.greedy_pairs(of([0]), of([100]), "key", "ts", 20, "i", "i").isEmpty()


def test_admission_closes_before_it_opens(spark):
    rows = [("b", T0, T0 + H, "x", "long"), ("b", T0 + H, T0 + 3 * H, "y", "long"), ("b", T0 + 2 * H, T0 + 4 * H, "z", "long"), ("b", T0 + 3 * H, T0 + 4 * H, "y", "short"), ("b", None, T0, "y", "short")]
    x = spark.createDataFrame(rows, "book string, a timestamp_ntz, z timestamp_ntz, m string, side string")
    got = {(r.m, r.decision) for r in admission.admitted(x, "book", ["a"], "a", "z", "m", {"side": 1}, 1).collect()}
    assert got == {("x", "accept"), ("y", "accept"), ("z", "total"), ("y", "incomplete")}
    assert {r.rule for r in admission.violations(x.dropna(), "book", "a", "z", "m", 1).collect()} == {"total"}


def test_drawn_rows_are_those_with_the_smallest_hashes(spark):
    import hashlib

    rows = spark.range(3000).select((F.col("id") % 2).alias("g"), "id")
    got = {(r.round, r.g, r.id) for r in stats.drawn(rows, ["g"], stats.seeded("s", "round", "g", "id"), F.lit(37), 3).collect()}
    want = set()
    for k in range(3):
        for g in range(2):
            want |= {(k, g, i) for _, i in sorted((hashlib.md5(f"s:{k}:{g}:{i}".encode()).hexdigest(), i) for i in range(g, 3000, 2))[:37]}
    assert got == want


def test_placebo_and_tests(spark):
    rng = random.Random(2)
    x = spark.createDataFrame([(i, rng.gauss(i % 2 * 2, 1)) for i in range(300)], "i int, v double")
    real = nulls.placebo(x, "i", "v", F.col("i") % 2 == 0, 20, "p").first()
    assert real.rounds == 20 and real.significant <= 0.25 and real.p < 1e-6
    p = [r.p for r in spark.createDataFrame([(0.0,), (1.959964,), (-1.959964,), (9.0,)], "z double").select(nulls.two_sided(F.col("z")).alias("p")).collect()]
    assert p == pytest.approx([1, 0.05, 0.05, 0], abs=1e-6)


def test_percentile_gate(spark):
    for values, obs, rank, passed in (([*range(100)], 200, 1.0, True), ([*range(1, 101)], 0, 0.0, False), ([*range(100)], 83, 0.84, False), ([*range(100)], 94, 0.95, True), ([10] * 50 + [20] * 50, 10, 0.5, False), ([-5, -3, -1, 0, 2], -2, 0.4, False)):
        g = nulls.gate(spark.createDataFrame([(float(v),) for v in values], "v double"), F.lit(float(obs)), "v").first()
        assert (g["rank"], g["passed"]) == (pytest.approx(rank), passed)


def test_false_discovery_by_hand(spark):
    x = spark.createDataFrame([("f", i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5, None])], "f string, i int, p double")
    assert column(stats.adjusted(x, ["f"], "p"), "q", "i") == pytest.approx([0.04, 0.04, 0.04, 0.5, None])


def test_clusters(spark):
    rows = spark.createDataFrame([(i, float(i % 3 * 100 + i % 5), None if i == 7 else float(i % 3)) for i in range(90)], "i int, a double, b double")
    x = clusters.robust_scaled(rows, ["a", "b"])
    assert x.where("i = 7").first().b_z == 0
    k = clusters.k_means(x, ["a", "b"], 3)
    assert k.groupBy("cluster", F.col("i") % 3).count().count() == 3
    assert {r.cluster for r in clusters.composite(x, ["a", "b"], 3).collect()} == {0, 1, 2}


def test_circles_of_needs_are_told(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "artifact int, built_at int")
    assert {r.artifact: (r.direct, r.stale) for r in quality.stale(a, spark.createDataFrame([(2, 1), (1, 3)], "artifact int, needs int")).collect()} == {1: (True, True), 2: (False, True), 3: (True, True)}
    with pytest.raises(ValueError):
        quality.stale(a, spark.createDataFrame([(1, 2), (2, 1)], "artifact int, needs int"), most_depth=5)


def test_files_are_found_sampled_and_indexed(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([("x", T0 + i * H, float(i)) for i in range(5)] + [("y", T0, 1.0)], "key string, ts timestamp_ntz, v double")
    sinks.write_panel(rows, p + "/panel", p + "/index", "key", "ts")
    assert {(r.key, r.n_rows) for r in spark.read.parquet(p + "/index").collect()} == {("x", 5), ("y", 1)}
    found = files.discovered(spark, p + "/panel", {"key=x": 5, "csv": 1}, "*.csv.gz")
    assert sorted(r.score for r in found.collect()) == [1, 6]
    best = files.latest(found, F.lit("all")).first().path
    assert "key=x" in best and files.sample_csv(spark, best, 2).count() == 2
    sinks.append_csv(rows.limit(1), p + "/log")
    sinks.append_csv(rows.limit(2), p + "/log")
    assert spark.read.option("header", True).csv(p + "/log").count() == 3
    assert {r.key: dict(r.counts) for r in sinks.category_counts(rows, ["key"], "v").collect()}["y"] == {"1.0": 1}
    bad = rows.withColumn("_file", F.lit("f")).withColumn("i", F.when(F.col("v") == 3, 9).otherwise(F.col("v")))
    faults = files.series_faults(bad, "key", F.lit("x"), "ts", "i").first()
    assert (faults.n_rows, faults.other_symbol) == (6, 1) and faults.not_increasing >= 1
    assert [r.key for r in files.pairs(rows, rows.where("v = 4"), ["key"]).collect()] == ["x"]
    one = sinks.size_estimate(rows, 10, ["key"], 100.0).first()
    assert (one["rows"], one.gb) == (30.0, pytest.approx(3e-6))


def test_streams_slide_section_and_beat(spark, tmp_path):
    p = str(tmp_path)
    rows = spark.createDataFrame([("ab"[i % 2], T0 + dt.timedelta(minutes=20 * i), float(i)) for i in range(60)], "key string, ts timestamp, v double")
    rows.write.parquet(p + "/in")
    read = lambda: spark.readStream.schema(rows.schema).parquet(p + "/in")
    for name, flow, static in (("slide", flows.sliding_sums(read(), "key", "ts", "v", "2 hours", "1 hour"), flows.sliding_sums(rows, "key", "ts", "v", "2 hours", "1 hour")),
                               ("section", flows.cross_sections(read(), "ts", "v", 1), flows.cross_sections(rows, "ts", "v", 1))):
        q = flows.started(flow, f"{p}/{name}", f"{p}/{name}-c")
        q.awaitTermination()
        got = spark.read.parquet(f"{p}/{name}")
        assert got.count() > 20 and got.exceptAll(static).isEmpty()  # windows that are still open have not come
    beat = flows.started(flows.observed(read(), "beat", "ts"), p + "/beat", p + "/beat-c")
    beat.awaitTermination()
    assert beat.lastProgress["observedMetrics"]["beat"]["n_rows"] == 60
    seen = rows.withColumn("confirm", F.lit("1")).withColumn("now", F.lit(T0 + dt.timedelta(hours=3)))
    assert flows.closed_bars(seen, "ts", "confirm", 3600, "now").count() == 7


def test_replays_of_short_and_null_groups(spark):
    rows = [("a", i, float(i)) for i in range(40)] + [("b", 0, 2.0), ("c", 0, None), (None, 0, 1.0)]
    x = spark.createDataFrame(rows, "g string, i int, v double")
    got = {(r.g, r.round, r.method): r.score for r in replays.replays(x, ["g"], ["i"], "v", 3, 30, "t").collect()}
    assert {g for g, *_ in got} == {"a", "b"} and len({m for *_, m in got}) == 12
    for k in range(3):
        # a group of one row is drawn whole: no block, no other member
        assert got["b", k, "rows"] == got["b", k, "medians"] == got["b", k, "block"] == got["b", k, "members_out"] == 2.0
        assert got["a", k, "flipped"] == -got["a", k, "rows"] and -35 <= got["a", k, "costs"] - got["a", k, "rows"] <= -5
        block = got["a", k, "block"] / 10**0.5  # ten rows in a row: their mean is a half
        assert abs(block % 1 - 0.5) < 1e-9 and 4.5 <= block <= 34.5
    assert replays.replays(x.where("g = 'c'"), ["g"], ["i"], "v", 3, 30, "t").count() == 0


def test_joint_null_finds_what_shuffling_breaks(spark):
    # a state that turns every step in some periods, and rests in the others
    rows = [(i, f"p{i // 30:02d}", float(i % 2 if (i // 30) % 2 else (i // 15) % 2), None) for i in range(720)]
    x = spark.createDataFrame(rows, "i int, period string, v double, empty double")
    periods = [f"p{k:02d}" for k in range(24)]
    got = {r.model: r for r in replays.joint_null(x, "i", "period", ["v", "empty"], periods, 6, 30, "t", replays.Strict(0.3, 6.0, 12)).collect()}
    assert set(got) == {"periods", "blocks", "alone", "within"} and all(r.rounds == 6 and r.observed_axes > 0 for r in got.values())
    assert got["periods"].p_joint == 1.0 and got["within"].p_joint == 0.0


def test_controls_without_candidates(spark):
    kinds = "k int, total double, positive long, active long, events long"
    controls = spark.createDataFrame([(i, float(i), 12, 12, 50) for i in range(5)] + [(9, None, 1, 1, 1)], kinds)
    modes = {"as_drawn": replays.Mode(), "flipped": replays.Mode(flipped=True)}
    assert replays.control_baseline(controls.limit(0), controls, modes, 4, "t", ["k"]).count() == 0
    got = {r.mode: r for r in replays.control_baseline(controls.where("k = 4"), controls, modes, 20, "t", ["k"]).collect()}
    assert got["as_drawn"].p_strict == 1.0 or got["as_drawn"].any_strict > 0
    assert got["flipped"].any_strict == 0.0 and got["flipped"].p_best == 1 / 21 and got["flipped"].risk == "LOW"
    alone = replays.control_baseline(controls.where("k = 4"), controls.limit(0), modes, 4, "t", ["k"]).collect()
    assert {r.mode for r in alone} == set(modes)


def test_garman_klass_over_a_bad_bar(spark):
    """A bar that reaches down to 0 leaves no volatility in the windows that hold it, not one of 0."""
    x = panel(spark, [10.0 + i % 3 for i in range(12)]).withColumns({"open": F.col("v"), "close": F.col("v"), "high": F.col("v") + 1, "low": F.when(F.hour("ts") == 5, 0.0).otherwise(F.col("v") - 1)})
    got = column(rolling.garman_klass(x, "key", "ts", 3, 3600), "gk_vol")
    assert [v is None for v in got] == [i < 2 or 5 <= i <= 7 for i in range(12)] and all(v > 0 for v in got if v is not None)


def test_sides_paid_whatever_the_order_of_rows(spark, tmp_path):
    """Sums of doubles are taken by key: trades that cancel leave a rest whose sign hangs on the order."""
    from tidemark.operators import tables
    from tidemark.plans import catalogue

    rows = spark.createDataFrame([("a", 3, "long", -1e16), ("a", 2, "long", 1e16), ("a", 1, "long", 1.0), ("a", 4, "short", 5.0), ("b", 3, "long", 1.0), ("b", 2, "long", -1e16), ("b", 1, "long", 1e16), ("c", 1, "short", 1.0)], "k string, i int, s string, v double")
    got = {r.k: (r.pays, r.sides) for r in tables.sides_paid(rows, ["k"], ["i"], "s", "v", "long").collect()}
    assert got == {"a": (False, 2), "b": (True, 1), "c": (False, 1)}
    orders = spark.read.parquet("/root/testdata/sf0.1/orders.parquet")
    orders.repartition(7).sortWithinPartitions(F.desc("o_orderkey")).write.parquet(str(tmp_path / "orders.parquet"))
    flags = lambda d: {tuple(r) for r in catalogue.queries()["side_flags"](spark, d).collect()}
    assert flags(str(tmp_path)) == flags("/root/testdata/sf0.1")


def test_block_ids_equal_sql_at_the_turn_of_a_week(spark, tmp_path):
    """The SQL rounds times to whole seconds, divides them as integers and puts rows without a time last."""
    import duckdb

    from tidemark.plans import catalogue

    us = "TIMESTAMP '2024-01-11 00:00:00' + to_microseconds(d)"
    odd = f"""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END AS ts, 'view' AS event_type FROM (SELECT row_number() OVER (ORDER BY ts) AS event_id, ts FROM (
      SELECT {us} AS ts FROM (SELECT unnest([-1500000, -500001, -500000, -499999, -1, 0, 499999, 500000, 500001]) AS d) UNION ALL SELECT make_timestamp(d) FROM (SELECT unnest([-604800500001, -604800000000, -604799400000, -700000, -400000, 400000]) AS d)
      UNION ALL SELECT TIMESTAMP '2024-01-12' + to_seconds(i) FROM range(1200) t(i)))"""
    db = duckdb.connect()
    db.execute(f"COPY ({odd}) TO '{tmp_path}/events.parquet'")
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = [tuple(r) for r in catalogue.queries()["block_ids"](spark, str(tmp_path)).orderBy("event_id").collect()]
    want = db.execute(f"SELECT event_type, week, chunk, event_id FROM ({catalogue.oracle_sql()['block_ids']}) ORDER BY event_id").fetchall()
    assert got == want


def test_placebo_hashes_rows_once(spark):
    """What is left after the sums of ranks are kept is a row a round; values that repeat two million times do not overflow."""
    rows = spark.range(2_200_000).select("id", F.when(F.col("id") % 100 == 0, F.col("id").cast("double")).otherwise(0.0).alias("v"), (F.col("id") % 3 == 0).alias("f"))
    got = nulls.placebo(rows, "id", "v", F.col("f"), 2, "p")
    assert "md5" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.first().rounds == 2 and got.first().p > 0.05
    none = nulls.placebo(rows.limit(0), "id", "v", F.col("f"), 2, "p").first()
    assert none.rounds == 0 and none.significant is None
    alone = nulls.placebo(rows.limit(50), "id", "v", F.lit(False), 3, "p").first()
    assert alone.rounds == 3 and alone.significant == 0


def test_mean_ranks_over_ranges(spark):
    counts = spark.createDataFrame([(float(v), v % 7 + 1, v % 3) for v in range(500)], "v double, n long, m long")
    want, a, b = {}, 0, 0
    for v in range(500):
        n, m = v % 7 + 1, v % 3
        want[float(v)] = (a + (n + 1) / 2, b + (m + 1) / 2)
        a, b = a + n, b + m
    assert {r.v: (r.all, r.some) for r in nulls.mid_ranks(counts.repartition(5), "v", {"all": "n", "some": "m"}).collect()} == want
