"""Large keys, exact quantiles and places, draws, open ends, helper columns, folds, stored sums, t tests, nested differences, order books."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import evaluate, nulls, quality, scalars, stats, student
from tidemark.operators import admission, folds, joins, quantiles, relations, rolling, sections, series
from tidemark.operators.names import spare
from tidemark.sources import sinks

T0 = datetime(2024, 1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_forward_asof_of_one_large_key(spark):
    n = 40_000
    left = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 10 + 5).alias("ts"))
    right = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("ts"), F.col("id").alias("v"))
    took = {}
    for forward in (False, True, False, True):  # the second look is warm
        t = time.time()
        out = joins.asof(left, right, "k", "ts", ["v"], forward=forward)
        got = out.agg(F.sum("r_v"), F.count("r_v")).first()
        took[forward] = time.time() - t
        assert tuple(got) == ((n * (n - 1) // 2, n - 1) if forward else (n * (n - 1) // 2, n))
    assert took[True] <= 3 * took[False] + 2
    assert "unboundedfollowing" not in plan(out).lower()
    moves = relations.forward_moves(right.withColumn("v", F.col("v").cast("double") + 1), "k", "ts", "v", 20, "v")
    assert moves.where("fwd_bps IS NOT NULL").count() == n - 2


def test_forward_asof_ties(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    left = spark.createDataFrame([("a", at(0)), ("a", at(5)), ("a", at(9)), ("b", at(0)), (None, at(0)), ("a", None)], "k string, ts timestamp")
    right = spark.createDataFrame([("a", at(5), 3), ("a", at(5), 1), ("a", at(5), None), ("a", at(8), 2), (None, at(1), 7)], "k string, ts timestamp, v int")
    got = joins.asof(left, right, "k", "ts", ["v"], forward=True, tie="v")
    assert sorted((str(r.k), str(r.ts), r.r_v) for r in got.collect()) == sorted([("a", str(at(0)), None), ("a", str(at(5)), None), ("a", str(at(9)), None), ("b", str(at(0)), None), ("None", str(at(0)), None), ("a", "None", None)])
    got = joins.asof(left, right.where("v IS NOT NULL"), "k", "ts", ["v"], forward=True, tie="v")
    assert sorted((str(r.k), str(r.ts), r.r_v) for r in got.collect() if r.r_v) == [("a", str(at(0)), 1), ("a", str(at(5)), 1)]


def test_false_discovery_of_a_large_family(spark):
    n = 20_000
    p = np.random.default_rng(0).random(n)
    df = spark.createDataFrame([("f", i, float(x)) for i, x in enumerate(p)], "f string, i int, p double")
    t = time.time()
    q = {r.i: r.q for r in stats.adjusted(df, ["f"], "p", tie="i").collect()}
    assert time.time() - t < 10
    order = np.argsort(p)
    want = np.minimum.accumulate((p[order] * n / np.arange(1, n + 1))[::-1])[::-1]
    assert np.allclose([q[i] for i in order], np.minimum(want, 1))


def test_open_ends(spark):
    at = lambda h: T0 + timedelta(hours=h)
    spans = spark.createDataFrame([("a", at(0), None), ("a", at(0), at(1)), ("b", at(0), at(1)), ("b", at(1), None), ("c", None, at(1)), ("c", at(0), at(2))], "k string, s timestamp, e timestamp")
    assert {r.k: r.most_open for r in series.concurrency(spans, "k", "s", "e").collect()} == {"a": 2, "b": 1, "c": 1}
    rows = spans.withColumn("m", F.col("k"))
    assert {(r.k, r.rule) for r in admission.violations(rows, "k", "s", "e", "m", 1).collect()} == {("a", "total"), ("a", "overlap")}


def test_tails_over_a_half(spark):
    df = spark.createDataFrame([(1, i, float(i)) for i in range(4)], "t int, i int, v double")
    for share in (0.75, 0.0):
        with pytest.raises(ValueError):
            series.tails(df, ["t"], "v", "i", share, 1)
    assert series.tails(df, ["t"], "v", "i", 0.5, 1).count() == 4


def test_helper_columns_leave_those_of_the_caller(spark):
    names = ["_x", "_s", "_same", "_span", "_us", "_kept", "_h", "_l", "_ret", "_gk", "_whole", "_tr", "_step", "_at", "_q", "_u", "_k", "_n", "_in", "_out", "_backup", "_primary", "_raw", "_rank", "_cuts"]
    rows = spark.createDataFrame([("k", T0 + timedelta(hours=i), float(i % 5 + 1), i) for i in range(30)], "k string, ts timestamp, v double, i int")
    rows = rows.withColumns({n: F.lit("mine") for n in names}).withColumns({c: F.col("v") for c in ("open", "high", "low", "close")})
    made = {
        "ema": folds.ema(rows, "k", ["ts"], "v", 0.5), "wilder": folds.wilder_range(rows, "k", ["ts"], "v", "v", "v", 3), "persistence": rolling.persistence(rows, "k", "ts", "v", 4, 2),
        "cooldown": series.cooldown(rows, "k", "ts", 7200, "i"), "pivots": rolling.pivots(rows, "k", "ts", "v", "v", 1, 1), "regime": rolling.regime(rows, "k", "ts", "close", "v", 2, 0.0),
        "gk": rolling.garman_klass(rows, "k", "ts", 3, 3600), "range": rolling.mean_range(rows, "k", "ts", "v", "v", "v", 3), "momentum": rolling.share_momentum(rows, "k", "ts", "v", "v", 2, 3600),
        "two": rolling.two_factor(rows, "k", "ts", "v", "i", "high", 5), "walk": folds.walk_forward(rows, "ts", F.lit(T0), 1, 1, 1), "windows": folds.rolling_windows(rows, "ts", F.lit(T0), (1,), ("all",), 1, 1),
        "bins": sections.quantile_bins(rows, [], "v", 3), "signed": sections.signed_bins(rows, "v"), "over": sections.over_quantile(rows, "v", 0.5, ["k"]), "bh": stats.adjusted(rows.withColumn("p", F.lit(0.1)), ["k"], "p", tie="i"),
        "drawn": stats.drawn(rows, ["k"], stats.seeded("s", "round", "i"), F.lit(3), 2), "admitted": admission.admitted(rows.withColumn("e", F.col("ts")), "k", ["ts"], "ts", "e", "i", {}, 2),
    }
    for name, out in made.items():
        got = out.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [("mine",) * len(names)], name
    assert spare(rows, "_X", "_x", "new") == ["__X", "___x", "new"]


def test_backup_candidates(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = spark.createDataFrame([("b", 1, at(0), at(3), "m1", "main"), ("b", 2, at(1), at(2), "m2", "spare"), ("b", 3, at(4), at(9), "m3", "spare"), ("b", 4, at(5), at(9), "m4", "spare"), ("b", 5, at(6), at(8), "m5", "main")], "b string, i int, s timestamp, e timestamp, m string, f string")
    run = lambda **more: {r.i: r.decision for r in admission.admitted(rows, "b", ["s", "i"], "s", "e", "m", {}, 9, **more).collect()}
    assert set(run().values()) == {"accept"}
    assert run(backup=F.col("f") == "spare", primary=F.col("f") == "main") == {1: "accept", 2: "backup", 3: "accept", 4: "accept", 5: "accept"}
    assert run(backup=F.col("f") == "spare") == {1: "accept", 2: "backup", 3: "accept", 4: "backup", 5: "accept"}


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    groups = {"even": rng.random(5000), "hot": np.where(rng.random(4000) < 0.9, 7.0, rng.standard_normal(4000)), "few": np.array([3.0, 1.0]), "one": np.array([5.0]), "wide": np.exp(rng.standard_normal(3000) * 20) * rng.choice([-1, 1], 3000)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("none", None), (None, 1.0), (None, 2.0), ("even", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.777, 0.999, 1.0]
    got = {r.k: r for r in quantiles.quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == {*groups, None} and got[None].q[3] == 1.5
    for k, v in groups.items():
        assert got[k].n == len(v) and np.allclose(got[k].q, np.quantile(v, qs), rtol=1e-12, atol=0), k
    whole = quantiles.quantiles(df, [], F.abs("v"), [0.5]).first()
    assert np.isclose(whole.q[0], np.median([abs(x) for _, x in rows if x is not None]))
    assert tuple(quantiles.quantiles(df.limit(0), [], "v", [0.5]).first()) == (0, [None]) and quantiles.quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0
    kept = quantiles.with_quantiles(df, ["k"], "v", [0.5], "m")
    assert kept.count() == len(rows) and kept.where("k = 'none' AND m IS NULL").count() == 1
    assert quantiles.with_quantiles(df.where("v IS NULL"), [], "v", [0.5], "m").count() == 2


def test_no_task_sorts_a_whole_column(spark):
    df = spark.range(200_000).select(F.xxhash64("id").cast("double").alias("v"))
    text = plan(quantiles.quantiles(df, [], "v", [0.5]))
    assert "percentile(" not in text  # the exact one, which holds all values


def test_places_in_a_huge_group(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 10 else "small", int(x), i) for i, x in enumerate(rng.integers(0, 500, 5000))] + [(None, 1, -1), (None, None, -2)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    try:
        got = quantiles.numbered(spark.createDataFrame(rows, "k string, v int, i int"), ["k"], ["v", "i"])
        found = {(r.k, r.v, r.i): (r._i, r._n) for r in got.collect()}
        whole = quantiles.numbered(spark.createDataFrame(rows, "k string, v int, i int"), [], ["v", "i"]).orderBy("_i").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    for k in ("hot", "small", None):
        mine = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        assert [found[r] for r in mine] == [(i, len(mine)) for i in range(len(mine))]
    assert [r._i for r in whole] == list(range(len(rows)))


def test_draws_equal_a_sort(spark):
    import hashlib

    rows = [(b, i) for b, n in (("a", 3000), ("b", 40), ("c", 3)) for i in range(n)] + [("dup", 7)] * 50
    k = {"a": 700, "b": 39, "c": 5, "dup": 20}
    df = spark.createDataFrame(rows, "b string, i int").withColumn("k", F.create_map(*[F.lit(x) for p in k.items() for x in p])[F.col("b")])
    got = {}
    for r in stats.drawn(df, ["b"], stats.seeded("s", "round", "b", "i"), F.col("k"), 4).collect():
        got.setdefault((r.round, r.b), []).append(r.i)
    for b in k:
        ids = [i for x, i in rows if x == b]
        for n in range(4):
            want = sorted(ids, key=lambda i: hashlib.md5(f"s:{n}:{b}:{i}".encode()).hexdigest())[: k[b]]  # noqa: B023
            assert sorted(got[n, b]) == sorted(want), (n, b)


def test_permuted_means_equal_the_draws(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("b"), "id", (F.col("id") % 17).cast("double").alias("v"))
    label = F.col("id") % 5 == 0
    got = {r.round: (round(r.null_mean, 9), r.n) for r in stats.permuted_means(df, ["b"], "id", label, "v", 6, "s").collect()}
    k = df.where(label).groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    want = stats.drawn(df.join(k, "b"), ["b"], stats.seeded("s", "round", "b", "id"), F.col("k"), 6).groupBy("round").agg(F.avg("v").alias("m"), F.count(F.lit(1)).alias("n"))
    assert got == {r.round: (round(r.m, 9), r.n) for r in want.collect()}
    same = spark.createDataFrame([(0, 1, float(i)) for i in range(100)], "b int, id int, v double")  # one id, so one hash
    assert [r.n for r in stats.permuted_means(same, ["b"], "id", F.col("v") < 10, "v", 2, "s").collect()] == [10, 10]


def test_bootstraps(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(5, 2, 2000)
    df = spark.createDataFrame([("g", i, float(x)) for i, x in enumerate(v)], "g string, i int, v double")
    for more in ({}, {"block": 24}):
        m = np.array([r.mean for r in nulls.bootstrap(df, ["g"], ["i"], "v", 60, "s", **more).collect()])
        assert len(m) == 60 and abs(m.mean() - v.mean()) < 0.03 and 0.6 < m.std() / (v.std() / np.sqrt(2000)) < 1.5
    flips = np.array([r.mean for r in nulls.bootstrap(df, ["g"], ["i"], "v", 60, "s", flip=True).collect()])
    assert abs(flips.mean()) < 0.06 and 0.07 < flips.std() < 0.2
    x = [float(i) for i in range(10)]
    small = spark.createDataFrame([("g", i, y) for i, y in enumerate(x)], "g string, i int, v double")
    runs = {round(sum(x[(s + k) % 10] for s, n in ((a, 4), (b, 4), (c, 2)) for k in range(n)) / 10, 9) for a in range(10) for b in range(10) for c in range(10)}
    assert all(round(r.mean, 9) in runs for r in nulls.bootstrap(small, ["g"], ["i"], "v", 30, "s", block=4).collect())


def test_rolling_and_quantile_folds(spark):
    rows = spark.createDataFrame([(T0 + timedelta(days=d), d) for d in range(0, 60)], "ts timestamp, d int")
    got = folds.rolling_windows(rows, "ts", F.lit(T0), (20, 10, 10), ("discovery", "validation", "test"), 10, 3)
    of = {}
    for r in got.collect():
        of.setdefault((r.fold, r.part), set()).add(r.d)
    assert of == {(f, p): set(range(f * 10 + a, f * 10 + b)) for f in range(3) for p, a, b in (("discovery", 0, 20), ("validation", 20, 30), ("test", 30, 40))}
    got = folds.quantile_folds(rows.where("d < 23"), ["ts"], 5)
    of = {}
    for r in got.collect():
        of.setdefault((r.fold, r.part), set()).add(r.d)
    assert of == {(f, p): x for f in range(1, 5) for p, x in (("train", set(range(4 * f))), ("test", set(range(4 * f, 23 if f == 4 else 4 * f + 4))))}
    assert folds.quantile_folds(rows.where("d < 9"), ["ts"], 5).count() == 0
    with pytest.raises(ValueError):
        folds.rolling_windows(rows, "ts", F.lit(T0), (20, 10), ("all",), 10, 3)


def test_stored_partials_of_a_scan_that_broke_off(spark, tmp_path):
    rows = spark.createDataFrame([(d, k, float(d * k % 7), 1) for d in range(6) for k in range(20)], "d int, k int, v double, side int").withColumn("g", F.col("k") % 3)
    one, many = [(str(tmp_path / n), str(tmp_path / f"{n}-manifest")) for n in ("one", "many")]
    sinks.scan_partials(rows, *one, ["d"], ["g"], "v", "side")
    sinks.scan_partials(rows.where("d < 3"), *many, ["d"], ["g"], "v", "side")
    # the next unit was written before the run broke off, but never told to the manifest
    sections.partials(rows.where("d = 3 AND k < 5"), ["d", "g"], "v", "side").write.partitionBy("d").mode("append").parquet(many[0])
    read = lambda p: sorted(map(tuple, sinks.stored_partials(spark, *p, ["d"], ["g"]).collect()))
    assert sum(r[1] for r in read(many)) == 60
    for _ in range(2):  # the second run finds nothing to do
        sinks.scan_partials(rows, *many, ["d"], ["g"], "v", "side")
        assert read(many) == read(one) and sum(r[1] for r in read(one)) == 120


def test_t_distribution(spark):
    # 97.5 % and 99.5 % quantiles of Student's t.
    table = [(1.0, 12.7062047362, 63.6567411629), (2.0, 4.3026527297, 9.9248432009), (3.0, 3.1824463053, 5.8409093097), (5.0, 2.5705818356, 4.0321429836), (10.0, 2.2281388520, 3.1692726726), (30.0, 2.0422724563, 2.7499956536), (100.0, 1.9839715185, 2.6258905214), (1000.0, 1.9623390808, 2.5807546981)]
    df = spark.createDataFrame([(n, t, p) for n, a, b in table for t, p in ((a, 0.05), (-b, 0.01), (0.0, 1.0))], "n double, t double, p double")
    assert all(abs(r.got - r.p) < 1e-6 for r in df.select("p", student.two_sided(F.col("t"), F.col("n")).alias("got")).collect())
    edge = spark.createDataFrame([(0.5, 1.0), (None, 1.0), (3.0, None)], "n double, t double")
    assert [r.p for r in edge.select(student.two_sided(F.col("t"), F.col("n")).alias("p")).collect()] == [None] * 3
    near = spark.createDataFrame([(4000.0, 2.1), (4000.001, 2.1)], "n double, t double").select(student.two_sided(F.col("t"), F.col("n")).alias("p")).collect()
    assert abs(near[0].p - near[1].p) < 2e-7


def test_nested_differences(spark):
    a = [("x", '{"a":{"b":[1,{"c":"t"}],"d":null},"e":{}}'), ("y", "no json"), ("z", None), ("w", "3")]
    b = [("x", '{"a":{"b":[1,{"c":"u"},2],"d":null},"f":true}'), ("y", '{"k":1}'), ("w", "3")]
    mk = lambda r: spark.createDataFrame(r, "k string, body string")
    got = {(r.k, r.path): (r.kind, r.was, r.now) for r in quality.nested_diff(mk(a), mk(b), "k", "body").collect()}
    assert got == {("x", "$.a.b[1].c"): ("changed", '"t"', '"u"'), ("x", "$.a.b[2]"): ("added", None, "2"), ("x", "$.e"): ("removed", "{}", None), ("x", "$.f"): ("added", None, "true"), ("y", "$.k"): ("added", None, "1")}
    deep = "[" * 200 + "1" + "]" * 200
    assert [r.path for r in quality.leaves(mk([("d", deep)]), "k", "body").collect()] == ["$" + "[0]" * 200]


def test_gross_ladder(spark):
    rows = [("a", 1.0 if i < 12 else None, 2.0, 3.0) for i in range(20)] + [("b", 1.0 if i < 9 else None, 2.0 if i < 15 else None, 3.0) for i in range(18)] + [("c", 1.0, 2.0, 3.0)] * 9 + [("d", None, None, None)] * 3
    df = spark.createDataFrame(rows, "f string, x double, y double, z double")
    got = quality.gross_ladder(df, ["f"], [("native", F.col("x")), ("row", F.col("y"))], ("proposed", F.col("z")))
    assert {(r.f, r.basis, r.n) for r in got.groupBy("f", "basis").agg(F.count(F.lit(1)).alias("n")).collect()} == {("a", "native", 12), ("b", "row", 15), ("c", "proposed", 9)}
    tiers = quality.bps_quality(df, ["f"], [("native", F.col("x")), ("row", F.col("y")), ("proposed", F.col("z"))])
    assert {r.f: (r.tier, r.main_source) for r in tiers.collect()} == {"a": ("native_partial", "native"), "b": ("native_partial", "native"), "c": ("native_strong", "native"), "d": ("insufficient", None)}


def test_book_geometry(spark):
    rows = [(2.0, 3.0, 200.0, 306.0), (0.0, 3.0, 0.0, 300.0), (None, 1.0, None, 100.0), (1.0, -1.0, 100.0, -100.0)]
    got = spark.createDataFrame(rows, "bd double, ad double, bn double, an double").select(*[c.alias(k) for k, c in scalars.book_geometry("bd", "ad", "bn", "an").items()]).collect()
    assert tuple(got[0]) == (100.0, 102.0, 5.0, 101.0, 2.0, 2 / 101 * 10_000, -0.2, (100 * 3 + 102 * 2) / 5)
    assert tuple(got[1]) == (None, 100.0, 3.0, None, None, None, -1.0, None)
    assert tuple(got[2]) == (None, 100.0, None, None, None, None, None, None)
    assert tuple(got[3]) == (100.0, None, 0.0, None, None, None, None, None)


def test_return_stats_of_groups_without_returns(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "k string, r double")
    got = {r.k: (r.events, r.n, r.missing, r.q) for r in evaluate.return_stats(df, ["k"], "r", {"q": 0.5}).collect()}
    assert got == {"a": (2, 2, 0, 2.0), "b": (1, 0, 1, None)}
