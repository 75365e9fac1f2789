"""Seeded nulls and tests: every draw comes from a hash of seed, round and row, so that a rerun on any cluster gives the same."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import dealt, drawn_sums, seeded
from tidemark.operators.quantiles import beside, numbered
from tidemark.operators.shared import kept


def uniform(seed: str, *parts: str | Column) -> Column:
    """A number in [0, 1) from a hash of the parts."""
    return F.conv(F.substring(seeded(seed, *parts), 1, 8), 16, 10).cast("double") / float(1 << 32)


def gaussian(seed: str, *parts: str | Column) -> Column:
    """A standard normal number from two hashes of the parts."""
    u, v = uniform(seed + "-u", *parts), uniform(seed + "-v", *parts)
    return F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * 3.141592653589793 * v)


def rounds(df: DataFrame, n: int, name: str = "round") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def normal_cdf(z: Column) -> Column:
    """The normal distribution function by a fixed rational approximation (error under 1e-7)."""
    # The coefficients of Abramowitz and Stegun 26.2.17.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    x = F.abs(z)
    t = 1 / (1 + p * x)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2 * (1 - normal_cdf(F.abs(z))))


def gate(nulls: DataFrame, observed: Column, value: str, by: Sequence[str] = (), least: float = 0.95) -> DataFrame:
    """n, rank (share of null values at most the observed one), p (one-sided, with the observed one counted) and passed, by group."""
    v = F.col(value)
    out = nulls.groupBy(*by).agg(F.count(v).alias("n"), F.avg((v <= observed).cast("int")).alias("rank"), ((1 + F.count(F.when(v >= observed, 1))) / (1 + F.count(v))).alias("p"))
    return out.withColumn("passed", F.col("rank") >= least)


def block_shuffle(rows: DataFrame, ts: str, tie: str, signal: str, ret: str, block_s: int, n: int, seed: str) -> DataFrame:
    """round and null_mean of signal times the return at the same place of another block: whole blocks of time change places.

    Only blocks are multiplied by rounds and ranked (a row each); rows meet their partners in one hash join.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    x = rows.withColumn("_b", F.floor(us / (block_s * 1_000_000)))
    x = x.withColumn("_j", F.row_number().over(Window.partitionBy("_b").orderBy(ts, tie)))
    blocks = x.select("_b").distinct()
    b = rounds(blocks, n)
    w = Window.partitionBy("round")
    places = b.withColumn("_place", F.row_number().over(w.orderBy("_b"))).withColumn("_drawn", F.row_number().over(w.orderBy(seeded(seed, "round", "_b"))))
    moved = places.select("round", F.col("_b"), F.col("_place")).join(places.select("round", F.col("_b").alias("_from"), F.col("_drawn").alias("_place")), ["round", "_place"])
    # signals go to the places of _b, returns come from the block drawn there
    s = x.select("_b", "_j", F.col(signal).alias("_s")).join(moved, "_b")
    pairs = s.join(x.select(F.col("_b").alias("_from"), "_j", F.col(ret).alias("_r")), ["_from", "_j"])
    return pairs.groupBy("round").agg(F.avg(F.col("_s") * F.col("_r")).alias("null_mean"), F.count(F.lit(1)).alias("n"))


#: P(X <= k) of a Poisson variable of mean 1, for as many k as doubles tell apart from 1
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(18)]


def poisson(u: Column) -> Column:
    """A Poisson number of mean 1 from a number in [0, 1)."""
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def bootstrap(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int, seed: str, block: int = 1, flip: bool = False) -> DataFrame:
    """round and mean of n resamples of each group.

    block 1: each row counts a Poisson number of times (mean 1), as in a sample with replacement of a large group, and the mean is over all that counts; flip: rows stay
    and their signs are drawn. Both draw from the hash of round and `order` (which has to name a row), so that rows are only added up where they are read.
    block over 1: as many rows as the group has, in circular blocks of `block` rows from drawn places; running sums are taken once, and only the drawn places, one for each
    block and round, meet them. Rows of a null in `by` take no part in blocks.
    """
    x = rows.where(F.col(value).isNotNull())
    if block > 1:
        return _circular(numbered(x, by, order), by, value, n, seed, block)
    x = x.select(*by, *[c for c in order if c not in by], F.col(value).alias("_v"))
    # one hash a row and four rounds
    quads = dealt(x).withColumn("_four", F.explode(F.sequence(F.lit(0), F.lit((n - 1) // 4)))).withColumn("_h", seeded(seed, "_four", *by, *order))
    each = F.array(*[F.struct((4 * F.col("_four") + i).alias("round"), (F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("double") / float(1 << 32)).alias("u")) for i in range(4)])
    r = quads.select(*by, "_v", F.explode(each).alias("_d")).select(*by, "_v", F.col("_d.round").alias("round"), F.col("_d.u").alias("_u")).where(F.col("round") < n)
    if flip:
        return r.groupBy(*by, "round").agg(F.avg(F.when(F.col("_u") < 0.5, -F.col("_v")).otherwise(F.col("_v"))).alias("mean"))
    r = r.withColumn("_times", poisson(F.col("_u"))).where("_times > 0")
    return r.groupBy(*by, "round").agg((F.sum(F.col("_v") * F.col("_times")) / F.sum("_times")).alias("mean"))


#: rows of a group whose sums are run up in one go
RUN = 4096


def _circular(x: DataFrame, by: Sequence[str], value: str, n: int, seed: str, block: int) -> DataFrame:
    """What a block adds up to is the difference of two running sums, so a drawn block is two or three looks at them, whatever its length."""
    x = x.select(*by, "_i", "_n", F.col(value).alias("_v"), F.floor(F.col("_i") / RUN).alias("_run"))
    before = Window.partitionBy(*by).orderBy("_run")
    runs = x.groupBy(*by, "_run").agg(F.sum("_v").alias("_r")).withColumn("_r", F.sum("_r").over(before) - F.col("_r"))  # a row for each RUN rows
    upto = beside(x, runs, [*by, "_run"], "inner").select(*by, (F.col("_i") + 1).alias("_k"), (F.col("_r") + F.sum("_v").over(Window.partitionBy(*by, "_run").orderBy("_i"))).alias("_p"))
    start = F.floor(uniform(seed, "round", *by, F.floor(F.col("_i") / block)) * F.col("_n"))
    draws = rounds(x.where(F.col("_i") % block == 0).select(*by, "_i", "_n"), n).withColumn("_s", start).withColumn("_e", F.col("_s") + F.least(F.lit(block), F.col("_n") - F.col("_i")))
    look = lambda k, sign: F.struct(k.alias("_k"), F.lit(sign).alias("_sign"))
    over = F.col("_e") > F.col("_n")  # goes on at the group's begin
    looks = F.array(look(F.col("_s"), -1), look(F.when(over, F.col("_e") - F.col("_n")).otherwise(F.col("_e")), 1), look(F.when(over, F.col("_n")), 1))
    looks = draws.select("round", *by, F.explode(looks).alias("_l")).select("round", *by, "_l.*")
    got = looks.join(upto, [*by, "_k"]).groupBy(*by, "round").agg(F.sum(F.col("_p") * F.col("_sign")).alias("_p"))
    sizes = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    return beside(got, sizes, by, "inner").select(*by, "round", (F.col("_p") / F.col("_n")).alias("mean"))


def difference_interval(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, flag: Column, n: int, seed: str, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Bootstrap interval of the flagged rows' mean less the others': diff, low, high by group."""
    x = rows.withColumn("_side", flag.cast("int"))
    means = bootstrap(x, [*by, "_side"], order, value, n, seed).groupBy(*by, "round").agg((F.max(F.when(F.col("_side") == 1, F.col("mean"))) - F.max(F.when(F.col("_side") == 0, F.col("mean")))).alias("_d"))
    real = x.groupBy(*by).agg((F.avg(F.when(F.col("_side") == 1, F.col(value))) - F.avg(F.when(F.col("_side") == 0, F.col(value)))).alias("diff"))
    bounds = means.groupBy(*by).agg(F.percentile("_d", low).alias("low"), F.percentile("_d", high).alias("high"))
    return real.join(bounds, list(by)) if by else real.crossJoin(bounds)  # one row each


def mann_whitney(rows: DataFrame, by: Sequence[str], value: str, flag: Column) -> DataFrame:
    """n1, n2, u (of the flagged rows), z (ties and continuity corrected), p (two-sided) and effect (1 - 2u / n1 n2) by group.

    Values are counted first: ranks come from a window over distinct values.
    """
    c = rows.where(F.col(value).isNotNull()).withColumn("_f", flag).groupBy(*by, value).agg(F.count(F.when(F.col("_f"), 1)).alias("_a"), F.count(F.when(~F.col("_f"), 1)).alias("_b"))
    return _from_counts(c, by, value)


def _from_counts(c: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(value)
    t = F.col("_a") + F.col("_b")
    c = c.withColumn("_rank", F.sum(t).over(w) - (t - 1) / 2)
    return _tested(c.groupBy(*by).agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("_rank")).alias("_r1"), _ties(t).alias("_ties")))


def _ties(t: Column) -> Column:
    """Sum of t cubed less t, in doubles: the cube of two million leaves no room in a long."""
    t = t.cast("double")
    return F.sum(t * t * t - t)


def _tested(s: DataFrame) -> DataFrame:
    """u, z, p and effect from n1, n2, the sum of ranks and the ties' sum."""
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    s = s.withColumn("u", F.col("_r1") - n1 * (n1 + 1) / 2)
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("_ties") / F.nullif(n * (n - 1), F.lit(0)))
    mid = n1 * n2 / 2
    z = (F.abs(F.col("u") - mid) - 0.5) / F.sqrt(F.when(var > 0, var)) * F.signum(F.col("u") - mid)
    return s.withColumn("z", z).withColumn("p", two_sided(F.greatest(F.abs("z"), F.lit(0.0)))).withColumn("effect", 1 - 2 * F.col("u") / F.nullif(n1 * n2, F.lit(0))).drop("_r1", "_ties")


def welch(rows: DataFrame, by: Sequence[str], value: str, flag: Column) -> DataFrame:
    """n1, n2, diff, t, df (Welch-Satterthwaite) and p (two-sided, of Student's t) of the flagged rows' mean against the others'."""
    side = lambda on: F.when(flag if on else ~flag, F.col(value))
    s = rows.groupBy(*by).agg(F.count(side(True)).alias("n1"), F.count(side(False)).alias("n2"), F.avg(side(True)).alias("_m1"), F.avg(side(False)).alias("_m2"), F.var_samp(side(True)).alias("_v1"), F.var_samp(side(False)).alias("_v2"))
    a, b = F.col("_v1") / F.col("n1"), F.col("_v2") / F.col("n2")
    s = s.where("n1 > 1 AND n2 > 1").withColumn("diff", F.col("_m1") - F.col("_m2")).withColumn("t", F.col("diff") / F.sqrt(F.when(a + b > 0, a + b)))
    s = s.withColumn("df", F.pow(a + b, F.lit(2)) / F.nullif(F.pow(a, F.lit(2)) / (F.col("n1") - 1) + F.pow(b, F.lit(2)) / (F.col("n2") - 1), F.lit(0.0)))
    from tidemark.functions import student

    return s.withColumn("p", student.two_sided(F.col("t"), F.col("df"))).drop("_m1", "_m2", "_v1", "_v2")


def synthetic_months(months: DataFrame, value: str, models: Mapping[str, tuple[float, float]], n: int, size: int, seed: str) -> DataFrame:
    """model, round, total and positive of `size` made-up months: normal numbers with the months' own mean and deviation, shifted and scaled as each model says."""
    base = months.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    spark = months.sparkSession
    grid = spark.createDataFrame([(k, a, b) for k, (a, b) in models.items()], "model string, shift double, scale double")
    x = rounds(grid.crossJoin(base), n).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))  # models x one row
    v = F.col("_m") * F.col("shift") + F.col("_s") * F.col("scale") * gaussian(seed, "model", "round", "_j")
    return x.withColumn("_v", v).groupBy("model", "round").agg(F.sum("_v").alias("total"), F.avg((F.col("_v") > 0).cast("int")).alias("positive"))


def placebo(rows: DataFrame, id_col: str, value: str, flag: Column, n: int, seed: str, alpha: float = 0.05) -> DataFrame:
    """rounds, significant: the share of n rounds of shuffled labels whose Mann-Whitney p is under alpha, and the p of the labels as they are. One row."""
    x = rows.where(F.col(value).isNotNull()).select(F.col(id_col).alias("_id"), F.col(value).alias("_v"), flag.alias("_f"))
    counts = x.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"), F.count(F.when(F.col("_f"), 1)).alias("_a"), F.count(F.when(~F.col("_f"), 1)).alias("_b"))
    c = mid_ranks(counts.withColumn("_m", F.col("_a") + F.col("_b")), "_v", {"_rank": "_n", "_real": "_m"})
    s = c.agg(F.sum("_a").alias("n1"), F.sum("_b").alias("n2"), F.sum(F.col("_a") * F.col("_real")).alias("_r1"), _ties(F.col("_m")).alias("_ties"), F.sum("_n").alias("_n"), _ties(F.col("_n")).alias("_all"))
    # labels move, values stay: ranks, sizes and ties are those of every round, only the sum of the drawn rows' ranks is its own
    ranked = x.select("_id", "_v").join(c.select("_v", "_rank"), "_v")
    sums = drawn_sums(ranked, s.select(F.col("n1").alias("_k"), "_n"), ("_k", "_n"), [], "_id", "_rank", n, seed).select("round", F.col("total").alias("_r1"))
    each = rounds(s.where("_n > 0").select("n1", (F.col("_n") - F.col("n1")).alias("n2"), F.col("_all").alias("_ties")), n).join(F.broadcast(sums), "round", "left")  # a row a round
    shuffled = _tested(each.withColumn("_r1", F.coalesce("_r1", F.lit(0.0)))).agg(F.count(F.lit(1)).alias("rounds"), F.avg((F.col("p") < alpha).cast("int")).alias("significant"))
    return shuffled.crossJoin(_tested(s.drop("_n", "_all")).select("p"))  # one row each


def mid_ranks(counts: DataFrame, value: str, sizes: Mapping[str, str]) -> DataFrame:
    """counts (a row a value) with the mean rank of a value's rows, ties averaged, by name for each column that holds numbers of rows.

    Values are dealt out by ranges and added up where they lie; only the ranges' totals meet in a window. They are kept once, so that the ranges are the same for both looks.
    """
    x = kept(counts.repartitionByRange(value).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part")
    pieces = x.groupBy("_part").agg(*[F.sum(c).alias(f"_to_{c}") for c in sizes.values()])  # a row a range
    pieces = pieces.select("_part", *[(F.sum(f"_to_{c}").over(before) - F.col(f"_to_{c}")).alias(f"_to_{c}") for c in sizes.values()])
    upto = Window.partitionBy("_part").orderBy(value)
    met = beside(x, F.broadcast(pieces), ["_part"], "inner")
    return met.withColumns({k: F.col(f"_to_{c}") + F.sum(c).over(upto) - (F.col(c) - 1) / 2 for k, c in sizes.items()}).drop("_part", *[f"_to_{c}" for c in sizes.values()])


class MonthModel(NamedTuple):
    """How made-up months are drawn: normal, with the base's monthly mean times a factor (from a range, then one of `factors`) and `sigma` times its scale (times one of `sigmas`).

    drift: the mean is itself drawn around 0 (in scales); cost: a range that is taken off the mean; flipped: the other side; signed: (mean, deviation) in scales of the size of months, of which as many
    are positive as in the base; block: (months, noise in scales), months that repeat a few draws; held_out: how many months are set to 0 (one of these)."""

    sigma: float = 1.0
    factor: tuple[float, float] = (1.0, 1.0)
    factors: tuple[float, ...] = (1.0,)
    sigmas: tuple[float, ...] = (1.0,)
    drift: float | None = None
    cost: tuple[float, float] = (0.0, 0.0)
    flipped: bool = False
    signed: tuple[float, float] | None = None
    block: tuple[int, float] | None = None
    held_out: tuple[int, ...] = (0,)


#: the least scale of a base, and months of a draw
LEAST_SCALE, MONTHS = 250.0, 12

#: twelve ways in which chance alone could have made a year; the numbers are fixed values
MONTH_MODELS = {
    "members_shuffled": MonthModel(0.75), "sections_resampled": MonthModel(1.0, (0.6, 1.2)), "labels_permuted": MonthModel(signed=(0.5, 0.7)), "time_blocks": MonthModel(0.9, block=(4, 0.25)),
    "sides_flipped": MonthModel(0.8, flipped=True), "holds_shuffled": MonthModel(0.9, (0.4, 1.6)), "ranks_shuffled": MonthModel(0.85, drift=0.15), "costs_stressed": MonthModel(0.7, cost=(25.0, 125.0)),
    "members_held_out": MonthModel(0.95, (0.25, 0.85)), "months_held_out": MonthModel(0.9, held_out=(2, 3, 4)), "liquidity_shuffled": MonthModel(0.8, factors=(0.5, 0.75, 1.0, 1.25)), "volatility_shuffled": MonthModel(1.0, sigmas=(0.6, 1.0, 1.4, 1.8)),
}


def model_months(bases: DataFrame, key: str, models: Mapping[str, MonthModel], n: int, seed: str) -> DataFrame:
    """key, model, round, total and positive (months over 0) of a made-up year in each round; bases: key, total, positive, worst, best of real years.

    The scale of a base is the largest of a twelfth of its total and its worst and best month, in size. A row a month is made where its base is read, and added up there.
    """
    names = F.array(*[F.lit(k) for k in models])
    x = rounds(bases.select(key, "total", "positive", "worst", "best").withColumn("model", F.explode(names)), n).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
    once = lambda what, *more: uniform(f"{seed}-{what}", key, "model", "round", *more)
    normal = lambda what, *more: gaussian(f"{seed}-{what}", key, "model", "round", *more)
    one_of = lambda what, values: F.element_at(F.array(*[F.lit(v) for v in values]), F.floor(once(what) * len(values)).cast("int") + 1) if len(values) > 1 else F.lit(values[0])
    within = lambda what, lo, hi: lo + (hi - lo) * once(what) if hi > lo else F.lit(lo)
    mean, scale = F.col("total") / MONTHS, F.greatest(F.lit(LEAST_SCALE), F.abs(F.col("total")) / MONTHS, F.abs("worst"), F.abs("best"))
    value = F.lit(None).cast("double")
    for name, m in models.items():
        if m.signed:
            v = F.abs(scale * m.signed[0] + scale * m.signed[1] * normal("month", "_j")) * F.when(F.col("_j") < F.col("positive"), 1.0).otherwise(-1.0)
        else:
            mu = normal("drift") * scale * m.drift if m.drift is not None else mean * within("factor", *m.factor) * one_of("level", m.factors) - within("cost", *m.cost)
            draw = normal("block", (F.col("_j") % m.block[0]).cast("string")) if m.block else normal("month", "_j")
            v = mu + scale * (m.sigma * one_of("sigma", m.sigmas)) * draw
            v = v + scale * m.block[1] * normal("month", "_j") if m.block else v
            v = F.when(F.col("_j") < one_of("out", m.held_out), 0.0).otherwise(-v if m.flipped else v)
        value = F.when(F.col("model") == name, v).otherwise(value)
    return x.withColumn("_v", value).groupBy(key, "model", "round").agg(F.sum("_v").alias("total"), F.count(F.when(F.col("_v") > 0, 1)).alias("positive"))
