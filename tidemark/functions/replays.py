"""Replays under a null: resampled groups, state panels whose time is shuffled, draws from control strategies.

Draws are hashes of seed, round and place, so that a rerun on any cluster gives the same. What is drawn is a small row (a place, a
block, a slot) that meets its value in a hash join; values are never collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.nulls import gaussian, rounds, uniform
from tidemark.functions.stats import seeded
from tidemark.operators.quantiles import numbered


def replays(rows: DataFrame, by: Sequence[str], order: Sequence[str], value: str, n: int, size: int, seed: str, held: float = 0.25, costs: tuple[float, float] = (5.0, 35.0), large: float = 0.7) -> DataFrame:
    """by, round, method and score of twelve ways to replay each group: a location of a resample, times the root of its number.

    A resample has as many rows as its group, `size` (25 at least) at most. rows, labels and entries: means of three independent
    resamples; medians, quarters (one of the quartiles) and signs (signs drawn) of the first; members_out: less a share `held` of its rows;
    groups_out: 0 for that share of groups; block: consecutive rows; costs: less a drawn cost; large: the rows far from 0; flipped: the other
    side. Rows with a null value or a null in `by` take no part.
    """
    x = rows.where(F.col(value).isNotNull())
    for c in by:
        x = x.where(F.col(c).isNotNull())
    x = numbered(x, by, order).select(*by, "_i", "_n", F.col(value).cast("double").alias("_v"))
    groups = x.groupBy(*by).agg(F.max("_n").alias("_n")).withColumn("_m", F.least(F.lit(max(25, size)), F.col("_n")))
    groups = groups.withColumn("_len", F.greatest(F.lit(10), F.least(F.lit(100), F.floor(F.col("_m") / 4))))
    u = lambda name, *parts: uniform(f"{seed}-{name}", "round", *by, *parts)
    draws = rounds(groups, n).withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)))
    first = F.floor(u("block") * (F.col("_n") - F.col("_len")))
    in_block = (F.col("_j") < F.col("_len")) & (F.col("_n") > F.col("_len"))
    kinds = [F.struct(F.lit(k).alias("k"), F.floor(u(k, "_j") * F.col("_n")).alias("_i")) for k in ("rows", "labels", "entries")]
    kinds.append(F.when(in_block, F.struct(F.lit("block").alias("k"), (first + F.col("_j")).alias("_i"))))
    draws = draws.select(*by, "round", "_m", "_j", F.explode(F.filter(F.array(*kinds), lambda d: d.isNotNull())).alias("d")).select(*by, "round", "_m", "_j", "d.k", "d._i")
    got = draws.join(x.drop("_n"), [*by, "_i"])
    far = F.percentile(F.when(F.col("k") == "rows", F.abs("_v")), large).over(Window.partitionBy(*by, "round"))  # one resample's rows
    got = got.withColumn("_far", F.abs("_v") >= far * (1 - 1e-12))
    of = lambda k, also=F.lit(True): F.when((F.col("k") == k) & also, F.col("_v"))
    scaled = lambda v: F.avg(v) * F.sqrt(F.count(v))
    mine, kept = of("rows"), of("rows", u("member", "_j") > held)
    quarters = F.percentile(mine, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    s = got.groupBy(*by, "round").agg(
        scaled(mine).alias("rows"), scaled(of("labels")).alias("labels"), scaled(of("entries")).alias("entries"), scaled(of("block")).alias("block"),
        scaled(kept).alias("members_out"), scaled(of("rows", F.col("_far"))).alias("large"), quarters.alias("_q"), F.sqrt(F.count(mine)).alias("_root"),
        scaled(mine * F.when(u("sign", "_j") < 0.5, -1.0).otherwise(1.0)).alias("signs"))
    low, high = costs
    found = {
        "rows": F.col("rows"), "labels": F.col("labels"), "entries": F.col("entries"), "signs": F.col("signs"), "large": F.col("large"), "flipped": -F.col("rows"),
        "medians": F.col("_q")[1] * F.col("_root"), "quarters": F.element_at("_q", F.floor(u("quarter") * 3).cast("int") + 1) * F.col("_root"),
        "members_out": F.coalesce("members_out", "rows"), "block": F.coalesce("block", "rows"),
        "groups_out": F.when(u("group") < held, 0.0).otherwise(F.col("rows")), "costs": F.col("rows") - (low + (high - low) * u("cost")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("method"), v.alias("score")) for k, v in found.items()])
    return s.select(*by, "round", F.explode(each).alias("s")).select(*by, "round", "s.method", "s.score")


#: steps between the terciles 0, 1, 2 of a state; staying in the middle one is none
STEPS = [(a, b) for a in range(3) for b in range(3) if (a, b) != (1, 1)]


class Strict(NamedTuple):
    """When a transition axis counts: in so many periods its score reaches `score`, and `total` over all."""

    score: float
    total: float
    periods: int


def transition_axes(cells: DataFrame, by: Sequence[str], periods: Sequence, strict: Strict) -> DataFrame:
    """by, state, step, active, strict_periods, total and strict of each step of each state; cells: by, state, at, period, bucket.

    A period's score is how far the step's rate there lies from its rate over all, in thirds of standard errors, 4 at most.
    """
    w = Window.partitionBy(*by, "state").orderBy("at")
    c = cells.withColumn("_p", F.lag("bucket").over(w)).where("_p IS NOT NULL").groupBy(*by, "state", "period", "_p", "bucket").agg(F.count(F.lit(1)).alias("_c"))
    # from here on a row for each period and step
    key = [*by, "state"]
    step = F.concat(F.col("_p").cast("string"), F.lit(">"), F.col("bucket").cast("string"))
    c = c.select(*key, "period", step.alias("step"), "_c")
    all_ = c.groupBy(*key).agg(F.sum("_c").alias("_all"))
    grid = all_.withColumn("step", F.explode(F.array(*[F.lit(f"{a}>{b}") for a, b in STEPS]))).withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    grid = grid.join(c.groupBy(*key, "step").agg(F.sum("_c").alias("_s")), [*key, "step"], "left")
    grid = grid.join(c.groupBy(*key, "period").agg(F.sum("_c").alias("_t")), [*key, "period"], "left").join(c, [*key, "period", "step"], "left")
    base = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.coalesce("_s", F.lit(0)) / F.col("_all")))
    rate = F.coalesce(F.col("_c") / F.col("_t"), F.lit(0.0))
    error = F.greatest(F.sqrt(base * (1 - base) / F.greatest(F.coalesce("_t", F.lit(0)), F.lit(1))), F.lit(1e-6))
    grid = grid.withColumn("_score", F.round(F.least(F.lit(4.0), F.abs(rate - base) / error / 3), 9))
    out = grid.groupBy(*key, "step").agg(F.count("_t").alias("active"), F.count(F.when(F.col("_score") >= strict.score, 1)).alias("strict_periods"), F.round(F.sum("_score"), 6).alias("total"))
    return out.withColumn("strict", (F.col("active") >= strict.periods) & (F.col("strict_periods") >= strict.periods) & (F.col("total") >= strict.total))


def joint_null(panel: DataFrame, ts: str, period: str, states: Sequence[str], periods: Sequence, n: int, block: int, seed: str, strict: Strict, least: int = 100) -> DataFrame:
    """model, rounds, observed_axes, observed_best, p_count, p_best and p_joint: the transition axes of shuffled panels against those of the panel.

    Models: periods change names; blocks of rows change places, for all states together or for each alone; rows change places within
    their period. A panel has one row an instant, so that one round of a state is one task's sort. A state with fewer than `least` values is left
    out; null values are no cells, and rows outside `periods` keep their places where those are shuffled.
    """
    pos = numbered(panel, [], [ts]).select("_i", F.col(period).alias("period"), *states)
    cells = pos.select("_i", F.explode(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).cast("double").alias("v")) for s in states])).alias("c")).select("_i", "c.*").where("v IS NOT NULL AND NOT isnan(v)")
    cuts = cells.groupBy("state").agg(F.round(F.percentile("v", 0.33), 9).alias("_a"), F.round(F.percentile("v", 0.67), 9).alias("_b"), F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= least)
    cells = cells.join(F.broadcast(cuts), "state").select("_i", "state", F.when(F.col("v") <= F.col("_a"), 0).when(F.col("v") >= F.col("_b"), 2).otherwise(1).alias("bucket"))  # a row a state
    places = pos.select("_i", "period")
    spark = panel.sparkSession
    known = spark.createDataFrame([(p,) for p in periods], places.select("period").schema)

    def ranked(name: str, over: list[str], by: str) -> Column:
        return F.row_number().over(Window.partitionBy("round", *over).orderBy(seeded(f"{seed}-{name}", "round", *over, by), by))

    names = rounds(known, n).withColumn("_k", F.row_number().over(Window.partitionBy("round").orderBy("period"))).withColumn("_r", ranked("periods", [], "period"))
    names = names.select("round", "period", "_k").join(names.select("round", F.col("period").alias("_name"), F.col("_r").alias("_k")), ["round", "_k"]).drop("_k")
    renamed = rounds(places, n).join(F.broadcast(names), ["round", "period"], "left").select("round", "_i", F.col("_i").alias("at"), F.coalesce("_name", "period").alias("period"))  # rounds x periods given

    def moved(blocks: DataFrame, over: list[str], name: str) -> DataFrame:
        b = rounds(blocks, n)
        w = Window.partitionBy("round", *over).orderBy(seeded(f"{seed}-{name}", "round", *over, "_b"), "_b")
        b = b.withColumn("_start", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_len"))
        x = places.select("_i", F.floor(F.col("_i") / block).alias("_b")).join(b, "_b").select("round", *over, "_i", (F.col("_start") + F.col("_i") % block).alias("at"))
        return x.join(places.select(F.col("_i").alias("at"), "period"), "at").select("round", *over, "_i", "at", "period")

    blocks = places.groupBy(F.floor(F.col("_i") / block).alias("_b")).agg(F.count(F.lit(1)).alias("_len"))
    alone = moved(blocks.crossJoin(F.broadcast(cuts.select("state"))), ["state"], "alone")  # blocks x states
    inside = places.join(F.broadcast(known), "period")
    seats = inside.withColumn("_k", F.row_number().over(Window.partitionBy("period").orderBy("_i")))
    drawn = rounds(inside, n).withColumn("_k", ranked("within", ["period"], "_i"))
    within = drawn.select("round", "period", "_i", "_k").join(seats.select("period", F.col("_i").alias("at"), "_k"), ["period", "_k"]).select("round", "_i", "at", "period")
    outside = rounds(places.join(F.broadcast(known), "period", "left_anti"), n).select("round", "_i", F.col("_i").alias("at"), "period")
    together = {"observed": places.select(F.lit(0).alias("round"), "_i", F.col("_i").alias("at"), "period"), "periods": renamed, "blocks": moved(blocks, [], "blocks"), "within": within.unionByName(outside)}
    shared = None
    for model, x in together.items():
        x = x.select(F.lit(model).alias("model"), "round", "_i", "at", "period")
        shared = x if shared is None else shared.unionByName(x)
    kept = ["model", "round", "state", "at", "period", "bucket"]
    all_ = cells.join(shared, "_i").select(*kept).unionByName(cells.join(alone.withColumn("model", F.lit("alone")), ["_i", "state"]).select(*kept))
    axes = transition_axes(all_, ["model", "round"], periods, strict)
    runs = axes.groupBy("model", "round").agg(F.count(F.when(F.col("strict"), 1)).alias("axes"), F.max("total").alias("best"))
    every = Window.partitionBy(F.lit(1))  # a row a model and round
    seen = lambda c: F.max(F.when(F.col("model") == "observed", F.col(c))).over(every).alias("observed_" + c)
    runs = runs.select("*", seen("axes"), seen("best")).where("model <> 'observed'")
    more, better = F.col("axes") >= F.col("observed_axes"), F.col("best") >= F.col("observed_best")
    share = lambda c: F.avg(c.cast("int"))
    return runs.groupBy("model", "observed_axes", "observed_best").agg(F.count(F.lit(1)).alias("rounds"), share(more).alias("p_count"), share(better).alias("p_best"), share(more & better).alias("p_joint"))


class Mode(NamedTuple):
    """How a drawn control is changed: total times a draw from `scale`, plus normal noise of `noise` (share of the total, least), less a drawn cost a
    hundred events; good periods by one of `steps`, drawn anew at their own rate (`redrawn`), or exchanged for the others, with the total's sign (`flipped`)."""

    scale: tuple[float, float] = (1.0, 1.0)
    noise: tuple[float, float] = (0.0, 0.0)
    steps: tuple[int, ...] = (0,)
    cost: float = 0.0
    redrawn: bool = False
    flipped: bool = False


def control_baseline(candidates: DataFrame, controls: DataFrame, modes: Mapping[str, Mode], n: int, seed: str, order: Sequence[str], periods: int = 12, need: int = 12) -> DataFrame:
    """How often chance alone finds what the candidates are said to show: mode, rounds, rates of any strict or adjusted hit, tails of the best total, p values, risk.

    Both tables hold total, positive and active (periods) and events; without controls the candidates are their own. In each round and mode as
    many controls are drawn as there are candidates, and changed as the mode says. Strict: `need` periods active and good, and a total above 0;
    adjusted: above the controls' 95th percentile and best, too. No candidates: no draws, no rows.
    """
    pick = ["total", "positive", "active", "events"]
    strict = (F.col("active") >= need) & (F.col("positive") >= need) & (F.col("total") > 0)
    pool = controls if not controls.isEmpty() else candidates
    pool = numbered(pool.where(F.col("total").isNotNull()), [], order).select("_i", "_n", *pick)  # a row a strategy
    bounds = pool.agg(F.percentile("total", 0.95).alias("_p95"), F.max("total").alias("_top"), F.count(F.lit(1)).alias("_n"))
    over = (F.col("total") > F.col("_p95")) & (F.col("total") > F.col("_top"))
    real = candidates.crossJoin(F.broadcast(bounds)).agg(  # one row
        F.count(F.lit(1)).alias("_slots"), F.max("total").alias("_best"), F.count(F.when(strict, 1)).alias("_strict"), F.count(F.when(strict & over, 1)).alias("_adjusted"))
    base = F.broadcast(bounds.crossJoin(real))  # one row
    names = F.array(*[F.lit(m) for m in modes])
    slots = rounds(base.where("_slots > 0 AND _n > 0"), n).withColumn("mode", F.explode(names)).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_slots") - 1)))
    u = lambda name, *parts: uniform(f"{seed}-{name}", "mode", "round", "slot", *parts)
    x = slots.withColumn("_i", F.floor(u("pick") * F.col("_n"))).drop("_n").join(pool.drop("_n"), "_i")
    redrawn = sum((F.when(u("good", F.lit(str(k))) < F.col("positive") / periods, 1).otherwise(0) for k in range(periods)), F.lit(0))
    total, positive = F.col("total"), F.col("positive")
    for name, m in modes.items():
        mine = F.col("mode") == name
        t = F.col("total") * (-1.0 if m.flipped else 1.0) * (m.scale[0] + (m.scale[1] - m.scale[0]) * u("scale"))
        if m.noise != (0.0, 0.0):
            t = t + gaussian(f"{seed}-noise", "mode", "round", "slot") * F.greatest(F.abs("total") * m.noise[0], F.lit(m.noise[1]))
        t = t - m.cost * u("cost") * F.greatest(F.lit(1.0), F.col("events") / 100)
        g = redrawn if m.redrawn else (periods - F.col("positive") if m.flipped else F.col("positive"))
        g = F.greatest(F.lit(0), F.least(F.lit(periods), g + F.element_at(F.array(*[F.lit(k) for k in m.steps]), F.floor(u("step") * len(m.steps)).cast("int") + 1)))
        total, positive = F.when(mine, t).otherwise(total), F.when(mine, g).otherwise(positive)
    x = x.withColumns({"total": total, "positive": positive})
    fixed = ["_best", "_strict", "_adjusted"]
    runs = x.groupBy("mode", "round", *fixed).agg(F.count(F.when(strict, 1)).alias("_s"), F.count(F.when(strict & over, 1)).alias("_a"), F.max("total").alias("_t"))
    p = lambda hit: (1 + F.count(F.when(hit, 1))) / (1 + F.count(F.lit(1)))
    tails = [F.percentile("_t", q).alias(f"p{round(100 * q)}_best") for q in (0.5, 0.9, 0.95, 0.99)]
    out = runs.groupBy("mode").agg(
        F.count(F.lit(1)).alias("rounds"), F.avg((F.col("_s") > 0).cast("int")).alias("any_strict"), F.avg((F.col("_a") > 0).cast("int")).alias("any_adjusted"), F.avg("_s").alias("mean_strict"), *tails,
        p(F.col("_t") >= F.col("_best")).alias("p_best"), p(F.col("_s") >= F.col("_strict")).alias("p_strict"), p(F.col("_a") >= F.col("_adjusted")).alias("p_adjusted"))
    high, some = (F.col("any_adjusted") > 0.1) | (F.col("any_strict") > 0.25), (F.col("any_adjusted") > 0.02) | (F.col("any_strict") > 0.05)
    return out.withColumn("risk", F.when(high, "HIGH").when(some, "MODERATE").otherwise("LOW"))
