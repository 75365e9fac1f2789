"""Cross-sections (all rows of an instant), groups and their shares, bins and tails."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.names import spare
from tidemark.operators.quantiles import quantiles, with_quantiles


def section_stats(panel: DataFrame, at: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """members, mean, std, median and the quantiles of every instant: one row each."""
    return panel.groupBy(*at).agg(F.count(value).alias("members"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.percentile(value, 0.5).alias("median"),
                                  *[F.percentile(value, q).alias(name) for name, q in quantiles.items()])


def with_section(panel: DataFrame, at: Sequence[str], value: str) -> DataFrame:
    """panel with sec_mean, sec_std, sec_median of its instant and sec_z; aggregated, then joined back, so a large instant is never one window."""
    s = section_stats(panel, at, value, {}).select(*at, F.col("mean").alias("sec_mean"), F.col("std").alias("sec_std"), F.col("median").alias("sec_median"))
    return panel.join(s, list(at)).withColumn("sec_z", (F.col(value) - F.col("sec_mean")) / F.when(F.col("sec_std") > 0, F.col("sec_std")))


def breadth(panel: DataFrame, at: Sequence[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Share of an instant's rows for which each condition holds; a condition that is null does not hold."""
    return panel.groupBy(*at).agg(*[F.avg(F.when(c, 1.0).otherwise(0.0)).alias(name) for name, c in conditions.items()])


def two_level(panel: DataFrame, inner: Sequence[str], outer: Sequence[Column | str], value: str) -> DataFrame:
    """Means by `inner`, then n, sum and mean of these by `outer`: every inner group weighs the same."""
    first = panel.groupBy(*inner, *outer).agg(F.avg(value).alias("_m")).where("_m IS NOT NULL")
    names = [c if isinstance(c, str) else first.columns[len(inner) + i] for i, c in enumerate(outer)]
    return first.groupBy(*names).agg(F.count("_m").alias("n"), F.sum("_m").alias("total"), F.avg("_m").alias("mean"))


def profile(panel: DataFrame, by: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Mean and standard deviation of every column, as <column>_mean and <column>_std."""
    return panel.groupBy(*by).agg(*[x for c in columns for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))])


def two_stage_tail(panel: DataFrame, at: Sequence[str], liquidity: str, signal: str, tie: str, top: float, tail: float, confirm: Column) -> DataFrame:
    """The liquid top share of an instant, in it the top and bottom tail by signal, of these the rows that confirm: `side` long or short."""
    w = Window.partitionBy(*at)
    liquid = panel.where(F.col(liquidity).isNotNull() & F.col(signal).isNotNull())
    liquid = liquid.withColumn("_r", F.row_number().over(w.orderBy(F.desc(liquidity), tie))).withColumn("_n", F.count(F.lit(1)).over(w)).where(F.col("_r") <= F.ceil(F.col("_n") * top))
    k = F.floor(F.count(F.lit(1)).over(w) * tail)
    up, down = F.row_number().over(w.orderBy(F.desc(signal), tie)), F.row_number().over(w.orderBy(F.asc(signal), tie))
    out = liquid.withColumn("side", F.when(up <= k, "long").when(down <= k, "short")).where("side IS NOT NULL").drop("_r", "_n")
    return out.where(F.when(F.col("side") == "long", confirm).otherwise(~confirm))


def order_statistics(panel: DataFrame, at: Sequence[str], value: str, low: float, high: float, least: int) -> DataFrame:
    """panel with `low` and `high` of its instant, values at the places ceil(n low) and floor(n high) + 1 in order (never interpolated); null under `least` values."""
    s = panel.groupBy(*at).agg(F.sort_array(F.collect_list(F.col(value))).alias("_v")).withColumn("_n", F.size("_v"))
    pick = lambda i: F.when(F.col("_n") >= least, F.get("_v", F.least(i.cast("int"), F.col("_n") - 1)))
    s = s.select(*at, pick(F.ceil(F.col("_n") * low) - 1).alias("low"), pick(F.floor(F.col("_n") * high)).alias("high"))
    return panel.join(s, list(at))


def spread(panel: DataFrame, at: Sequence[str], side: str, ret: str, cost: float) -> DataFrame:
    """Mean of the long leg less that of the short leg: long_ret, short_ret, gross and net (of `cost` a leg); instants without both legs are left out."""
    out = panel.groupBy(*at).agg(F.avg(F.when(F.col(side) == "long", F.col(ret))).alias("long_ret"), F.avg(F.when(F.col(side) == "short", F.col(ret))).alias("short_ret"), F.count(ret).alias("n"))
    out = out.where("long_ret IS NOT NULL AND short_ret IS NOT NULL").withColumn("gross", F.col("long_ret") - F.col("short_ret"))
    return out.withColumn("net", F.col("gross") - 2 * cost)


def at_mode(rows: DataFrame, ts: str) -> DataFrame:
    """The rows of the commonest instant (the earliest of several)."""
    mode = rows.where(F.col(ts).isNotNull()).groupBy(ts).count().orderBy(F.desc("count"), ts).limit(1).select(ts)
    return rows.join(F.broadcast(mode), ts, "left_semi")


def excess(panel: DataFrame, key: str, ts: str, value: str, benchmark: str, name: str = "excess") -> DataFrame:
    """panel with the benchmark key's value at its instant (`bench`) and the distance from it."""
    b = panel.where(F.col(key) == benchmark).select(F.col(ts).alias("_t"), F.col(value).alias("bench"))
    return panel.join(b, F.col(ts) == F.col("_t"), "left").drop("_t").withColumn(name, F.col(value) - F.col("bench"))


def binned(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the right-closed bin a value lies in; null outside of all and for null."""
    if len(labels) != len(edges) - 1:
        raise ValueError("one label a bin")
    out = F.lit(None).cast("string")
    for a, b, label in reversed(list(zip(edges, edges[1:], labels, strict=False))):
        out = F.when((value > a) & (value <= b), label).otherwise(out)
    return out


def quantile_bins(panel: DataFrame, by: Sequence[str], value: str, k: int, name: str = "bin") -> DataFrame:
    """panel with the bin 1 to k of its group's interpolated quantiles (right-closed; the lowest value is in bin 1); null values have none."""
    (cuts,) = spare(panel, "_q")
    joined = with_quantiles(panel, by, value, [i / k for i in range(1, k)], cuts)
    return joined.withColumn(name, F.when(F.col(value).isNotNull(), F.size(F.filter(cuts, lambda q: q < F.col(value))) + 1)).drop(cuts)


def count_bins(panel: DataFrame, by: Sequence[str], value: str, tie: str, k: int, name: str = "bucket") -> DataFrame:
    """panel with the bucket floor(place * k / n) + 1 of a row's place from 0 in its group: buckets by count, not by value."""
    w = Window.partitionBy(*by)
    place = F.row_number().over(w.orderBy(F.col(value).asc_nulls_last(), tie)) - 1
    return panel.withColumn(name, F.when(F.col(value).isNotNull(), (F.floor(place * k / F.count(value).over(w)) + 1).cast("int")))


def signed_bins(panel: DataFrame, value: str, name: str = "bin") -> DataFrame:
    """A value as big_down, down, flat, up or big_up, in units of the median of all absolute values (0.25 and 1.5 of it)."""
    (unit,) = spare(panel, "_u")
    x = F.col(value) / F.nullif(F.col(unit)[0], F.lit(0.0))
    return with_quantiles(panel, [], F.abs(value), [0.5], unit).withColumn(name, F.when(x < -1.5, "big_down").when(x < -0.25, "down").when(x <= 0.25, "flat").when(x <= 1.5, "up").when(x > 1.5, "big_up")).drop(unit)


def over_quantile(rows: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """The rows at or over their group's interpolated quantile."""
    (cut,) = spare(rows, "_q")
    return with_quantiles(rows, by, value, [q], cut).where(F.col(value) >= F.col(cut)[0]).drop(cut)


def top_shares(rows: DataFrame, by: Sequence[str], member: str, value: str, k: int) -> DataFrame:
    """members, top_share, top<k>_share and hhi of each group's totals by member."""
    each = rows.groupBy(*by, member).agg(F.sum(value).alias("_v"))
    each = each.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_v"), member)))
    total = F.nullif(F.sum("_v"), F.lit(0.0))
    return each.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), (F.max("_v") / total).alias("top_share"), (F.sum(F.when(F.col("_r") <= k, F.col("_v"))) / total).alias(f"top{k}_share"),
                                 (F.sum(F.col("_v") * F.col("_v")) / (total * total)).alias("hhi"))


def partials(rows: DataFrame, by: Sequence[str], value: str, direction: str) -> DataFrame:
    """Mergeable sums: n, sum, sum_sq, dir_total and dir_match (values whose sign is that of `direction`)."""
    v, s = F.col(value), F.signum(F.col(direction))
    return rows.groupBy(*by).agg(F.count(v).alias("n"), F.sum(v).alias("sum"), F.sum(v * v).alias("sum_sq"), F.count(F.when((s != 0) & v.isNotNull(), 1)).alias("dir_total"), F.count(F.when((s != 0) & (F.signum(v) == s), 1)).alias("dir_match"))


def merged(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """n, mean, std (of a population) and match_rate from partial sums, whatever groups they were taken in."""
    out = parts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", "sum", "sum_sq", "dir_total", "dir_match")])
    mean = F.col("sum") / F.nullif(F.col("n"), F.lit(0))
    out = out.withColumn("mean", mean).withColumn("std", F.sqrt(F.greatest(F.col("sum_sq") / F.nullif(F.col("n"), F.lit(0)) - F.col("mean") * F.col("mean"), F.lit(0.0))))
    return out.withColumn("match_rate", F.col("dir_match") / F.nullif(F.col("dir_total"), F.lit(0)))


def stability(rows: DataFrame, by: Sequence[str], sub: str, value: str, least: int) -> DataFrame:
    """Share of a group's sub-groups of at least `least` values whose mean has the sign of the group's mean; `groups` counts them."""
    parts = rows.groupBy(*by, sub).agg(F.count(value).alias("_n"), F.sum(value).alias("_s"))
    all_ = parts.groupBy(*by).agg((F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean"))
    same = F.avg((F.signum("_s") == F.signum("mean")).cast("double"))
    return parts.where(F.col("_n") >= least).join(all_, list(by)).groupBy(*by).agg(F.first("mean").alias("mean"), F.count(F.lit(1)).alias("groups"), same.alias("stability"))


def beta(rows: DataFrame, by: Sequence[str], y: str, x: str, least: int) -> DataFrame:
    """n, beta (covariance over variance of a population) and corr; 1 and 0 where a group has under `least` rows or x has no spread."""
    whole = F.col(y).isNotNull() & F.col(x).isNotNull()
    out = rows.where(whole).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.covar_pop(y, x).alias("_c"), F.var_pop(x).alias("_x"), F.var_pop(y).alias("_y"))
    good = (F.col("n") >= least) & (F.col("_x") > 1e-12)
    return out.withColumn("beta", F.when(good, F.col("_c") / F.col("_x")).otherwise(1.0)).withColumn("corr", F.when(good & (F.col("_y") > 1e-12), F.col("_c") / F.sqrt(F.col("_x") * F.col("_y"))).otherwise(0.0)).drop("_c", "_x", "_y")


def contrast(rows: DataFrame, good: Column, features: Sequence[str]) -> DataFrame:
    """feature, n_good, n_bad and the differences (good less bad) of mean, median, 10 % and 90 % quantile: long form, one pass over the rows."""
    long = rows.withColumn("_g", good).select("_g", F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in features])).alias("f")).select("_g", "f.*")
    side = lambda on, v: F.when(F.col("_g") if on else ~F.col("_g"), v)
    v, qs = F.col("v"), (0.5, 0.1, 0.9)
    means = long.groupBy("feature").agg(F.count(side(True, v)).alias("n_good"), F.count(side(False, v)).alias("n_bad"), (F.avg(side(True, v)) - F.avg(side(False, v))).alias("mean_diff"))
    sides = quantiles(long.where("_g IS NOT NULL"), ["feature", "_g"], "v", qs)  # a row a feature and side
    of = lambda i: F.max(side(True, F.col("q")[i])) - F.max(side(False, F.col("q")[i]))
    return means.join(sides.groupBy("feature").agg(*[of(i).alias(f"p{int(q * 100)}_diff") for i, q in enumerate(qs)]), "feature", "left")


def argmax(columns: Sequence[str]) -> Column:
    """Name of the column with the largest value (the first of several); null where all are null."""
    best = F.greatest(*columns)
    return F.coalesce(*[F.when(F.col(c) == best, c) for c in columns])


def audit(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row per numeric column: n, missing (null or NaN), infinite, finite min, max, mean and 99.9 % quantile."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    v = F.col("v")
    missing, inf = v.isNull() | F.isnan(v), F.abs(v) == float("inf")
    fine = F.when(~missing & ~inf, v)
    out = long.groupBy("column").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(missing, 1)).alias("missing"), F.count(F.when(inf, 1)).alias("infinite"), F.min(fine).alias("least"), F.max(fine).alias("most"), F.avg(fine).alias("mean"))
    return out.join(quantiles(long, ["column"], fine, [0.999]).select("column", F.col("q")[0].alias("p999")), "column", "left")


def sampled_quantiles(rows: DataFrame, by: Sequence[str], value: str, h: Column, size: int, quantiles: Mapping[str, float], groups: int = 64) -> DataFrame:
    """Quantiles of a seeded sample of at most `size` values of each group (those with the smallest hashes), with n (all) and sampled.

    Narrowed in `groups` parts of a group first, so that no group is ever ranked whole.
    """
    x = rows.where(F.col(value).isNotNull()).withColumn("_h", h).withColumn("_part", F.pmod(F.xxhash64("_h"), F.lit(groups)))
    n = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_part").orderBy("_h"))).where(F.col("_r") <= size)
    x = x.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_r") <= size)
    return x.groupBy(*by).agg(F.count(F.lit(1)).alias("sampled"), *[F.percentile(value, q).alias(name) for name, q in quantiles.items()]).join(n, list(by))


def set_turnover(rows: DataFrame, at: str, member: str) -> DataFrame:
    """Share of the members of an instant or of the one before that are not in both; the first instant has none."""
    sets = rows.groupBy(at).agg(F.sort_array(F.collect_set(member)).alias("members"))
    before = F.lag("members").over(Window.orderBy(at))  # one row an instant
    out = sets.withColumn("_b", before).where("_b IS NOT NULL")
    return out.select(at, F.size("members").alias("n"), (1 - F.size(F.array_intersect("members", "_b")) / F.size(F.array_union("members", "_b"))).alias("turnover"))
