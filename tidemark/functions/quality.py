"""Data quality and governance as tables: gates, gaps, coverage, snapshots, staleness, rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.names import spare
from tidemark.operators.quantiles import beside
from tidemark.operators.shared import shared_folder


def gates(rows: DataFrame, checks: Mapping[str, tuple[Column, Column, str]]) -> DataFrame:
    """A row per check, name: (aggregate, whether its value passes, severity); with `state`: PASS, ATTENTION or CRITICAL over all of them. One aggregate over the rows.

    The second column is an expression over `value`.
    """
    one = rows.agg(*[agg.cast("double").alias(name) for name, (agg, _, _) in checks.items()])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(s).alias("severity"), F.col(name).alias("value")) for name, (_, _, s) in checks.items()])).alias("s")).select("s.*")
    passed = F.lit(None).cast("boolean")
    for name, (_, good, _) in checks.items():
        passed = F.when(F.col("name") == name, F.coalesce(good, F.lit(False))).otherwise(passed)
    long = long.withColumn("passed", passed)
    all_ = Window.partitionBy(F.lit(1))  # one row a check
    worst = F.max(F.when(~F.col("passed"), F.when(F.col("severity") == "critical", 2).otherwise(1)).otherwise(0)).over(all_)
    return long.withColumn("state", F.element_at(F.array(F.lit("PASS"), F.lit("ATTENTION"), F.lit("CRITICAL")), worst + 1))


def missing_intervals(panel: DataFrame, key: str, ts: str, step_s: int) -> DataFrame:
    """first, last, n and missing: how many steps between a key's first and last instant have no row."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    out = panel.groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(ts).alias("n"), F.min(us).alias("_a"), F.max(us).alias("_b"))
    return out.withColumn("missing", F.floor((F.col("_b") - F.col("_a")) / (step_s * 1_000_000)) + 1 - F.col("n")).drop("_a", "_b")


def coverage(panel: DataFrame, key: str, ts: str, value: str, gap_limits_s: Mapping[str, float], outlier_bps: float) -> DataFrame:
    """By key and month: rows, repeated instants, gaps over each limit and returns beyond the outlier bound."""
    w = Window.partitionBy(key).orderBy(ts)
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lag(ts).over(w).cast("timestamp"))) / 1e6
    ret = (F.col(value) / F.nullif(F.lag(value).over(w), F.lit(0.0)) - 1) * 10_000
    x = panel.withColumns({"_gap": gap, "_ret": ret, "month": F.date_trunc("month", ts)})
    return x.groupBy(key, "month").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("_gap") == 0, 1)).alias("repeated"), *[F.count(F.when(F.col("_gap") > s, 1)).alias(name) for name, s in gap_limits_s.items()], F.count(F.when(F.abs("_ret") >= outlier_bps, 1)).alias("outliers"))


def revalidated(panel: DataFrame, key: str, ts: str, tie: str, value: str, step_s: int) -> DataFrame:
    """By key: whether instants strictly increase in the order of `tie`, lie on the step, and values are decimals of two places at most; `valid` all together."""
    w = Window.partitionBy(key).orderBy(tie)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    x = panel.withColumn("_up", F.coalesce(F.col(ts) > F.lag(ts).over(w), F.lit(True))).withColumn("_on", F.pmod(us, F.lit(step_s * 1_000_000)) == 0).withColumn("_dec", F.abs(F.col(value) * 100 - F.round(F.col(value) * 100)) < 1e-6)
    out = x.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.bool_and("_up").alias("increasing"), F.bool_and("_on").alias("aligned"), F.bool_and("_dec").alias("decimal"))
    return out.withColumn("valid", F.col("increasing") & F.col("aligned") & F.col("decimal"))


def snapshot_diff(snapshots: DataFrame, key: str, order: Sequence[str], mode: str, ranks: Mapping[str, int], counts: Sequence[str]) -> DataFrame:
    """Each snapshot against the one before: rank_delta, <count>_delta, and `alert`: downgrade, upgrade, change (a count differs) or none (first: null)."""
    w = Window.partitionBy(key).orderBy(*order)
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])[F.col(mode)]
    out = snapshots.withColumn("_rank", rank).withColumn("rank_delta", F.col("_rank") - F.lag("_rank").over(w)).withColumns({f"{c}_delta": F.col(c) - F.lag(c).over(w) for c in counts})
    moved = F.lit(False)
    for c in counts:
        moved = moved | (F.col(f"{c}_delta") != 0)
    first = F.row_number().over(w) == 1
    return out.withColumn("alert", F.when(first, F.lit(None)).when(F.col("rank_delta") < 0, "downgrade").when(F.col("rank_delta") > 0, "upgrade").when(moved, "change").otherwise("none")).drop("_rank")


def stale(artifacts: DataFrame, needs: DataFrame, most_depth: int = 64) -> DataFrame:
    """artifact, direct (built before something it needs, or missing), stale (that, or something it needs is stale, however far) and depth, the order in which to rebuild.

    artifacts: artifact, built_at (null: missing); needs: artifact, needs. The edges are joined once for each level until nothing changes.
    """
    shared_folder(artifacts.sparkSession)
    built = artifacts.select(F.col("artifact").alias("needs"), F.col("built_at").alias("need_at"))
    edges = needs.join(built, "needs", "left").join(artifacts, "artifact")
    direct = edges.groupBy("artifact").agg(F.bool_or(F.coalesce(F.col("need_at") > F.col("built_at"), F.lit(True))).alias("_d"))
    state = artifacts.join(direct, "artifact", "left").select("artifact", (F.col("built_at").isNull() | F.coalesce("_d", F.lit(False))).alias("direct"))
    state = state.withColumn("stale", F.col("direct")).withColumn("depth", F.lit(0)).checkpoint()
    edges = needs.select("artifact", "needs").distinct().checkpoint()
    for _ in range(most_depth):
        up = edges.join(state.select(F.col("artifact").alias("needs"), F.col("stale").alias("_s"), F.col("depth").alias("_p")), "needs").groupBy("artifact").agg(F.bool_or("_s").alias("_s"), (F.max("_p") + 1).alias("_p"))
        now = state.join(up, "artifact", "left").select("artifact", "direct", (F.col("stale") | F.coalesce("_s", F.lit(False))).alias("stale"), F.greatest("depth", F.coalesce("_p", F.lit(0))).alias("depth")).checkpoint()
        if now.exceptAll(state).isEmpty():
            return now
        state = now
    raise ValueError(f"needs that are deeper than {most_depth}, or run in a circle")


def best_rows(rows: DataFrame, key: Sequence[str], stage: Column, order: Sequence[Column]) -> DataFrame:
    """One row a key with its `stage`: the first in order."""
    x = rows.withColumn("stage", stage)
    return x.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")


def sizing(fixed: str, fraction: str, equity: float, default: float) -> Column:
    """A notional: the fixed one if positive, else the fraction of equity if in (0, 1], else the default."""
    return F.coalesce(F.when(F.col(fixed) > 0, F.col(fixed)), F.when((F.col(fraction) > 0) & (F.col(fraction) <= 1), F.col(fraction) * equity), F.lit(float(default)))


def gross_ladder(rows: DataFrame, by: Sequence[str], sources: Sequence[tuple[str, Column]], last: tuple[str, Column], share: float = 0.5, least: int = 10) -> DataFrame:
    """rows with `gross_bps` and `basis`: for a whole group the first source that covers at least max(least, share) of its rows, else `last`; rows without a value go, and groups without any.

    Coverage is counted by group and met by a join of its own, so a large group is no task's work.
    """
    n, basis = spare(rows, "_n", "basis")
    flags = [F.count(c) >= F.greatest(F.lit(least), F.floor(F.count(F.lit(1)) * share)) for _, c in sources]
    chosen = F.coalesce(*[F.when(f, i) for i, f in enumerate(flags)], F.lit(len(sources)))
    x = beside(rows, rows.groupBy(*by).agg(chosen.alias(n)), by)
    names, values = [k for k, _ in (*sources, last)], [c for _, c in (*sources, last)]
    pick = lambda of: F.coalesce(*[F.when(F.col(n) == i, v) for i, v in enumerate(of)])
    return x.withColumns({"gross_bps": pick(values), basis: pick([F.lit(k) for k in names])}).where("gross_bps IS NOT NULL").drop(n)


def bps_quality(rows: DataFrame, by: Sequence[str], sources: Sequence[tuple[str, Column]], strong: float = 0.8, partial: float = 0.3, most: float = 0.5) -> DataFrame:
    """n, coverage_<source> (share of a group's rows that take their value from it, the first that has one), mean_bps, tier and main_source by group.

    Tiers: <first>_strong or <first>_partial where the first source covers that much, else <source>_estimated for the first other that covers `most`, else insufficient.
    """
    bps, source = derived_bps(sources)
    b, s = spare(rows, "_b", "_s")
    names = [k for k, _ in sources]
    shares = {f"coverage_{k}": F.count(F.when(F.col(s) == k, 1)) / F.count(F.lit(1)) for k in names}
    out = rows.withColumns({b: bps, s: source}).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[c.alias(k) for k, c in shares.items()], F.avg(b).alias("mean_bps"))
    first, rest = F.col(f"coverage_{names[0]}"), names[1:]
    tier, main = F.when(first >= strong, f"{names[0]}_strong").when(first >= partial, f"{names[0]}_partial"), F.when(first >= partial, names[0])
    for k in rest:
        tier, main = tier.when(F.col(f"coverage_{k}") >= most, f"{k}_estimated"), main.when(F.col(f"coverage_{k}") >= most, k)
    return out.withColumns({"tier": tier.otherwise("insufficient"), "main_source": main})


def derived_bps(sources: Sequence[tuple[str, Column]]) -> tuple[Column, Column]:
    """(bps, source): the first source that has a value, row by row."""
    return F.coalesce(*[c for _, c in sources]), F.coalesce(*[F.when(c.isNotNull(), name) for name, c in sources])


def config_diff(active: DataFrame, proposed: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key, field, was, now of every field that differs; keys of one side have null on the other."""
    long = lambda df, name: df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias(name)) for c in columns])).alias("s")).select(key, "s.*")
    both = long(active, "was").join(long(proposed, "now"), [key, "field"], "full")
    return both.where(~F.col("was").eqNullSafe(F.col("now")))


def leaves(rows: DataFrame, key: str, body: str) -> DataFrame:
    """key, path and value (JSON text) of every leaf of a JSON column, however deep: $.a.b[0]; an empty object or list is a leaf. A body that is null or no JSON has none."""
    kind = "array<struct<path:string,value:string>>"

    @F.arrow_udf(_parsed(kind))
    def flat(texts):
        import json

        import pyarrow as pa

        out = []
        for text in texts.to_pylist():
            try:
                todo = [("$", json.loads(text))] if text is not None else []
            except ValueError:
                todo = []
            found = []
            while todo:
                path, value = todo.pop()
                if value and isinstance(value, dict):
                    todo += [(f"{path}.{k}", v) for k, v in value.items()]
                elif value and isinstance(value, list):
                    todo += [(f"{path}[{i}]", v) for i, v in enumerate(value)]
                else:
                    found.append({"path": path, "value": json.dumps(value, ensure_ascii=False, separators=(",", ":"))})
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([("path", pa.string()), ("value", pa.string())])))

    return rows.select(key, F.explode(flat(F.col(body).cast("string"))).alias("_l")).select(key, "_l.*")


def _parsed(kind: str):
    from pyspark.sql import types as T

    return T._parse_datatype_string(kind)


def nested_diff(active: DataFrame, proposed: DataFrame, key: str, body: str) -> DataFrame:
    """key, path, kind (added, removed or changed), was and now of every leaf in which two nested configurations differ."""
    both = leaves(active, key, body).withColumnRenamed("value", "was").join(leaves(proposed, key, body).withColumnRenamed("value", "now"), [key, "path"], "full")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
    return both.where(~F.col("was").eqNullSafe(F.col("now"))).select(key, "path", kind.alias("kind"), "was", "now")


def stale_pending(pending: DataFrame, due: str, now: Column, grace_s: float, kinds: Sequence[tuple[float, str]] = ((1.0, "WARN"),)) -> DataFrame:
    """Pending rows that were due more than `grace_s` before now, with late_s and severity: the last kind whose multiple of the grace they are over."""
    late = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(due).cast("timestamp"))) / 1e6
    x = pending.withColumn("late_s", late).where(F.col("late_s") > grace_s)
    severity = F.coalesce(*[F.when(F.col("late_s") > grace_s * times, kind) for times, kind in sorted(kinds, reverse=True)], F.lit(kinds[0][1]))
    return x.withColumn("severity", severity)
