"""Operators over the order of a key's rows: exponential averages, walk-forward folds, sequences of states."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import carried
from tidemark.operators.names import spare
from tidemark.operators.quantiles import numbered


def ema(panel: DataFrame, key: str, order: Sequence[str], value: str, alpha: float, name: str = "ema", seed: int = 1) -> DataFrame:
    """Exponential average begun with the mean of a key's first `seed` values (null before them); rows without a value carry it on.

    A recursion, so a fold over each key's sorted rows that carries two numbers.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")

    def step(state, x):
        n, now = state
        if x is not None:
            n += 1
            now = now + x if n <= seed else x * alpha + now * (1 - alpha)
            if n == seed:
                now /= seed
        return (n, now), (now if n >= seed else None,)

    (x,) = spare(panel, "_x")
    return carried(panel.withColumn(x, F.col(value).cast("double")), [key], list(order), [x], f"{name} double", lambda: (0, 0.0), step).drop(x)


def true_range(key: str, order: Sequence[str], high: str, low: str, close: str) -> Column:
    """The largest of high - low and the distances from the close before."""
    before = F.lag(close).over(Window.partitionBy(key).orderBy(*order))
    return F.greatest(F.col(high) - F.col(low), F.abs(F.col(high) - before), F.abs(F.col(low) - before))


def wilder_range(panel: DataFrame, key: str, order: Sequence[str], high: str, low: str, close: str, n: int, name: str = "atr") -> DataFrame:
    """Average true range: the mean of the first n, then the exponential average with weight 1/n."""
    (span,) = spare(panel, "_span")
    return ema(panel.withColumn(span, true_range(key, order, high, low, close)), key, order, span, 1 / n, name, n).drop(span)


def walk_forward(rows: DataFrame, ts: str, start: Column, step_days: int, train_steps: int, folds: int) -> DataFrame:
    """Each row with fold and part: a step of time is the test part of one fold and the train part of the `train_steps` folds after it.

    Fold 0 tests the step after the first `train_steps` steps; rows before the start or of no fold are left out.
    """
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / (step_days * 86_400_000_000))
    (step,) = spare(rows, "_step")
    out = rows.withColumn(step, at).where(F.col(step) >= 0)
    out = out.withColumn("fold", F.explode(F.sequence(F.col(step) - train_steps, F.col(step))))
    return out.where((F.col("fold") >= 0) & (F.col("fold") < folds)).withColumn("part", F.when(F.col("fold") + train_steps == F.col(step), "test").otherwise("train")).drop(step)


def rolling_windows(rows: DataFrame, ts: str, start: Column, days: Sequence[int], names: Sequence[str], step_days: int, folds: int) -> DataFrame:
    """Each row with the folds it is of and its part in each: fold f begins f * step_days after the start and has windows of `days` days, half-open, one after the other, called `names`.

    (180, 90, 90) with a step of 90 are discovery, validation and test windows that roll on by a test window. Rows of no fold are left out.
    """
    if len(days) != len(names) or not all(d > 0 for d in days) or step_days <= 0:
        raise ValueError("one name a window, and windows and step over 0 days")
    (at,) = spare(rows, "_at")
    day = 86_400_000_000
    out = rows.withColumn(at, F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(start.cast("timestamp"))).where(F.col(at) >= 0)
    first = F.greatest(F.lit(0), F.floor((F.col(at) - sum(days) * day) / (step_days * day)) + 1)
    last = F.least(F.lit(folds - 1), F.floor(F.col(at) / (step_days * day)))
    out = out.where(first <= last).withColumn("fold", F.explode(F.sequence(first, last)))
    off = F.col(at) - F.col("fold") * (step_days * day)
    ends = [sum(days[: i + 1]) * day for i in range(len(days))]
    part = F.coalesce(*[F.when(off < e, n) for e, n in zip(ends, names, strict=True)])
    return out.withColumn("part", part).drop(at)


def quantile_folds(rows: DataFrame, order: Sequence[str], folds: int) -> DataFrame:
    """Each row with the folds it is of and its part in each, by its place in order: the rows are cut into `folds` runs of equal number (the last takes what is left); run f
    is the test part of fold f, and all runs before it its train part. The first run only trains. No rows where there are fewer than two for each fold."""
    x = numbered(rows, [], order)
    run = F.least(F.floor(F.col("_i") / F.floor(F.col("_n") / folds)), F.lit(folds - 1))
    out = x.where(F.col("_n") >= 2 * folds).withColumn("_run", run).withColumn("fold", F.explode(F.sequence(F.greatest("_run", F.lit(1)), F.lit(folds - 1))))
    return out.withColumn("part", F.when(F.col("fold") == F.col("_run"), "test").otherwise("train")).drop("_i", "_n", "_run")


def motifs(rows: DataFrame, key: str, order: Sequence[str], state: str, length: int) -> DataFrame:
    """motif (states in order, joined by >), n and n_keys of all runs of `length` consecutive rows of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    parts = [F.lag(state, length - 1 - i).over(w) for i in range(length)]
    out = rows.select(key, *[p.alias(f"_s{i}") for i, p in enumerate(parts)]).dropna(subset=[f"_s{i}" for i in range(length)])
    return out.groupBy(F.concat_ws(">", *[f"_s{i}" for i in range(length)]).alias("motif")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("n_keys"))
