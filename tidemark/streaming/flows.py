"""Streaming forms of the panel operators: they take a streaming (or a static) DataFrame and return one.

Rows later than the watermark are left out by Spark, as in any event-time query. State is bounded by the watermark, or by one small
record a key in the folds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling_bars(rows: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "1 hour", order: str | None = None) -> DataFrame:
    """Open, high, low, close, sum and count by key and window; in append mode a bar comes once it is closed."""
    at = F.struct(ts, order) if order else F.col(ts)
    bars = rows.withWatermark(ts, late).groupBy(key, F.window(ts, width).alias("w")).agg(
        F.min_by(value, at).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, at).alias("close"),
        F.sum(value).alias("total"), F.count(value).alias("n"))
    return bars.select(key, F.col("w.start").alias("bar"), "open", "high", "low", "close", "total", "n")


def sliding_sums(rows: DataFrame, key: str, ts: str, value: str, width: str, slide: str, late: str = "1 hour") -> DataFrame:
    """Sum and count by key over overlapping windows."""
    return rows.withWatermark(ts, late).groupBy(key, F.window(ts, width, slide).alias("w")).agg(F.sum(value).alias("total"), F.count(value).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "n")


def cross_sections(bars: DataFrame, at: str, value: str, least: int, late: str = "1 hour") -> DataFrame:
    """Mean, spread and count of each instant with at least `least` members."""
    out = bars.withWatermark(at, late).groupBy(F.window(at, "1 second").alias("w")).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("members"))
    return out.where(F.col("members") >= least).select(F.col("w.start").alias("at"), "mean", "std", "members")


def first_seen(rows: DataFrame, ids: list[str], ts: str, late: str) -> DataFrame:
    """One row for each id within the watermark."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(ids)


def cooldown(rows: DataFrame, key: str, ts: str, tie: str, seconds: float) -> DataFrame:
    """Rows at least `seconds` after the last kept row of their key. A key's state is one instant; rows older than it that come later are not kept."""
    gap = int(seconds * 1e6)

    def keep(_, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        last = state.get[0] if state.exists else None
        batch = pd.concat(list(frames)).sort_values(["_us", tie], kind="stable")  # one trigger's rows of one key
        kept = []
        for i, t in enumerate(batch["_us"]):
            if last is None or t - last >= gap:
                last = int(t)
                kept.append(i)
        state.update((last,))
        yield batch.iloc[kept].drop(columns="_us")

    timed = rows.withColumn("_us", F.unix_micros(ts))
    return timed.groupBy(key).applyInPandasWithState(keep, rows.schema, "last long", "append", GroupStateTimeout.NoTimeout)


def positions(signals: DataFrame, key: str, ts: str, kind: str, late: str, wait_s: int) -> DataFrame:
    """Pending, open and closed positions by key: 'signal' makes one pending, 'fill' opens it, 'exit' closes it.

    A pending one that no fill follows within `wait_s` of event time is rejected by a timer. Yields key, state
    (pending, open, closed, rejected) and at (epoch microseconds of the cause). Signals while one is pending or open
    change nothing, nor do fills and exits that find nothing to act on.
    """
    moves = {("", "signal"): "pending", ("pending", "fill"): "open", ("open", "exit"): "closed"}
    wait = wait_s * 1_000_000

    def step(k, frames: Iterator, state: GroupState) -> Iterator:
        import pandas as pd

        now, since = state.get if state.exists else ("", 0)
        out = []
        if state.hasTimedOut:
            out.append(("rejected", since + wait))
            now = ""
        else:
            rows = pd.concat(list(frames))
            rank = {"exit": 0, "fill": 1, "signal": 2}
            for t, what in sorted(zip(rows["_us"], rows[kind]), key=lambda x: (x[0], rank.get(x[1], 3))):
                if now == "pending" and t - since > wait:
                    out.append(("rejected", since + wait))
                    now = ""
                to = moves.get((now, what))
                if to:
                    out.append((to, int(t)))
                    now, since = ("" if to == "closed" else to), int(t)
        if now:
            state.update((now, int(since)))
            if now == "pending":
                state.setTimeoutTimestamp(max((since + wait) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame({key: [k[0]] * len(out), "state": [s for s, _ in out], "at": [a for _, a in out]})

    timed = signals.withWatermark(ts, late).select(key, ts, kind, F.unix_micros(ts).alias("_us"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {dict(signals.dtypes)[key]}, state string, at long", "now string, since long", "append", GroupStateTimeout.EventTimeTimeout)


def closed_bars(candles: DataFrame, ts: str, confirm: str, width_s: int, now: str) -> DataFrame:
    """Candles that are over: confirmed by the source, and begun at least their width before the row was seen."""
    over = F.unix_micros(F.col(ts)) + width_s * 1_000_000 <= F.unix_micros(F.col(now))
    return candles.where(F.col(confirm).cast("string").isin("1", "true") & over)


def observed(rows: DataFrame, name: str, ts: str) -> DataFrame:
    """rows with a heartbeat: rows, the newest instant (newest_us: to the microsecond, which a progress report's text leaves out) and rows without a time, given to listeners with every micro-batch (or batch) under `name`."""
    return rows.observe(name, F.count(F.lit(1)).alias("n_rows"), F.max(ts).alias("newest"), F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("newest_us"), F.count(F.when(F.col(ts).isNull(), 1)).alias("without_time"))


def started(flow: DataFrame, path: str, checkpoint: str, every: str | None = None):
    """The flow's query into Parquet files: all that is there and then the end, or a micro-batch every so often. The checkpoint makes it resumable."""
    writer = flow.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
