"""Where the library's queries and their SQL are kept, and what both share.

Doubles that come out of sums are rounded on both sides: the order of a distributed sum is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import series

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: hourly bars of the events
BARS = "SELECT event_type, date_trunc('hour', ts) AS bar, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(value) AS total, count(value) AS n FROM events GROUP BY ALL"
#: revenue of a supplier by month
MONTHS = "SELECT l_suppkey, date_trunc('month', l_shipdate)::TIMESTAMP AS month, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue FROM lineitem GROUP BY ALL"
#: the two commonest event types, as l and r
TWO = "k AS (SELECT event_type, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type), l AS (SELECT events.* FROM events JOIN k USING (event_type) WHERE place = 1), r AS (SELECT events.* FROM events JOIN k USING (event_type) WHERE place = 2)"
#: round trips made of orders: sold or bought by the parity of the key
TRADES = """SELECT o_orderkey, o_custkey, o_orderdate, o_orderpriority, CASE WHEN o_orderkey % 2 = 0 THEN 'long' ELSE 'short' END AS side,
 (o_orderkey % 21 - 10) / 100.0::DOUBLE AS move FROM orders"""
PNL = f"SELECT *, 1000.0 * CASE WHEN side = 'short' THEN -(100.0 * (1 + move) / 100.0 - 1) ELSE 100.0 * (1 + move) / 100.0 - 1 END - 2.0 AS net FROM ({TRADES})"


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r(c: str | Column, name: str | None = None, places: int = 6) -> Column:
    return F.round(c, places).alias(name or c)


def near(c: str | Column, name: str | None = None, places: int = 6) -> Column:
    """A double rounded at its binary value times 10 ** places, halves away from zero and the sign kept, where F.round takes the shortest decimal text of it."""
    x, m = F.col(c) if isinstance(c, str) else c, 10.0**places
    scaled = F.abs(x) * m
    return F.when(scaled < 2.0**52, F.signum(x) * F.floor(scaled + 0.5) / m).otherwise(x).alias(name or c)


def bars(spark: SparkSession, d: str) -> DataFrame:
    return series.bars(t(spark, d, "events"), "event_type", "ts", "value", order="event_id").withColumn("bar", F.col("bar").cast("timestamp_ntz"))
