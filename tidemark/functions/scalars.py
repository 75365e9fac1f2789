"""Scalar expressions: guarded arithmetic, parsing, keys, bars' geometry, classes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(a: Column, b: Column) -> Column:
    """a / b; null where b is 0 or either is not finite."""
    fine = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    return fine(a.cast("double")) / F.nullif(fine(b.cast("double")), F.lit(0.0))


def bps(a: Column, b: Column, places: int = 6) -> Column:
    """Change from b to a in basis points, half to even."""
    return F.bround((safe_div(a, b) - 1) * 10_000, places)


def sign_of(x: Column, tolerance: float = 0.0) -> Column:
    return F.when(x > tolerance, 1).when(x < -tolerance, -1).when(x.isNotNull(), 0)


def parsed_bool(text: Column) -> Column:
    """true and false in their common spellings; null for anything else."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("1", "true", "yes", "y", "t"), True).when(t.isin("0", "false", "no", "n", "f"), False)


def parsed_number(text: Column) -> Column:
    """A finite number, without its thousands separators; null for anything else."""
    x = F.regexp_replace(F.trim(text), ",", "").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def seed_of(*parts: Column) -> Column:
    """A non-negative long from the first 15 hex digits of the sha256 of the parts, joined by bars."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 15), 16, 10).cast("long")


def dotted(json: str, path: str) -> Column:
    """A value at a dotted path of a JSON text; null where a step is missing."""
    return F.get_json_object(json, "$." + path)


def candle(open_: str = "open", high: str = "high", low: str = "low", close: str = "close") -> dict[str, Column]:
    """Shares of a bar's range: upper and lower wick, body, and where it closed; null for a bar without range."""
    o, h, l, c = (F.col(x) for x in (open_, high, low, close))
    span = F.nullif(h - l, F.lit(0.0))
    return {"upper_wick": (h - F.greatest(o, c)) / span, "lower_wick": (F.least(o, c) - l) / span, "body": F.abs(c - o) / span, "close_at": (c - l) / span}


def month_add(month: Column, n: int) -> Column:
    """yyyy-MM, n months on."""
    return F.date_format(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), n), "yyyy-MM")


def epoch_ms(instant: Column) -> Column:
    """Milliseconds since 1970, to the nearest."""
    return F.floor((F.unix_micros(instant.cast("timestamp")) + 500) / 1000).cast("long")


def book_geometry(bid_depth: str, ask_depth: str, bid_notional: str, ask_notional: str) -> dict[str, Column]:
    """What two sides of an order book say: average prices (notional over depth), mid, spread, spread_bps, imbalance and microprice (each side's price weighed by the other's depth).

    Null without what it is made of; a depth or a sum of depths that is not positive makes no price, imbalance or microprice, and a mid of 0 no spread_bps.
    """
    over = lambda a, b: a / F.when(b > 0, b)
    bd, ad = F.col(bid_depth), F.col(ask_depth)
    bid, ask = over(F.col(bid_notional), bd), over(F.col(ask_notional), ad)
    mid = (bid + ask) / 2
    return {"bid_price": bid, "ask_price": ask, "total_depth": bd + ad, "mid": mid, "spread": ask - bid, "spread_bps": (ask - bid) / F.nullif(mid, F.lit(0.0)) * 10_000,
            "imbalance": over(bd - ad, bd + ad), "microprice": over(bid * ad + ask * bd, bd + ad)}


def depth_in_range(high: str, low: str, open_: str, close: str, average_range: str) -> dict[str, Column]:
    """How deep a bar's wicks and its whole span are, in average true ranges: upper_depth, lower_depth and span_depth; null without a range over 0."""
    unit = F.when(F.col(average_range) > 0, F.col(average_range))
    return {"upper_depth": (F.col(high) - F.greatest(open_, close)) / unit, "lower_depth": (F.least(open_, close) - F.col(low)) / unit, "span_depth": (F.col(high) - F.col(low)) / unit}
