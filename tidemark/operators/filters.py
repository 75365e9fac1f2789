"""Predicates: masks from specifications, filters by name, sanity and alignment checks, names."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: tokens of column names that tell of the future
FORWARD = ("fwd", "future", "forward", "label", "target", "next")


def mask(spec: Mapping[str, Mapping[str, float | Sequence]]) -> Column:
    """All bounds of a specification {column: {min, max, over, under, equals, among}} together; null values meet none."""
    out = F.lit(True)
    for name, bounds in spec.items():
        c = F.col(name)
        for kind, v in bounds.items():
            ops = {"min": lambda: c >= v, "max": lambda: c <= v, "over": lambda: c > v, "under": lambda: c < v, "equals": lambda: c == v, "among": lambda: c.isin(list(v))}
            if kind not in ops:
                raise ValueError(f"no bound {kind}: one of {sorted(ops)}")
            out = out & ops[kind]()
    return F.coalesce(out, F.lit(False))


def fan_out(rows: DataFrame, filters: Mapping[str, Column], name: str = "filter") -> DataFrame:
    """A row for every filter it meets, with the filter's name; rows that meet none go. One pass, whatever the number of filters."""
    met = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in filters.items()]), lambda x: x.isNotNull())
    return rows.withColumn(name, F.explode(met))


def bar_faults(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: str | None = None) -> Column:
    """Names of the rules that a bar breaks, comma-joined; empty for a sound one."""
    o, h, l, c = (F.col(x) for x in (open_, high, low, close))
    rules = {"high_low": h < F.greatest(o, l, c), "low_high": l > F.least(o, h, c), "not_positive": F.least(o, h, l, c) <= 0, "missing": o.isNull() | h.isNull() | l.isNull() | c.isNull()}
    if volume:
        rules["negative_volume"] = F.col(volume) < 0
    return F.concat_ws(",", *[F.when(r, k) for k, r in rules.items()])


def split_sound(rows: DataFrame, faults: Column) -> tuple[DataFrame, DataFrame]:
    """(sound rows, rows with their `faults`)."""
    out = rows.withColumn("faults", faults)
    return out.where("faults = ''").drop("faults"), out.where("faults <> ''")


def aligned(ts: str, step_s: int) -> Column:
    """Whether an instant is a whole number of steps."""
    return F.pmod(F.unix_micros(F.col(ts).cast("timestamp")), F.lit(step_s * 1_000_000)) == 0


def without(rows: DataFrame, excluded: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose keys are not among those excluded (null keys stay): an anti-join, so the list can be of any size."""
    return rows.join(excluded.select(*keys).distinct(), list(keys), "left_anti")


def leaking_columns(columns: Sequence[str], tokens: Sequence[str] = FORWARD) -> list[str]:
    """The columns whose names tell of the future: a feature table must have none."""
    return [c for c in columns if set(re.split(r"[^a-z0-9]+", c.lower())) & set(tokens)]


def checked_features(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    """rows with these columns alone; raises where one of them tells of the future."""
    bad = leaking_columns(features)
    if bad:
        raise ValueError(f"columns that tell of the future: {bad}")
    return rows.select(*features)


def symbol_class(name: str) -> Column:
    """missing, numeric, malformed (anything but letters and digits, or over 20 of them), leveraged (ends in 3L, 5S, UP, DOWN, BULL or BEAR) or plain."""
    c = F.upper(F.trim(F.col(name)))
    return (F.when(c.isNull() | (c == ""), "missing").when(c.rlike("^[0-9]+$"), "numeric").when(~c.rlike("^[A-Z0-9]{1,20}$"), "malformed")
            .when(c.rlike("([235][LS]|UP|DOWN|BULL|BEAR)$"), "leveraged").otherwise("plain"))


def feature_columns(rows: DataFrame, tokens: Sequence[str] = FORWARD) -> list[str]:
    """Numeric columns whose names are those of neither keys nor outcomes."""
    numeric = [name for name, kind in rows.dtypes if kind in ("int", "bigint", "smallint", "float", "double") or kind.startswith("decimal")]
    bad = set(leaking_columns(numeric, tokens))
    return [c for c in numeric if c not in bad and not re.search(r"(key|_id|^id)$", c.lower())]
