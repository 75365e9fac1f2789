"""Student's t distribution as column expressions: no Python in the tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.nulls import two_sided as normal_two_sided

#: terms of the continued fraction, and degrees of freedom over which the normal distribution of a corrected t is as exact
TERMS = 200
LARGE = 4000

# Lanczos' coefficients for g = 7, nine terms.
_LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function, for x of at least a half."""
    total = F.lit(_LANCZOS[0])
    for i, c in enumerate(_LANCZOS[1:]):
        total = total + c / (x + i)
    t = x + 6.5
    return 0.5 * math.log(2 * math.pi) + (x - 0.5) * F.log(t) - t + F.log(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; fast where x < (a + 1) / (a + b + 2)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    d0 = 1 / safe(1 - (a + b) * x / (a + 1))
    start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # each half in a struct of its own, so that no part is written out twice
        half = lambda s, k: F.struct(safe(1 + k / s["c"]).alias("c"), (1 / safe(1 + k * s["d"])).alias("d"), s["h"].alias("h"))
        turn = lambda s: F.struct(s["c"].alias("c"), s["d"].alias("d"), (s["h"] * s["c"] * s["d"]).alias("h"))
        held = lambda v, f: F.element_at(F.transform(F.array(v), f), 1)
        return held(held(held(half(s, even), turn), lambda v: half(v, odd)), turn)

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, lambda s, m: step(s, m.cast("double")), lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, for a and b of at least a half and x in [0, 1]."""
    front = lambda a, b, x: F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
    low = x < (a + 1) / (a + b + 2)
    p, q, y = F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(1 - x)
    part = front(p, q, y) * _fraction(p, q, y) / p
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(F.when(low, part).otherwise(1 - part))


def two_sided(t: Column, df: Column) -> Column:
    """P(|T| >= |t|) of Student's t with df degrees of freedom (whole or not); null without t, or df under 1. The error is under 1e-6."""
    t, df = t.cast("double"), df.cast("double")
    exact = incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))
    large = normal_two_sided(t * (1 - 1 / (4 * df)) / F.sqrt(1 + t * t / (2 * df)))
    return F.when(df >= 1, F.when(df > LARGE, large).otherwise(exact))
