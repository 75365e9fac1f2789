"""Statistics of event studies: costs, regressions, nulls, false-discovery control, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.carry import carried
from tidemark.operators.names import spare
from tidemark.operators.quantiles import beside
from tidemark.operators.shared import kept


def trade_pnl(entry: Column, exit_: Column, notional: Column, side: Column, cost: float) -> Column:
    """struct<gross, cost, net> of a round trip."""
    move = exit_ / entry - 1
    gross = notional * F.when(side == "short", -move).otherwise(move)
    return F.struct(gross.alias("gross"), (notional * cost).alias("cost"), (gross - notional * cost).alias("net"))


def ols(y: Column, x: Column) -> list[Column]:
    """n, slope, intercept, r2 and the slope's t of y on x, from mergeable sums."""
    n, r2 = F.regr_count(y, x), F.regr_r2(y, x)
    return [n.alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), r2.alias("r2"),
            (F.sqrt(r2 * (n - 2) / F.when(r2 < 1, 1 - r2)) * F.signum(F.regr_slope(y, x))).alias("t")]


def with_p(fits: DataFrame, spent: int = 2, name: str = "p") -> DataFrame:
    """Fits of ols() with the two-sided p of their t, of Student's t with n - `spent` degrees of freedom; null where there are none."""
    from tidemark.functions import student

    return fits.withColumn(name, student.two_sided(F.col("t"), F.col("n") - spent))


def adjusted(tests: DataFrame, family: list[str], p: str, name: str = "q", tie: str | None = None) -> DataFrame:
    """Benjamini-Hochberg values within each family, and `bonferroni`: p times the number of tests, at most 1. Null p values take no part."""
    w = Window.partitionBy(*family)
    ties = [tie] if tie else []
    _raw, _rank = spare(tests, "_raw", "_rank")
    rank, n = F.row_number().over(w.orderBy(F.col(p).asc_nulls_last(), *ties)), F.count(p).over(w)
    raw = tests.withColumn(_raw, F.col(p) * n / rank).withColumn(_rank, rank).withColumn("bonferroni", F.least(F.lit(1.0), F.col(p) * n))
    # the least of a test and those after it, carried from the last one down
    least = F.min(_raw).over(w.orderBy(F.desc(_rank)).rowsBetween(Window.unboundedPreceding, 0))
    return raw.withColumn(name, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), least))).drop(_raw, _rank)


#: standard deviations of the kth hash that are looked at
MARGIN = 7


def _near_threshold(rows: DataFrame, per: DataFrame, block: list[str], h: Column, rounds: int, names: list[str]) -> DataFrame:
    """A row for each round, with its block's k and n (those of `per`, a row a block), its hash, and `sure`: 1 well under the kth hash, 0 near it; what is well over it goes before any shuffle.

    Of n even hashes the kth lies near the share k / n: further than MARGIN of its standard deviations away about once in 10^11 draws.
    """
    _k, _n, _h, _sure = names
    low, high = spare(rows, "_low", "_high")
    share = F.least(F.col(_k) / F.col(_n), F.lit(1.0))
    off = (MARGIN * F.sqrt(F.col(_n) * share * (1 - share)) + MARGIN * MARGIN) / F.col(_n)
    digits = lambda x: F.lpad(F.lower(F.hex((F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * float((1 << 52) - 1)).cast("long"))), 13, "0")
    per = per.where((F.col(_k) > 0) & (F.col(_n) > 0)).withColumns({low: digits(share - off), high: F.concat(digits(share + off), F.lit("g"))})  # hashes are compared as text
    x = dealt(beside(rows, per, block, "inner")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn(_h, h)
    return x.where(F.col(_h) <= F.col(high)).withColumn(_sure, F.when(F.col(_h) < F.col(low), 1).otherwise(0)).drop(low, high)


def dealt(rows: DataFrame) -> DataFrame:
    """rows, dealt out evenly: for rows that are each hashed for every round, so that those of a small file are not one task's work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _short(x: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Blocks and rounds whose kth hash lies elsewhere all the same: a row for each, with k; none, unless hashes repeat or a block is tiny and unlucky."""
    _k, _n, _h, _sure = names
    seen = x.groupBy(*key).agg(F.max(_k).alias(_k), F.max(_n).alias(_n), F.sum(_sure).alias(_sure), F.count(F.lit(1)).alias(_h))
    return seen.where((F.col(_sure) > F.col(_k)) | (F.col(_h) < F.least(_k, _n)))


def drawn(rows: DataFrame, block: list[str], h: Column, k: Column, rounds: int) -> DataFrame:
    """In each round the k smallest of the hashes h (hex, of a row and `round`) of each block: rows with `round`.

    Most rows are settled where they are read, by their hash against the share k / n: what is well over it goes, what is well under it stays. Only rows
    near it are shuffled and ranked. A block whose kth hash lies elsewhere is ranked whole. k is the same for all rows of a block.
    """
    _k, _n, _h, _sure, _r = names = spare(rows, "_k", "_n", "_h", "_sure", "_r")
    key, names = ["round", *block], names[:4]
    per = rows.groupBy(*block).agg(F.max(k.cast("long")).alias(_k), F.count(F.lit(1)).alias(_n))
    x = _near_threshold(rows, per, block, h, rounds, names)
    under = x.groupBy(*key).agg(F.sum(_sure).alias(_r))  # a row a block and round
    bad = F.broadcast(_short(x, key, names).select(*key, F.lit(1).alias(_r)))  # next to none: see _short
    near = beside(x.where(F.col(_sure) == 0), under, key, "inner").withColumn(_k, F.col(_k) - F.col(_r))
    near = near.withColumn(_r, F.row_number().over(Window.partitionBy(*key).orderBy(_h))).where(F.col(_r) <= F.col(_k)).drop(_r)
    fine = beside(x.where(F.col(_sure) == 1).unionByName(near), bad, key).where(F.col(_r).isNull())
    return fine.select(*rows.columns, "round").unionByName(_whole(rows, block, h, k, rounds, bad, [_k, _h, _r]))


def _whole(rows: DataFrame, block: list[str], h: Column, k: Column, rounds: int, bad: DataFrame, names: list[str]) -> DataFrame:
    """The k smallest hashes of the blocks and rounds in `bad`, by ranking all their rows."""
    _k, _h, _r = names
    key = ["round", *block]
    again = rows.withColumn(_k, k.cast("long")).withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    again = beside(again, bad, key, "inner").drop(_r).withColumn(_h, h)
    return again.withColumn(_r, F.row_number().over(Window.partitionBy(*key).orderBy(_h))).where(F.col(_r) <= F.col(_k)).select(*rows.columns, "round")


def seeded(seed: str, *parts: str | Column) -> Column:
    """md5 of the seed and the parts, joined by colons."""
    return F.md5(F.concat_ws(":", F.lit(seed), *parts))


def permuted_means(events: DataFrame, block: list[str], id_col: str, label: Column, value: str, rounds: int, seed: str, event: Column | None = None) -> DataFrame:
    """A seeded null: in each round labels move to other rows of their block (those with the smallest hashes of id_col); round, the drawn rows' mean and number.

    event: rows that are events themselves, which no label moves to. Rows that are surely drawn are added up by the tasks that read them; only those near the
    threshold (see drawn) meet in an order.
    """
    _on, _k, _n, _r = spare(events, "_on", "_k", "_n", "_r")
    x = events.withColumn(_on, label.cast("long")).withColumn(_r, F.lit(True) if event is None else ~event)
    per = x.groupBy(*block).agg(F.sum(_on).alias(_k), F.count(F.when(F.col(_r), 1)).alias(_n))
    out = drawn_sums(x.where(F.col(_r)), per, (_k, _n), block, id_col, value, rounds, seed)
    return out.select("round", (F.col("total") / F.nullif(F.col("n_values"), F.lit(0.0))).alias("null_mean"), F.round("n").cast("long").alias("n"))


def drawn_sums(rows: DataFrame, per: DataFrame, sizes: tuple[str, str], block: list[str], id_col: str, value: str, rounds: int, seed: str) -> DataFrame:
    """round, total (of the values of the rows that drawn() would draw), n_values and n (how many there are); rows that share the last hash drawn count in part.

    per: a row a block with its k and n, in the columns `sizes`. Every row is hashed once a round.
    """
    _k, _n = sizes
    _on, _h, _sure, _v, _c, _r, _m = spare(rows.select("*", F.lit(0).alias(_k), F.lit(0).alias(_n)), "_on", "_h", "_sure", "_v", "_c", "_r", "_m")
    pool = rows.select(*dict.fromkeys([*block, id_col, value]))
    key, h = ["round", *block], seeded(seed, "round", *block, id_col)
    near = _near_threshold(pool, per, block, h, rounds, [_k, _n, _h, _sure])
    parts = near.groupBy(*key, F.when(F.col(_sure) == 0, F.col(_h)).alias(_h)).agg(F.count(F.lit(1)).alias(_c), F.count(value).alias(_m), F.sum(value).alias(_v), F.max(_k).alias(_k), F.max(_n).alias(_n))
    whole = Window.partitionBy(*key)  # one row for all that are sure, and those near the threshold
    sure, some = F.sum(F.when(F.col(_h).isNull(), F.col(_c)).otherwise(0)).over(whole), F.sum(_c).over(whole)
    upto = F.sum(_c).over(whole.orderBy(F.col(_h).asc_nulls_first()))
    parts = parts.withColumns({_on: (sure > F.col(_k)) | (some < F.least(_k, _n)), _r: F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(_k) - upto + F.col(_c)) / F.col(_c)))})
    # a row a block and round, kept: rows are hashed for them once, and what follows takes both their sums and the blocks that have to be ranked whole
    part = lambda c: F.sum(F.col(c) * F.col(_r)).alias(c)
    met = kept(parts.groupBy(*key, _on).agg(part(_v), part(_m), part(_c)))
    fine, bad = met.where(~F.col(_on)).select("round", _v, _m, _c), met.where(F.col(_on)).select(*key, F.lit(1).alias(_r))
    if not bad.isEmpty():  # next to never: see _short
        again = _whole(beside(pool, per.select(*block, F.col(_k).alias(_on)), block, "inner"), block, h, F.col(_on), rounds, F.broadcast(bad), [_k, _h, _r])
        fine = fine.unionByName(again.groupBy("round").agg(F.sum(value).alias(_v), F.count(value).cast("double").alias(_m), F.count(F.lit(1)).cast("double").alias(_c)))
    return fine.groupBy("round").agg(F.sum(_v).alias("total"), F.sum(_m).alias("n_values"), F.sum(_c).alias("n"))


def chained(rows: DataFrame, key: str, order: list[str], payload: list[str]) -> DataFrame:
    """An append-only ledger: key, seq, body, prev and hash; a row's hash covers its payload (JSON by column name, nulls kept) and the hash before it."""
    body = F.to_json(F.struct(*sorted(payload)), {"ignoreNullFields": "false"})

    def step(state, text):
        import hashlib

        seq, prev = state
        now = hashlib.sha256(f"{prev}|{text}".encode()).hexdigest()
        return (seq + 1, now), (seq + 1, prev, now)

    out = carried(rows.select(key, *[c for c in order if c != key], body.alias("body")), [key], order, ["body"], "seq int, prev string, hash string", lambda: (0, ""), step)
    return out.select(key, "seq", "body", "prev", "hash")


def verified(ledger: DataFrame, key: str) -> DataFrame:
    """Whether each key's chain is whole: every hash is that of its body and prev, and prev is the hash before; the first row where not."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy(key).orderBy("seq")), F.lit(""))
    good = (F.sha2(F.concat_ws("|", "prev", "body"), 256) == F.col("hash")) & (before == F.col("prev"))
    return ledger.withColumn("_good", good).groupBy(key).agg(F.bool_and("_good").alias("whole"), F.count(F.lit(1)).alias("n"), F.min(F.when(~F.col("_good"), F.col("seq"))).alias("first_broken"))
