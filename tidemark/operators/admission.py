"""Admission of candidates under caps, one after the other in order of priority."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.carry import carried
from tidemark.operators.names import spare


def admitted(candidates: DataFrame, book: str, order: Sequence[str], entry: str, exit_: str, member: str, groups: Mapping[str, int], most: int, backup: Column | None = None, primary: Column | None = None) -> DataFrame:
    """candidates with `decision`: accept, or what rejects it (overlap, total, the column of `groups` whose cap is full, or backup).

    Each book is a fold of its own over its candidates in `order` (time first, then priority). What has ended by a candidate's entry is closed
    first; the state is the open positions, `most` of them at most. A candidate without entry, exit or member is rejected as incomplete.
    backup: candidates that no cap rejects are rejected all the same while a `primary` position (None: any) is open.
    """
    columns = list(groups)

    def step(open_, start, end, who, back, first, *of):
        if start is None or end is None or who is None:
            return open_, ("incomplete",)
        open_ = [x for x in open_ if x[0] > start]
        if any(x[1] == who for x in open_):
            return open_, ("overlap",)
        if len(open_) >= most:
            return open_, ("total",)
        for i, c in enumerate(columns):
            if sum(x[2][i] == of[i] for x in open_) >= groups[c]:
                return open_, (c,)
        if back and any(x[3] for x in open_):
            return open_, ("backup",)
        return [*open_, (end, who, of, first)], ("accept",)

    begin, end_, back, first = spare(candidates, "_in", "_out", "_backup", "_primary")
    flag = lambda c, otherwise: F.lit(otherwise) if c is None else F.coalesce(c, F.lit(False))
    x = candidates.withColumns({back: flag(backup, False), first: flag(primary, True), begin: F.unix_micros(F.col(entry).cast("timestamp")), end_: F.unix_micros(F.col(exit_).cast("timestamp"))})
    return carried(x, [book], list(order), [begin, end_, member, back, first, *columns], "decision string", list, step).drop(begin, end_, back, first)


def violations(positions: DataFrame, book: str, entry: str, exit_: str, member: str, most: int) -> DataFrame:
    """Books with more than `most` positions open at once, or two of one member: a check on any set of positions, by sweeps."""
    from tidemark.operators.series import concurrency

    total = concurrency(positions, book, entry, exit_).where(F.col("most_open") > most).select(book, F.lit("total").alias("rule"))
    both = positions.withColumn("_k", F.struct(book, member))
    twice = concurrency(both, "_k", entry, exit_).where("most_open > 1").select(F.col("_k")[book].alias(book), F.lit("overlap").alias("rule")).distinct()
    return total.unionByName(twice)
