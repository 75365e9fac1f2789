"""Names for helper columns that can't meet those of the caller."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spare(rows: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to be none of the rows' columns (case ignored) nor one of the others."""
    taken, out = {c.lower() for c in rows.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
