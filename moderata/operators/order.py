"""Ordering for reports: mixed-direction sorts with a fixed tie-break, and a
deterministic head (O1-O3).

A report is sorted only at its end, on aggregated rows. ``orderBy`` is a
distributed range-partitioned sort, so it also holds for a large frame;
every column not named in the keys is appended ascending (nulls first) so
the order is total and repeatable.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Key = str | tuple[str, str]


def _order(df: DataFrame, keys: Sequence[Key], tie_break: bool = True) -> list[Column]:
    cols: list[Column] = []
    named = []
    for k in keys:
        name, direction = (k, "asc") if isinstance(k, str) else k
        named.append(name)
        c = F.col(name)
        cols.append(c.desc_nulls_last() if direction == "desc" else c.asc_nulls_first())
    if tie_break:
        cols += [F.col(c).asc_nulls_first() for c in df.columns if c not in named]
    return cols


def sort_by(df: DataFrame, keys: Sequence[Key], tie_break: bool = True) -> DataFrame:
    """Sort by ``keys`` (``"col"`` or ``("col", "asc"|"desc")``), then by the other columns."""
    return df.orderBy(*_order(df, keys, tie_break))


def head(df: DataFrame, n: int, keys: Sequence[Key]) -> DataFrame:
    """The first ``n`` rows in a defined order (an unordered head is not repeatable)."""
    return sort_by(df, keys).limit(n)


def head_per_group(df: DataFrame, n: int, group: Sequence[str], keys: Sequence[Key]) -> DataFrame:
    """The first ``n`` rows of every group in a defined order.

    ``row_number() <= n`` is planned with a partial ``WindowGroupLimit`` before
    the shuffle, so a group holding a third of all rows still sends at most
    ``n`` rows per map task to its final task.
    """
    w = Window.partitionBy(*group).orderBy(*_order(df.drop(*group), keys))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")
