"""Set operations over the values of a column.

Intersections and differences between two sides (versions, platforms) are
one aggregate per value with two membership flags, not two ``distinct``
frames plus ``intersect``/``subtract``: one shuffle, and the labels partition
the value set by construction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of same-schema frames by column name (U1); filters push into each side."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def set_overlap(
    df: DataFrame,
    value: str,
    side: str,
    a: str,
    b: str,
    group: Sequence[str] = (),
    both_label: str = "both",
    a_label: str | None = None,
    b_label: str | None = None,
) -> DataFrame:
    """Label each distinct ``value`` as in both sides, only ``a`` or only ``b``.

    Rows whose ``side`` is neither ``a`` nor ``b`` are ignored. A null value is
    a value (it gets a label too), as in a Python set of the column.
    """
    s = F.col(side)
    flags = (
        df.filter(s.isin(a, b))
        .groupBy(*group, value)
        .agg(F.max(s == F.lit(a)).alias("_in_a"), F.max(s == F.lit(b)).alias("_in_b"))
    )
    membership = (
        F.when(F.col("_in_a") & F.col("_in_b"), F.lit(both_label))
        .when(F.col("_in_a"), F.lit(a_label or f"{a}_only"))
        .otherwise(F.lit(b_label or f"{b}_only"))
    )
    return flags.select(*group, value, membership.alias("membership"))


def unmapped(counts: DataFrame, mapping: DataFrame, col: str, key: str = "original_category") -> DataFrame:
    """Rows of ``counts`` whose ``col`` has no mapping entry (J5); null is unmapped."""
    keys = mapping.select(F.col(key).alias("_key")).distinct()
    return counts.join(keys, counts[col] == keys["_key"], "left_anti")


def presence_mask(
    mapping: DataFrame,
    used: DataFrame,
    key: str,
    value: str,
    side: str,
    sides: Sequence[tuple[str, str]],
) -> DataFrame:
    """For each mapping row, one column per side: the key if that side uses it, else null.

    ``used`` is the data; it is reduced to one row per value with a flag per
    side (an aggregate) before it meets the mapping, so the join is between
    two small frames.
    """
    flags = used.groupBy(value).agg(*[F.max(F.col(side) == F.lit(s)).alias(f"_u{i}") for i, (s, _) in enumerate(sides)])
    joined = mapping.join(flags, mapping[key] == flags[value], "left")
    return joined.select(
        *mapping.columns,
        *[F.when(F.coalesce(F.col(f"_u{i}"), F.lit(False)), mapping[key]).alias(name) for i, (_, name) in enumerate(sides)],
    )
