"""Count per group and share within a coarser group.

Shape of every analysis in the study: aggregate first (partial aggregation
on the map side, one shuffle on the group keys), then relate each count to
its group total. The total is a second aggregate of the already-aggregated
counts, joined back on the coarse keys. We use that join instead of
``sum(..).over(partitionBy(coarse))`` because a window puts a whole coarse
group into one task: harmless on 17 categories, not on a generic input where
one coarse group may hold a third of all rows. The join side is the totals
frame (one row per coarse group); AQE turns it into a broadcast when its
measured size is small and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import share_pct
from .joins import join_on


def count_by(df: DataFrame, keys: Sequence[str], name: str = "count") -> DataFrame:
    """``groupBy(keys).count()`` with a chosen output name (nulls form a group)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def share_of_counts(
    counts: DataFrame,
    within: Sequence[str] = (),
    count_col: str = "count",
    pct_col: str = "pct",
    keep: Column | None = None,
) -> DataFrame:
    """Add ``pct = count / sum(count) over within * 100`` to an aggregated frame.

    ``keep`` filters rows *after* the totals are taken (the study filters to
    one decision value after computing the share).
    """
    totals = counts.groupBy(*within).agg(F.sum(count_col).alias("_total"))
    rows = counts if keep is None else counts.filter(keep)
    return join_on(rows, totals, list(within)).withColumn(pct_col, share_pct(count_col, "_total")).drop("_total")


def group_share(
    df: DataFrame,
    keys: Sequence[str],
    within: Sequence[str] = (),
    count_col: str = "count",
    pct_col: str = "pct",
    keep: Column | None = None,
) -> DataFrame:
    """Rows per ``within + keys`` group and their percentage of the ``within`` group."""
    counts = count_by(df, [*within, *keys], count_col)
    return share_of_counts(counts, within, count_col, pct_col, keep)


def conditional_share(
    df: DataFrame,
    keys: Sequence[str],
    predicate: Column,
    count_col: str = "count",
    pct_col: str = "pct",
    total_col: str | None = None,
    keep_zero: bool = False,
    weight: str | None = None,
) -> DataFrame:
    """Share of rows matching ``predicate`` per group, in one aggregate.

    Equal to count-per-value + share + filter-to-value, without the second
    aggregate or the join. Groups with no matching row are dropped unless
    ``keep_zero`` (the study's frames drop them because the filtered value
    never appears). With ``weight`` the input is already aggregated and each
    row counts ``weight`` times.
    """
    if weight is None:
        hit, total = F.count_if(predicate), F.count(F.lit(1))
    else:
        hit = F.coalesce(F.sum(F.when(predicate, F.col(weight))), F.lit(0).cast("long"))
        total = F.sum(weight)
    agg = df.groupBy(*keys).agg(hit.alias(count_col), total.alias("_total"))
    if not keep_zero:
        agg = agg.filter(F.col(count_col) > 0)
    out = agg.withColumn(pct_col, share_pct(count_col, "_total"))
    return out.withColumnRenamed("_total", total_col) if total_col else out.drop("_total")


def top_per_group(
    df: DataFrame,
    group: Sequence[str],
    value_col: str,
    by_col: str,
    carry: Sequence[str] = (),
    value_alias: str | None = None,
    carry_alias: Sequence[str] | None = None,
) -> DataFrame:
    """Arg-max per group: the ``value_col`` with the largest ``by_col``.

    Ties go to the smallest value, nulls first (a fixed rule; the study's tie
    order is undefined). Planned as ``row_number() = 1`` with a partial
    ``WindowGroupLimit`` before the shuffle, so even a group holding most of
    the rows sends one row per map task to its final task; no sort-based
    aggregate over text buffers.
    """
    from .order import head_per_group

    best = head_per_group(df.select(*group, value_col, by_col, *carry), 1, group, [(by_col, "desc"), value_col])
    names = list(carry_alias) if carry_alias else list(carry)
    return best.select(*group, F.col(value_col).alias(value_alias or value_col), *[F.col(c).alias(n) for c, n in zip(carry, names)])
