"""Row-count reconciliation: filter funnel, date range, midnight check, ratios
(A1, A11, A19, A20, A22, P4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import agreement, midnight, share_pct


def funnel(df: DataFrame, steps: Sequence[tuple[str, Column]], group: Sequence[str] = ()) -> DataFrame:
    """Rows kept after each cumulative step, in one scan.

    ``steps`` are (name, cumulative predicate) in order. Output per group and
    step: ``rows``, ``dropped`` (vs the previous step) and ``retention_pct``.
    """
    agg = df.groupBy(*group).agg(*[F.count_if(pred).alias(f"_s{i}") for i, (_, pred) in enumerate(steps)])
    structs = []
    for i, (name, _) in enumerate(steps):
        prev = F.col(f"_s{i - 1}") if i else F.col(f"_s{i}")
        structs.append(
            F.struct(
                F.lit(i + 1).alias("step_no"),
                F.lit(name).alias("step"),
                F.col(f"_s{i}").alias("rows"),
                (prev - F.col(f"_s{i}")).alias("dropped"),
                share_pct(F.col(f"_s{i}"), prev).alias("retention_pct"),
            )
        )
    return agg.select(*group, F.inline(F.array(*structs)))


def date_range(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Earliest and latest value per group."""
    return df.groupBy(*group).agg(F.min(col).alias("earliest"), F.max(col).alias("latest"))


def midnight_check(df: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Rows whose timestamp is at 00:00:00, of all rows."""
    return df.groupBy(*group).agg(
        F.count_if(midnight(col)).alias("midnight_rows"),
        F.count(F.lit(1)).alias("total_rows"),
    )


def ratio_between(df: DataFrame, side: str, a: str, b: str) -> DataFrame:
    """Rows of side ``a`` per row of side ``b`` in one row (A19); null when b has none."""
    agg = df.agg(
        F.count_if(F.col(side) == F.lit(a)).alias("a_rows"),
        F.count_if(F.col(side) == F.lit(b)).alias("b_rows"),
    )
    return agg.withColumn("ratio", F.when(F.col("b_rows") > 0, F.col("a_rows") / F.col("b_rows")))


def agreement_counts(df: DataFrame, col: str, ref_col: str, group: Sequence[str] = ()) -> DataFrame:
    """null / equal / different counts of ``col`` against ``ref_col`` (P4 + A2).

    Every status is reported, with 0 when absent, and its share of the group total.
    """
    status = agreement(col, ref_col)
    agg = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(status == F.lit(s)).alias(f"_{s}") for s in ("null", "equal", "different")],
    )
    structs = [F.struct(F.lit(s).alias("status"), F.col(f"_{s}").alias("n")) for s in ("null", "equal", "different")]
    long = agg.select(*group, "total", F.inline(F.array(*structs)))
    return long.select(*group, "status", "n", share_pct("n", "total").alias("pct"), "total")
