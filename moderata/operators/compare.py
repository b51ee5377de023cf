"""Rates against a fixed base and period-over-period deviation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import pct_change, per_million


def rate_per_million(
    counts: DataFrame,
    base: DataFrame,
    on: Sequence[str],
    count_col: str = "raw_count",
    base_col: str = "amar",
    out_col: str = "intensity_rate",
    digits: int = 2,
) -> DataFrame:
    """Inner-join aggregated counts with a base dimension; ``count / base * 1e6``.

    Rows without a base (months outside the dimension) drop out. The base side
    is broadcast only within the checked row bound.
    """
    joined = counts.join(base, list(on), "inner")
    return joined.withColumn(out_col, per_million(count_col, base_col, digits))


def compare_periods(
    df: DataFrame,
    on: Sequence[str],
    period_col: str,
    a: str,
    b: str,
    rate_col: str,
    a_name: str = "jan_rate",
    b_name: str = "feb_rate",
    out_col: str = "pct_deviation",
    digits: int | None = 2,
) -> DataFrame:
    """Put periods ``a`` and ``b`` side by side per key and take the percent change.

    A conditional aggregate instead of a self-join: one pass, one shuffle on
    ``on``; keys missing either period are dropped, as with an inner join.
    """
    wide = df.groupBy(*on).agg(
        F.max(F.when(F.col(period_col) == F.lit(a), F.col(rate_col))).alias(a_name),
        F.max(F.when(F.col(period_col) == F.lit(b), F.col(rate_col))).alias(b_name),
    )
    wide = wide.filter(F.col(a_name).isNotNull() & F.col(b_name).isNotNull())
    return wide.withColumn(out_col, pct_change(a_name, b_name, digits))
