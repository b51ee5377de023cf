"""Category harmonisation through the taxonomy mapping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F



def unique_mapping(mapping: DataFrame, key: str = "original_category") -> DataFrame:
    """``_orig`` -> ``_sc``; reading it fails if a key repeats (that would fan rows out).

    The check is part of the plan, so building a query runs nothing.
    """
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    sure = F.when(n > 1, F.raise_error(F.concat(F.lit("mapping key not unique: "), F.col(key)))).otherwise(F.col("super_cluster"))
    return mapping.select(F.col(key).alias("_orig"), sure.alias("_sc"))


def harmonize(
    df: DataFrame,
    mapping: DataFrame,
    col: str = "category",
    date_col: str = "application_date",
) -> DataFrame:
    """Row-level harmonisation; the row count is preserved (unique mapping key).

    ``category`` -> ``category_raw`` + ``category_harmonized`` (null when
    unmapped), ``application_date`` -> ``application_date_raw`` and the
    UTC-normalised ``application_date_harmonized`` (both dates; the session
    time zone is UTC and the stored values carry no zone).
    """
    m = unique_mapping(mapping)
    joined = df.join(m, df[col] == m["_orig"], "left")
    out = []
    for c in df.columns:
        if c == col:
            out += [F.col(c).alias(f"{col}_raw"), F.col("_sc").alias(f"{col}_harmonized")]
        elif c == date_col:
            out += [F.to_date(F.col(c)).alias(f"{date_col}_raw"), F.to_date(F.col(c)).alias(f"{date_col}_harmonized")]
        else:
            out.append(F.col(c))
    return joined.select(*out)


def map_counts(
    counts: DataFrame,
    mapping: DataFrame,
    col: str = "category",
) -> DataFrame:
    """Left join of aggregated counts to the mapping (J3): adds ``super_cluster``."""
    m = unique_mapping(mapping).withColumnRenamed("_sc", "super_cluster")
    return counts.join(m, counts[col] == m["_orig"], "left").drop("_orig")


def lookup_counts(
    df: DataFrame,
    wanted: Sequence[tuple[str, str]],
    group: Sequence[str] = (),
    col: str = "category",
    version_col: str = "api_version",
) -> DataFrame:
    """Rows per wanted (category, version) pair per group; absent pairs report 0.

    One conditional aggregate over the data, then a reshape; no join with the
    wanted list and no cross product with the groups.
    """
    aggs = [F.count_if((F.col(col) == F.lit(c)) & (F.col(version_col) == F.lit(v))).alias(f"_w{i}") for i, (c, v) in enumerate(wanted)]
    agg = df.groupBy(*group).agg(*aggs)
    structs = [F.struct(F.lit(c).alias(col), F.lit(v).alias(version_col), F.col(f"_w{i}").alias("count")) for i, (c, v) in enumerate(wanted)]
    return agg.select(*group, F.inline(F.array(*structs)))
