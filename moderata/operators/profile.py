"""Column profiling and data-quality screening.

Wide-to-long reshaping uses ``inline(array(struct ...))`` (a ``Generate``),
so a per-column report is one aggregate over the input followed by a reshape
of the few aggregated rows. Where a metric needs the values themselves
(exact distincts, top-N), the values are reshaped first and aggregated by
``(group, column, value)`` with map-side partial aggregation: a value that
holds a third of all rows collapses to one row per map task before the
shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import at_length_limit, share_pct, strip_trailing_period
from .joins import join_on


def melt(df: DataFrame, ids: Sequence[str], entries: Sequence[tuple[str, Mapping[str, Column]]], label: str = "column") -> DataFrame:
    """Reshape wide to long: one output row per entry, ``label`` = entry name.

    All entries must give the same value names with the same types.
    """
    structs = [F.struct(F.lit(name).alias(label), *[v.alias(k) for k, v in vals.items()]) for name, vals in entries]
    return df.select(*ids, F.inline(F.array(*structs)))


def values_long(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group..., column, value) with every value cast to text."""
    return melt(df, list(group), [(c, {"value": F.col(c).cast("string")}) for c in columns])


def string_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.NumericType)


def null_report(df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Null count and percentage per column, all columns in one aggregate."""
    cols = list(columns or [c for c in df.columns if c not in group])
    agg = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"_n{i}") for i, c in enumerate(cols)],
    )
    long = melt(agg, [*group, "total_rows"], [(c, {"null_count": F.col(f"_n{i}")}) for i, c in enumerate(cols)])
    return long.select(*group, "column", "null_count", share_pct("null_count", "total_rows").alias("null_pct"), "total_rows")


def column_missing(df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = (), severe_pct: float = 10.0) -> DataFrame:
    """Missing = null or blank text, per column (A15), with a severity label.

    ``severity``: ``empty`` at 100 % missing, ``severe`` strictly between
    ``severe_pct`` and 100, else ``ok``.
    """
    cols = list(columns or [c for c in df.columns if c not in group])
    aggs = [F.count(F.lit(1)).alias("total_rows")]
    for i, c in enumerate(cols):
        v = F.col(c)
        aggs.append(F.count_if(v.isNull()).alias(f"_n{i}"))
        aggs.append(F.count_if(v.isNull() | (F.trim(v.cast("string")) == F.lit(""))).alias(f"_m{i}"))
    agg = df.groupBy(*group).agg(*aggs)
    long = melt(agg, [*group, "total_rows"], [(c, {"_null": F.col(f"_n{i}"), "_miss": F.col(f"_m{i}")}) for i, c in enumerate(cols)])
    miss = share_pct("_miss", "total_rows")
    return long.select(
        *group,
        "column",
        "total_rows",
        share_pct("_null", "total_rows").alias("null_pct"),
        miss.alias("total_missing_pct"),
        F.when(miss == 100, "empty").when((miss > severe_pct) & (miss < 100), "severe").otherwise("ok").alias("severity"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Exact distinct values per column, null counted as one value.

    One reshape + one aggregate on ``(group, column, value)`` for all columns
    together (no ``Expand`` per distinct aggregate), then a count per column.
    """
    long = values_long(df, columns, group)
    per_value = long.groupBy(*group, "column", "value").agg(F.count(F.lit(1)).alias("_c"))
    return per_value.groupBy(*group, "column").agg(F.count(F.lit(1)).alias("n_unique"))


def approx_distinct_counts(df: DataFrame, columns: Sequence[str], group: Sequence[str] = (), rsd: float = 0.016) -> DataFrame:
    """HyperLogLog++ distinct estimate per column, null counted as one value.

    Long layout: one sketch per (group, column) row. A wide aggregate with one
    sketch per column would carry thousands of register words in every
    aggregation buffer, which also switches off whole-stage codegen.
    """
    long = values_long(df, columns, group)
    return long.groupBy(*group, "column").agg(
        (F.approx_count_distinct("value", rsd) + F.max(F.col("value").isNull()).cast("long")).alias("n_unique")
    )


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    group: Sequence[str] = (),
    exact: bool = False,
    rsd: float = 0.016,
    variance_digits: int | None = 6,
) -> DataFrame:
    """Screening profile per column (A10): dtype, nulls, distincts, variance.

    One scan. Values are reshaped to (group, column, value[, num]):

    * ``exact=False``: per (group, column) row count, null count, sample
      variance of ``num`` and a HyperLogLog++ estimate at relative error
      ``rsd`` — a plain aggregate.
    * ``exact=True``: rows are counted per (group, column, value), and those
      counts are aggregated again per (group, column): rows, nulls, distinct
      values, and the variance from the counted values' distances to their
      mean. The mean is a second aggregate of the same counts (their shuffle is
      reused), so large means with a small spread (ids, epochs) lose no digits.
      The means, a row per group and numeric column, are broadcast: dealt by
      column, all values of one column would be one task's.

    A null counts as one distinct value either way. ``num`` is the value cast
    to double for numeric columns (null otherwise), so variance is the sample
    variance of numeric columns only.
    """
    cols = list(columns or [c for c in df.columns if c not in group])
    entries = [
        (c, {"value": F.col(c).cast("string"), "num": F.col(c).cast("double") if is_numeric(df, c) else F.lit(None).cast("double")})
        for c in cols
    ]
    long = melt(df, list(group), entries)
    var = F.var_samp("num")
    var = F.round(var, variance_digits) if variance_digits is not None else var
    keys = [*group, "column"]
    if exact:
        per_value = long.groupBy(*keys, "value", "num").agg(F.count(F.lit(1)).alias("_c"))
        c, x = F.col("_c"), F.col("num")
        means = per_value.groupBy(*keys).agg((F.sum(c * x) / F.sum(F.when(x.isNotNull(), c))).alias("_mean"))
        far = F.col("num") - F.col("_mean")
        means = F.broadcast(means.filter(F.col("_mean").isNotNull()))
        sums = join_on(per_value, means, keys, "left").groupBy(*keys).agg(
            F.sum("_c").alias("total_rows"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), c)), F.lit(0).cast("long")).alias("null_count"),
            F.count(F.lit(1)).alias("unique_count"),
            F.sum(F.when(x.isNotNull(), c)).alias("_n"),
            F.sum(c * far).alias("_s1"),
            F.sum(c * far * far).alias("_s2"),
        )
        n, s1, s2 = F.col("_n"), F.col("_s1"), F.col("_s2")
        # s1 is 0 but for the rounding of the mean, which this takes off again
        spread = F.when(n > 1, F.greatest((s2 - s1 * s1 / n) / (n - 1), F.lit(0.0)))
        stats = sums.withColumn("variance", F.round(spread, variance_digits) if variance_digits is not None else spread)
    else:
        stats = long.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_rows"),
            F.count_if(F.col("value").isNull()).alias("null_count"),
            var.alias("variance"),
            (F.approx_count_distinct("value", rsd) + F.max(F.col("value").isNull()).cast("long")).alias("unique_count"),
        )
    dtypes = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(df.schema[c].dataType.simpleString()))])
    return stats.select(
        *group,
        "column",
        dtypes[F.col("column")].alias("dtype"),
        "null_count",
        share_pct("null_count", "total_rows").alias("null_pct"),
        (F.col("total_rows") - F.col("null_count")).alias("non_null_count"),
        "unique_count",
        share_pct("unique_count", "total_rows").alias("unique_pct"),
        "variance",
    )


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Top-``n`` values per column by count (O4, W3); ties by value, nulls first.

    ``pct_of_rows`` is against all rows of the group, ``pct_of_top`` against
    the sum of the kept top-``n`` counts (the two bases the study's charts
    use). The rank filter is a ``row_number() <= n`` over (group, column);
    Spark plans it with a partial ``WindowGroupLimit`` before the shuffle, so
    each column's final task sees at most ``n`` rows per map partition, not
    every distinct value.
    """
    long = values_long(df, columns, group)
    counts = long.groupBy(*group, "column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*group, "column").agg(F.sum("count").alias("_rows"))
    return ranked_counts(counts, totals, n, group)


def ranked_counts(counts: DataFrame, totals: DataFrame, n: int, group: Sequence[str] = (), kept: str | None = None) -> DataFrame:
    """First ``n`` of (group, column, value, count) per column, with shares of the ``_rows`` in ``totals`` and of their counts.

    Rows where the boolean ``kept`` is false rank last and are left out; they
    are filtered after the rank, so that the totals reuse the count shuffle.
    """
    last = [F.col(kept).desc()] if kept else []
    w = Window.partitionBy(*group, "column").orderBy(*last, F.col("count").desc(), F.col("value").asc_nulls_first())
    top = counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    top = top.filter(kept).drop(kept) if kept else top
    top_sum = top.groupBy(*group, "column").agg(F.sum("count").alias("_top"))
    out = join_on(join_on(top, totals, [*group, "column"]), top_sum, [*group, "column"])
    return out.select(
        *group,
        "column",
        "rank",
        "value",
        "count",
        share_pct("count", "_rows").alias("pct_of_rows"),
        share_pct("count", "_top").alias("pct_of_top"),
    )


def string_stats(df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Length min/max/mean and leading/trailing-space count per text column."""
    cols = list(columns or string_columns(df, group))
    aggs = []
    for i, c in enumerate(cols):
        v = F.col(c)
        ln = F.length(v)
        aggs += [
            F.min(ln).alias(f"_a{i}"),
            F.max(ln).alias(f"_b{i}"),
            F.avg(ln).alias(f"_c{i}"),
            F.count_if(v != F.trim(v)).alias(f"_d{i}"),
        ]
    agg = df.groupBy(*group).agg(*aggs)
    entries = [
        (
            c,
            {
                "len_min": F.col(f"_a{i}"),
                "len_max": F.col(f"_b{i}"),
                "len_mean": F.col(f"_c{i}"),
                "whitespace_anomaly_count": F.col(f"_d{i}"),
            },
        )
        for i, c in enumerate(cols)
    ]
    return melt(agg, list(group), entries)


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Columns with exactly one distinct value, null counted as a value.

    One scan, one aggregate. A column is constant iff it is all null, or it
    has no null and every value has the same 64-bit hash (``min(h) =
    max(h)``). Its value comes from a sketch of the single most frequent item
    kept beside the hashes, which for a constant column is that value; a text
    ``min`` or ``first`` would force a sort of every row instead.
    """
    cols = list(columns or [c for c in df.columns if c not in group])
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for i, c in enumerate(cols):
        h = F.xxhash64(F.col(c))
        top = F.expr(f"approx_top_k(CAST(`{c}` AS STRING), 1, 8)")
        aggs += [F.count(F.col(c)).alias(f"_k{i}"), F.min(h).alias(f"_lo{i}"), F.max(h).alias(f"_hi{i}"), top.alias(f"_v{i}")]
    agg = df.groupBy(*group).agg(*aggs)
    entries = []
    for i, c in enumerate(cols):
        empty = F.col(f"_k{i}") == 0
        same = (F.col(f"_k{i}") == F.col("_rows")) & (F.col(f"_lo{i}") == F.col(f"_hi{i}"))
        entries.append((c, {"_const": empty | same, "value": F.when(same, F.get(F.col(f"_v{i}"), F.lit(0))["item"])}))
    return melt(agg, list(group), entries).filter(F.col("_const")).select(*group, "column", "value")


def multiplicity(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Rows vs distinct key combinations per group.

    ``distinct_keys`` counts null as a value; ``duplicated_keys`` are keys
    seen more than once; ``excess_rows`` = rows - distinct_keys.
    """
    per_key = df.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("_m"))
    zero = F.lit(0).cast("long")
    return per_key.groupBy(*group).agg(
        F.coalesce(F.sum("_m"), zero).alias("total_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count_if(F.col("_m") > 1).alias("duplicated_keys"),
        F.coalesce(F.sum(F.col("_m") - 1), zero).alias("excess_rows"),
    )


def multiplicity_histogram(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """How many keys occur once, twice, ...: (group, copies, keys)."""
    per_key = df.groupBy(*group, *keys).agg(F.count(F.lit(1)).alias("copies"))
    return per_key.groupBy(*group, "copies").agg(F.count(F.lit(1)).alias("keys"))


def approx_distinct(df: DataFrame, column: str, group: Sequence[str] = (), rsd: float = 0.016) -> DataFrame:
    """Total rows and HyperLogLog++ distinct estimate of one column."""
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.approx_count_distinct(column, rsd).alias("approx_unique"),
    ).withColumn("approx_pct", share_pct("approx_unique", "total_rows"))


def distinct_values(df: DataFrame, columns: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Distinct (column, value) pairs of several columns, unpivoted."""
    return values_long(df, columns, group).distinct()


def text_variants(df: DataFrame, column: str, group: Sequence[str] = ()) -> DataFrame:
    """Raw spellings that collapse to one text after trailing-period normalisation.

    Counts per raw text first (partial aggregation), then keeps normalised
    texts with more than one raw form, by a window over the few spellings of
    one text. ``pct`` is against all rows of the group; the totals use the
    count shuffle again, so the input is read once.
    """
    raw = df.groupBy(*group, column).agg(F.count(F.lit(1)).alias("count")).withColumn("normalized", strip_trailing_period(column))
    forms = F.count(F.lit(1)).over(Window.partitionBy(*group, "normalized"))
    several = raw.withColumn("_forms", forms).filter(F.col("_forms") > 1).drop("_forms")
    totals = raw.groupBy(*group).agg(F.sum("count").alias("_rows"))
    out = join_on(several, totals, list(group))
    return out.select(*group, "normalized", F.col(column).alias("raw"), "count", share_pct("count", "_rows").alias("pct"))


def truncation_flags(df: DataFrame, limits: Mapping[str, int], group: Sequence[str] = ()) -> DataFrame:
    """Rows whose text length reached a storage ceiling, per column."""
    cols = [c for c in limits if c in df.columns]
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.max(F.length(c)).alias(f"_x{i}"), F.count_if(at_length_limit(c, limits[c])).alias(f"_r{i}")]
    agg = df.groupBy(*group).agg(*aggs)
    entries = [(c, {"limit": F.lit(limits[c]), "len_max": F.col(f"_x{i}"), "rows_at_limit": F.col(f"_r{i}")}) for i, c in enumerate(cols)]
    return melt(agg, list(group), entries)
