"""Named queries: each a short composition of the generic operators.

Every query takes ``(spark, sf_dir)``, reads the driver's tables (the raw
SoR records are derived from ``lineitem``, see ``sources.fixture``) and
returns a lazy DataFrame whose column names match the DuckDB oracle text in
``plans.oracle``. Nothing here collects.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import columns as C
from ..functions import filters as P
from ..operators import compare, copies, frequent, funnel, harmonize, order, overlap, profile, shares, sketches
from ..operators.joins import join_on
from ..session import stage_root
from ..sources import archives, dims, footer_stats, parts, staging, zip_source
from .. import sinks
from ..sources.fixture import sor_raw
from . import prep

Query = Callable[[SparkSession, str], DataFrame]

# ---------------------------------------------------------------------------
# Inputs
# ---------------------------------------------------------------------------


def raw(spark: SparkSession, sf: str) -> DataFrame:
    """Raw records, with ``platform`` = normalised platform name (the per-file label)."""
    return sor_raw(spark, sf).withColumn("platform", C.normalize_values("platform_name"))


def working(spark: SparkSession, sf: str, normalize: bool = True) -> DataFrame:
    return prep.working_dataset(sor_raw(spark, sf), normalize_platform=normalize)


def v1(spark: SparkSession, sf: str) -> DataFrame:
    return prep.v1_dataset(working(spark, sf, normalize=False))


def v1_all(spark: SparkSession, sf: str) -> DataFrame:
    return prep.v1_unfiltered(working(spark, sf, normalize=False))


PROFILE_RAW_COLUMNS = S.KEEP_COLUMNS + ["content_date", "decision_facts", "decision_monetary", "score"]

# ---------------------------------------------------------------------------
# Analyses (category, automation, visibility, intensity, deviation)
# ---------------------------------------------------------------------------


def v1_as_written(spark: SparkSession, sf: str) -> DataFrame:
    """Parity preset: the study's literal exclusion list (unprefixed, so it only
    drops null categories) and the raw platform spelling."""
    return prep.analysed_dataset(working(spark, sf, normalize=False), "v1", S.BLEED_AS_WRITTEN, normalize_platform=False)


def category_distribution_of(df: DataFrame) -> DataFrame:
    return order.sort_by(shares.group_share(df, ["category"], within=["platform_name"]), ["platform_name", ("count", "desc")])


def top_category_of(df: DataFrame) -> DataFrame:
    dist = shares.group_share(df, ["category"], within=["platform_name"])
    top = shares.top_per_group(dist, ["platform_name"], "category", "count", carry=["pct"], value_alias="top_category", carry_alias=["top_pct"])
    return order.sort_by(top, ["platform_name"])


def automation_overall_of(df: DataFrame) -> DataFrame:
    out = shares.conditional_share(df, ["platform_name"], P.equals("automated_decision", S.FULLY_AUTOMATED))
    out = out.select("platform_name", F.lit(S.FULLY_AUTOMATED).alias("automated_decision"), "count", "pct")
    return order.sort_by(out, ["platform_name"])


def automation_by_category_of(df: DataFrame) -> DataFrame:
    out = shares.conditional_share(df, ["platform_name", "category"], P.equals("automated_decision", S.FULLY_AUTOMATED))
    out = out.select("platform_name", "category", F.lit(S.FULLY_AUTOMATED).alias("automated_decision"), "count", "pct")
    return order.sort_by(out, ["platform_name", ("pct", "desc")])


def deviation_automation_of(df: DataFrame) -> DataFrame:
    df = df.filter(P.month_range("application_date", S.JAN, S.FEB)).withColumn("month", C.month_text("application_date"))
    auto = shares.conditional_share(df, ["platform_name", "month"], P.equals("automated_decision", S.FULLY_AUTOMATED), pct_col="auto_pct")
    return order.sort_by(compare.compare_periods(auto, ["platform_name"], "month", S.JAN, S.FEB, "auto_pct"), ["platform_name"])


def category_distribution(spark, sf):
    return category_distribution_of(v1(spark, sf))


def category_distribution_as_written(spark, sf):
    return category_distribution_of(v1_as_written(spark, sf))


def top_category(spark, sf):
    return top_category_of(v1(spark, sf))


def top_category_as_written(spark, sf):
    return top_category_of(v1_as_written(spark, sf))


def automation_overall(spark, sf):
    return automation_overall_of(v1(spark, sf))


def automation_overall_as_written(spark, sf):
    return automation_overall_of(v1_as_written(spark, sf))


def automation_by_category(spark, sf):
    return automation_by_category_of(v1(spark, sf))


def automation_by_category_as_written(spark, sf):
    return automation_by_category_of(v1_as_written(spark, sf))


def _visibility_counts(spark, sf):
    return shares.count_by(v1_all(spark, sf), ["platform_name", "decision_visibility"])


def visibility_distribution(spark, sf):
    out = shares.share_of_counts(_visibility_counts(spark, sf), ["platform_name"])
    return order.sort_by(out, ["platform_name", ("count", "desc")])


def other_share_from_counts(counts: DataFrame) -> DataFrame:
    """Post-aggregation half: share of the OTHER class among non-null visibility counts.

    A text containing the OTHER code (mixed arrays included) is OTHER, the
    rest SPECIFIC; the share is one weighted conditional aggregate of the
    counts, so the count shuffle is not computed twice.
    """
    counts = counts.filter(F.col("decision_visibility").isNotNull())
    is_other = C.contains_class("decision_visibility", S.VISIBILITY_OTHER, "OTHER", "SPECIFIC") == F.lit("OTHER")
    out = shares.conditional_share(counts, ["platform_name"], is_other, weight="count")
    return out.select("platform_name", F.lit("OTHER").alias("visibility_class"), "count", "pct")


def visibility_other_share(spark, sf):
    return order.sort_by(other_share_from_counts(_visibility_counts(spark, sf)), ["platform_name"])


def monthly_intensity(spark, sf):
    df = v1_all(spark, sf).withColumn("month", C.month_text("application_date"))
    counts = shares.count_by(df, ["platform_name", "month"], "raw_count")
    out = compare.rate_per_million(counts, dims.recipients(spark), ["platform_name", "month"])
    return order.sort_by(out.select("platform_name", "month", "raw_count", "amar", "intensity_rate"), ["platform_name", "month"])


def deviation_intensity(spark, sf):
    out = compare.compare_periods(monthly_intensity(spark, sf), ["platform_name"], "month", S.JAN, S.FEB, "intensity_rate")
    return order.sort_by(out, ["platform_name"])


def deviation_automation(spark, sf):
    return deviation_automation_of(v1(spark, sf))


def deviation_automation_as_written(spark, sf):
    return deviation_automation_of(v1_as_written(spark, sf))


# ---------------------------------------------------------------------------
# Preparation path
# ---------------------------------------------------------------------------


def v1_dataset(spark, sf):
    return v1(spark, sf).select(*S.WORKING_COLUMNS)


def working_dataset(spark, sf):
    return working(spark, sf, normalize=False).select(*S.WORKING_COLUMNS)


def working_preview(spark, sf):
    """First 5 working records per platform, in (date, uuid) order (the notebooks' head)."""
    return order.head_per_group(working(spark, sf, normalize=False), 5, ["platform_name"], ["application_date", "uuid"])


def filter_funnel(spark, sf):
    return funnel.funnel(raw(spark, sf), prep.funnel_steps(), ["platform"]).withColumnRenamed("platform", "platform_name")


def version_split(spark, sf):
    return shares.group_share(working(spark, sf), ["api_version"], within=["platform_name"])


def monthly_row_counts(spark, sf):
    df = working(spark, sf).select(F.col("platform_name").alias("platform"), C.month_start("application_date").alias("month"))
    return order.sort_by(shares.count_by(df, ["platform", "month"], "row_count"), ["platform", "month"])


def date_range(spark, sf):
    return funnel.date_range(working(spark, sf), "application_date", ["platform_name"])


def content_date_agreement(spark, sf):
    df = raw(spark, sf).select(
        F.col("platform").alias("label"),
        "territorial_scope",
        F.to_date("application_date").alias("application_date"),
        F.to_date("content_date").alias("content_date"),
    )
    df = df.filter(P.scope_contains("territorial_scope") & P.date_between("application_date"))
    return funnel.agreement_counts(df, "content_date", "application_date", ["label"])


def midnight_check(spark, sf):
    return funnel.midnight_check(working(spark, sf), "application_date", ["platform_name"])


def platform_ratio(spark, sf):
    return funnel.ratio_between(working(spark, sf), "platform_name", "TikTok", "X")


# ---------------------------------------------------------------------------
# Screening and profiling
# ---------------------------------------------------------------------------


def screening_profile(spark, sf):
    return profile.profile(raw(spark, sf), PROFILE_RAW_COLUMNS, ["platform"], exact=True)


def screening_profile_approx(spark, sf):
    """The study's screening: HyperLogLog distincts over the working records per platform."""
    return profile.profile(working(spark, sf), S.WORKING_COLUMNS, ["platform_name"], exact=False, rsd=S.HLL_RSD)


def screening_profile_working(spark, sf):
    """The same screening of the working records with exact distinct counts."""
    return profile.profile(working(spark, sf), S.WORKING_COLUMNS, ["platform_name"], exact=True)


def null_report(spark, sf):
    return profile.null_report(working(spark, sf), S.WORKING_COLUMNS, ["platform_name"])


def uuid_uniqueness(spark, sf):
    # Single-pass exact count: for a 36-byte key the hash-first variant
    # (profile.multiplicity_by_hash) saves about as much shuffle as its second
    # scan costs; it pays off for wide keys such as whole texts.
    m = profile.multiplicity(working(spark, sf), ["uuid"], ["platform_name"])
    return m.select(
        "platform_name",
        "total_rows",
        F.col("distinct_keys").alias("unique_uuids"),
        F.col("duplicated_keys").alias("duplicated_uuids"),
        "excess_rows",
        C.share_pct("distinct_keys", "total_rows").alias("unique_pct"),
    )


def uuid_uniqueness_approx(spark, sf):
    """Whether the estimated number of uuids lies within three standard errors of the exact one."""
    df = working(spark, sf)
    estimate = profile.approx_distinct(df, "uuid", ["platform_name"], S.HLL_RSD)
    exact = profile.multiplicity(df, ["uuid"], ["platform_name"]).select("platform_name", F.col("distinct_keys").alias("unique_uuids"))
    close = F.abs(F.col("approx_unique") - F.col("unique_uuids")) <= F.greatest(F.lit(1.0), 3 * F.lit(S.HLL_RSD) * F.col("unique_uuids"))
    return join_on(estimate, exact, ["platform_name"]).select("platform_name", "total_rows", "unique_uuids", close.alias("estimate_within_bounds"))


def uuid_multiplicity(spark, sf):
    return profile.multiplicity_histogram(working(spark, sf), ["uuid"], ["platform_name"])


def duplicate_rows(spark, sf):
    m = profile.multiplicity(working(spark, sf, normalize=False), S.WORKING_COLUMNS)
    return m.select("total_rows", F.col("distinct_keys").alias("distinct_rows"), F.col("excess_rows").alias("duplicate_rows"))


def uuid_multiplicity_filtered(spark, sf):
    """Copies per uuid; only uuids that may repeat are shuffled (two-level filter)."""
    return copies.multiplicity_histogram(working(spark, sf), ["uuid"], ["platform_name"])


def duplicate_rows_filtered(spark, sf):
    """Whole-row duplicates; only rows that may repeat are shuffled (two-level filter)."""
    m = copies.multiplicity(working(spark, sf, normalize=False), S.WORKING_COLUMNS)
    return m.select("total_rows", F.col("distinct_keys").alias("distinct_rows"), F.col("excess_rows").alias("duplicate_rows"))


def topn_values_summaries(spark, sf):
    """Top values per column from heavy-hitter summaries, recounted exactly."""
    df = raw(spark, sf)
    return frequent.top_values(df, profile.string_columns(df, ["platform"]), 10, ["platform"])


def low_cardinality_values(spark, sf):
    return profile.distinct_values(working(spark, sf), S.LOW_CARDINALITY_COLUMNS, ["platform_name"])


def topn_values(spark, sf):
    df = raw(spark, sf)
    return profile.top_values(df, profile.string_columns(df, ["platform"]), 10, ["platform"])


def string_stats(spark, sf):
    df = raw(spark, sf)
    return profile.string_stats(df, profile.string_columns(df, ["platform"]), ["platform"])


def string_anomalies(spark, sf):
    """Only columns that have text, and only those with padded values."""
    return string_stats(spark, sf).filter((F.col("len_max") > 0) & (F.col("whitespace_anomaly_count") > 0))


def column_missing(spark, sf):
    return profile.column_missing(raw(spark, sf), PROFILE_RAW_COLUMNS, ["platform"])


def empty_in_both(spark, sf):
    miss = column_missing(spark, sf)
    return (
        miss.groupBy("column")
        .agg(F.count_if(F.col("severity") == "empty").alias("_empty"), F.count(F.lit(1)).alias("_platforms"))
        .filter((F.col("_empty") == F.col("_platforms")) & (F.col("_platforms") >= 2))
        .select("column")
    )


def constant_columns(spark, sf):
    return profile.constant_columns(raw(spark, sf), PROFILE_RAW_COLUMNS, ["platform"])


def column_cardinality(spark, sf):
    return profile.distinct_counts(raw(spark, sf), PROFILE_RAW_COLUMNS, ["platform"])


def text_variants(spark, sf):
    return profile.text_variants(raw(spark, sf), "decision_facts", ["platform"])


def truncation_flags(spark, sf):
    # The derived raw record has no long text, so the explanations' ceiling is
    # applied to the texts of documents, of which many reach it.
    return profile.truncation_flags(_table(spark, sf, "documents"), {"text": max(S.TRUNCATION_LIMITS.values())}, ["lang"])


def _scope_counts(spark, sf):
    # Aggregate on the raw text first (about 159 k distinct scope strings at
    # full scale against ~1e9 rows), parse JSON only on the aggregated rows.
    return shares.count_by(working(spark, sf), ["platform_name", "territorial_scope"], "_n")


def scope_arity(spark, sf):
    per_arity = _scope_counts(spark, sf).groupBy("platform_name", C.array_arity("territorial_scope").alias("n_countries")).agg(F.sum("_n").alias("count"))
    return shares.share_of_counts(per_arity, ["platform_name"])


def scope_country_counts(spark, sf):
    exploded = _scope_counts(spark, sf).select("platform_name", F.explode(C.json_array("territorial_scope")).alias("country"), "_n")
    return exploded.groupBy("platform_name", "country").agg(F.sum("_n").alias("count"))


# ---------------------------------------------------------------------------
# Harmonisation
# ---------------------------------------------------------------------------


def _category_counts(spark, sf):
    return shares.count_by(working(spark, sf), ["platform_name", "category", "api_version"])


def category_counts(spark, sf):
    return order.sort_by(_category_counts(spark, sf), ["platform_name", "category", ("count", "desc")])


def category_cardinality(spark, sf):
    return _category_counts(spark, sf).groupBy("platform_name", "api_version").agg(F.count(F.lit(1)).alias("unique_categories"))


def category_version_overlap(spark, sf):
    return overlap.set_overlap(working(spark, sf), "category", "api_version", "v1", "v2", ["platform_name"])


def category_version_overlap_pooled(spark, sf):
    return overlap.set_overlap(working(spark, sf), "category", "api_version", "v1", "v2")


def category_platform_overlap(spark, sf):
    return overlap.set_overlap(working(spark, sf), "category", "platform_name", "TikTok", "X", a_label="tiktok_only", b_label="x_only")


def harmonized(spark, sf):
    return harmonize.harmonize(working(spark, sf, normalize=False), dims.mapping(spark))


def harmonized_dataset(spark, sf):
    return harmonized(spark, sf).select(*S.HARMONIZED_COLUMNS)


def supercluster_breakdown(spark, sf):
    mapped = harmonize.map_counts(_category_counts(spark, sf), dims.mapping(spark))
    out = mapped.groupBy("platform_name", "super_cluster", "api_version").agg(F.sum("count").alias("total_records"))
    return order.sort_by(out, ["platform_name", "super_cluster", "api_version"])


def harmonized_distribution(spark, sf):
    df = harmonized(spark, sf).withColumn("platform_name", C.normalize_values("platform_name"))
    return order.sort_by(shares.count_by(df, ["platform_name", "category_harmonized"]), ["platform_name", ("count", "desc")])


def mapping_comparison(spark, sf):
    out = overlap.presence_mask(
        dims.mapping(spark),
        working(spark, sf),
        "original_category",
        "category",
        "platform_name",
        [("TikTok", "tiktok_original_category"), ("X", "x_original_category")],
    )
    return out.select("api_version", "mapping_type", "tiktok_original_category", "super_cluster", "x_original_category")


def category_documentation(spark, sf):
    counts = shares.count_by(working(spark, sf).filter(P.equals("api_version", "v1")), ["platform_name", "category"], "record_count")
    shared = shares.share_of_counts(counts, ["platform_name"], "record_count", "share_pct")
    mapped = harmonize.map_counts(shared, dims.mapping(spark))
    return mapped.select("platform_name", F.col("category").alias("category_raw"), "super_cluster", "record_count", F.round("share_pct", 4).alias("share_pct"))


def version_anomalies(spark, sf):
    return harmonize.lookup_counts(working(spark, sf), S.VERSION_ANOMALIES, ["platform_name"])


def reconciliation(spark, sf):
    """Row-count reconciliation per platform: versions add up, harmonisation keeps
    every row, unmapped rows counted (the study's validation by counts). Both
    sides come from one count per (platform, category, version)."""
    counts = shares.count_by(working(spark, sf, normalize=False), ["platform_name", "category", "api_version"])
    inp = counts.groupBy("platform_name").agg(F.sum("count").alias("input_rows"))
    h = harmonize.map_counts(counts, dims.mapping(spark)).groupBy("platform_name").agg(
        F.sum("count").alias("harmonized_rows"),
        *[F.coalesce(F.sum(F.when(F.col("api_version") == v, F.col("count"))), F.lit(0).cast("long")).alias(f"{v}_rows") for v in ("v1", "v2")],
        F.coalesce(F.sum(F.when(F.col("super_cluster").isNull(), F.col("count"))), F.lit(0).cast("long")).alias("unmapped_rows"),
    )
    out = join_on(inp, h, ["platform_name"], "full")
    return out.select(
        "platform_name",
        "input_rows",
        "harmonized_rows",
        "v1_rows",
        "v2_rows",
        ((F.col("v1_rows") + F.col("v2_rows")) == F.col("input_rows")).alias("versions_add_up"),
        (F.col("harmonized_rows") == F.col("input_rows")).alias("rows_preserved"),
        "unmapped_rows",
    )


def unmapped_categories(spark, sf):
    counts = shares.count_by(working(spark, sf), ["platform_name", "category"])
    return overlap.unmapped(counts, dims.mapping(spark), "category")


# ---------------------------------------------------------------------------
# The same operators on the driver's other tables (they take column names)
# ---------------------------------------------------------------------------


def _table(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_status_share(spark, sf):
    out = shares.group_share(_table(spark, sf, "orders"), ["o_orderstatus"], within=["o_orderpriority"])
    return order.sort_by(out, ["o_orderpriority", ("count", "desc")])


def orders_monthly_counts(spark, sf):
    df = _table(spark, sf, "orders").select("o_orderstatus", C.month_start("o_orderdate").alias("month"))
    return order.sort_by(shares.count_by(df, ["o_orderstatus", "month"], "row_count"), ["o_orderstatus", "month"])


def events_type_share_by_day(spark, sf):
    df = _table(spark, sf, "events").select(F.to_date("ts").alias("day"), "event_type")
    return shares.group_share(df, ["event_type"], within=["day"])


def events_user_multiplicity(spark, sf):
    return profile.multiplicity(_table(spark, sf, "events"), ["user_id"], ["event_type"])


def events_cardinality(spark, sf):
    df = _table(spark, sf, "events")
    return profile.distinct_counts(df, ["event_id", "ts", "user_id", "event_type", "value", "props"])


def documents_text_stats(spark, sf):
    return profile.string_stats(_table(spark, sf, "documents"), ["text"], ["lang"])


def documents_duplicate_texts(spark, sf):
    """Exact duplicate whole texts per language."""
    return profile.multiplicity(_table(spark, sf, "documents"), ["text"], ["lang"])


def documents_duplicate_texts_filtered(spark, sf):
    """Exact duplicate whole texts per language; texts that surely occur once aren't shuffled."""
    return copies.multiplicity(_table(spark, sf, "documents"), ["text"], ["lang"])


def documents_lang_share(spark, sf):
    return order.sort_by(shares.group_share(_table(spark, sf, "documents"), ["lang"]), [("count", "desc")])


def documents_missing(spark, sf):
    return profile.column_missing(_table(spark, sf, "documents"), ["doc_id", "text", "lang", "n_chars"], ["source"])


# ---------------------------------------------------------------------------
# File-level sources (daily part tree and nested archives derived from the tables)
# ---------------------------------------------------------------------------

# Lower-case platform token in file names -> platform label.
CLUSTERED_CATEGORY = "STATEMENT_CATEGORY_CYBER_VIOLENCE"
FILE_PLATFORM_LABELS = {"tiktok": "TikTok", "x": "X"}


def _part_listing(spark, sf):
    root = staging.staged_daily_tree(spark, sf)
    listing = parts.list_files(spark, root).filter(F.col("path").rlike(r"part-[^/]*\.parquet$"))
    return listing.withColumn("platform", C.normalize_values("platform", FILE_PLATFORM_LABELS)), root


def _below(path, root):
    """``path`` without the folder that the stage lies in."""
    return F.regexp_replace(path, r"^.*/" + root.rsplit("/", 1)[1] + r"(-reduced)?/", "")


def file_manifest(spark, sf):
    """Manifest of a reduction of the daily tree; paths are relative to its root."""
    listing, root = _part_listing(spark, sf)
    out = parts.manifest(listing, S.KEEP_COLUMNS, dst_root=f"{root}-reduced")
    return out.withColumns({c: _below(F.col(c), root) for c in ("source_file", "output_file")})


def coverage_audit(spark, sf):
    listing, _ = _part_listing(spark, sf)
    return parts.coverage_audit(listing)


def working_from_dumps(spark, sf):
    """The working records read from the daily part tree (the study's starting point)."""
    return prep.working_dataset(parts.load_parts(spark, staging.staged_daily_tree(spark, sf))).select(*S.WORKING_COLUMNS)


def category_distribution_stored(spark, sf):
    """Category distribution over a stored working table: only the v1 directories and one column are read."""
    root = staging.staged_working(spark, sf)
    return category_distribution_of(prep.v1_dataset(sinks.read_working(spark, root)))


def category_days_clustered(spark, sf):
    """Rows per platform and day of one category in two months, from the clustered table: other categories' row groups and pages are skipped."""
    rows = sinks.read_working(spark, staging.staged_working_clustered(spark, sf))
    rows = rows.filter(P.equals("category", CLUSTERED_CATEGORY) & P.month_range("application_date", S.JAN, S.FEB))
    rows = rows.withColumns({"platform_name": C.normalize_values("platform_name"), "day": F.to_date("application_date")})
    return shares.count_by(rows, ["platform_name", "day"])


def reduced_parts(spark, sf):
    """The kept columns of the reduced tree, part by part."""
    return spark.read.parquet(staging.staged_reduced_tree(spark, sf)).select(*S.KEEP_COLUMNS)


def platform_tables(spark, sf):
    """Categories over one stored table per platform, tagged and unioned; a platform without a table is left out."""
    root = staging.staged_platform_tables(spark, sf)
    tables = {"TikTok": f"{root}/tiktok", "X": f"{root}/x", "Z": f"{root}/z"}  # there is no table of platform Z
    rows = parts.load_platform_tables(spark, tables, ["category", "api_version"], missing="skip")
    return shares.count_by(rows, ["platform_name", "category"])


def february_dumps(spark, sf):
    """Rows per platform and dump day of one month, read by day prefix: other days' folders aren't listed."""
    root = staging.staged_daily_tree(spark, sf)
    month = [parts.load_parts(spark, root, day_prefix=f"sor-{p}-2025-02", missing="skip") for p in FILE_PLATFORM_LABELS]
    rows = overlap.union_all(month)
    return shares.count_by(rows.withColumn("platform", parts.platform_of(F.col("source_file"))), ["platform", "dump_day"])


def footer_row_counts(spark, sf):
    """Rows per platform and dump day from the parts' footers; no data page is read (A1)."""
    listing, _ = _part_listing(spark, sf)
    return parts.footers(listing).groupBy("platform", F.col("day").alias("dump_day")).agg(F.sum("footer_rows").alias("row_count"))


def footer_date_range(spark, sf):
    """Earliest and latest application date per platform of the dumps, from the parts' row-group statistics."""
    listing, _ = _part_listing(spark, sf)
    return footer_stats.date_range(listing, "application_date", ["platform"], S.RAW_SCHEMA["application_date"].dataType)


def part_columns(spark, sf):
    """Columns of the parts, and the rows of the parts that have them, from the footers."""
    listing, _ = _part_listing(spark, sf)
    return parts.footers(listing).select(F.explode("columns").alias("column"), "footer_rows").groupBy("column").agg(F.sum("footer_rows").alias("row_count"))


def run_metrics(spark, sf):
    """Category shares recorded as run metrics, by a run that was tried twice; read back from the metrics table."""
    path = stage_root(spark, f"run-metrics-{uuid.uuid4().hex}")
    shares_ = category_distribution_of(v1(spark, sf))
    for run, tries in (("run-1", 2), ("run-2", 1)):
        for _ in range(tries):
            sinks.record_metrics(sinks.result_metrics(shares_, ["platform_name", "category"], ["count", "pct"], "category_distribution", run, upper=True), path)
    return sinks.read_metrics(spark, path).select("run_id", "description", "metric", "value")


def uuid_uniqueness_sketched(spark, sf):
    """As ``uuid_uniqueness_approx``, the estimate merged from sketches kept per month, those of the year's second half added later."""
    path = stage_root(spark, f"uuid-sketches-{uuid.uuid4().hex}")
    df = working(spark, sf).withColumn("month", C.month_text("application_date"))
    for rows in (df.filter(F.col("month") < "2025-07"), df):
        sketches.add_periods(rows, path, "uuid", ["platform_name"], "month")
    estimate = sketches.merged_distinct(df, path, ["platform_name"], "month")
    exact = profile.multiplicity(df, ["uuid"], ["platform_name"]).select("platform_name", F.col("distinct_keys").alias("unique_uuids"))
    close = F.abs(F.col("approx_unique") - F.col("unique_uuids")) <= F.greatest(F.lit(1.0), 3 * F.lit(S.HLL_RSD) * F.col("unique_uuids"))
    return join_on(estimate, exact, ["platform_name"]).select("platform_name", "total_rows", "unique_uuids", close.alias("estimate_within_bounds"))


def replaced_orders(spark, sf):
    """Orders per status in two versions of a table, the second made from the first and put in its place."""
    path = stage_root(spark, f"orders-versions-{uuid.uuid4().hex}")
    first = sinks.replace_version(spark, _table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), path)
    second = sinks.replace_version(spark, sinks.read_version(spark, path).filter("o_orderstatus != 'O'"), path, read=first)
    kept = [sinks.read_version(spark, path, v).withColumn("version", F.lit(v)) for v in (first, second)]
    return shares.count_by(overlap.union_all(kept), ["version", "o_orderstatus"])


def supercluster_from_csv_mapping(spark, sf):
    """Super-cluster totals with the mapping read from a typed CSV file."""
    mapping = dims.read_mapping_csv(spark, staging.staged_mapping_csv(spark, sf))
    mapped = harmonize.map_counts(_category_counts(spark, sf), mapping)
    out = mapped.groupBy("platform_name", "super_cluster", "api_version").agg(F.sum("count").alias("total_records"))
    return order.sort_by(out, ["platform_name", "super_cluster", "api_version"])


def _archive_listing(spark, sf):
    root = staging.staged_archives(spark, sf)
    listing = archives.list_archives(spark, root)
    return listing.withColumn("platform", C.normalize_values(parts.platform_of(F.col("path")), FILE_PLATFORM_LABELS))


def file_half_sample(spark, sf):
    return parts.sample_files(_archive_listing(spark, sf), 0.5, S.SAMPLE_SEED, ["platform"]).select("platform", parts.relative_path(F.col("path")).alias("path"))


def _archive_agreement(rows):
    rows = rows.withColumn("label", C.normalize_values(parts.platform_of(F.col("archive")), FILE_PLATFORM_LABELS))
    rows = rows.filter(P.scope_contains("territorial_scope"))
    rows = archives.typed_dates(rows, ["application_date", "content_date"]).filter(P.date_between("application_date"))
    return funnel.agreement_counts(rows, "content_date", "application_date", ["label"])


def content_date_agreement_archives(spark, sf):
    """The content-date check read from nested zip archives (all archives), through the data source for them."""
    zip_source.register(spark)
    return _archive_agreement(spark.read.format(zip_source.NAME).load(staging.staged_archives(spark, sf)))


def content_date_agreement_sampled(spark, sf):
    """The study's procedure: a reproducible half of TikTok's archives, all of X's."""
    listing = _archive_listing(spark, sf)
    tiktok = parts.sample_files(listing.filter(F.col("platform") == "TikTok"), 0.5, S.SAMPLE_SEED, ["platform"])
    return _archive_agreement(archives.read_nested_zip_csv(spark, tiktok.unionByName(listing.filter(F.col("platform") != "TikTok"))))


# ---------------------------------------------------------------------------
# Registry
# ---------------------------------------------------------------------------

QUERIES: dict[str, Query] = {
    "category_distribution": category_distribution,
    "category_distribution_as_written": category_distribution_as_written,
    "top_category": top_category,
    "top_category_as_written": top_category_as_written,
    "automation_overall": automation_overall,
    "automation_overall_as_written": automation_overall_as_written,
    "automation_by_category": automation_by_category,
    "automation_by_category_as_written": automation_by_category_as_written,
    "visibility_distribution": visibility_distribution,
    "visibility_other_share": visibility_other_share,
    "monthly_intensity": monthly_intensity,
    "deviation_intensity": deviation_intensity,
    "deviation_automation": deviation_automation,
    "deviation_automation_as_written": deviation_automation_as_written,
    "v1_dataset": v1_dataset,
    "working_dataset": working_dataset,
    "working_preview": working_preview,
    "filter_funnel": filter_funnel,
    "version_split": version_split,
    "monthly_row_counts": monthly_row_counts,
    "date_range": date_range,
    "content_date_agreement": content_date_agreement,
    "midnight_check": midnight_check,
    "platform_ratio": platform_ratio,
    "screening_profile": screening_profile,
    "screening_profile_approx": screening_profile_approx,
    "screening_profile_working": screening_profile_working,
    "null_report": null_report,
    "uuid_uniqueness": uuid_uniqueness,
    "uuid_uniqueness_approx": uuid_uniqueness_approx,
    "uuid_multiplicity": uuid_multiplicity,
    "duplicate_rows": duplicate_rows,
    "low_cardinality_values": low_cardinality_values,
    "topn_values": topn_values,
    "string_stats": string_stats,
    "string_anomalies": string_anomalies,
    "column_missing": column_missing,
    "empty_in_both": empty_in_both,
    "constant_columns": constant_columns,
    "column_cardinality": column_cardinality,
    "text_variants": text_variants,
    "truncation_flags": truncation_flags,
    "scope_arity": scope_arity,
    "scope_country_counts": scope_country_counts,
    "category_counts": category_counts,
    "category_cardinality": category_cardinality,
    "category_version_overlap": category_version_overlap,
    "category_version_overlap_pooled": category_version_overlap_pooled,
    "category_platform_overlap": category_platform_overlap,
    "harmonized_dataset": harmonized_dataset,
    "supercluster_breakdown": supercluster_breakdown,
    "harmonized_distribution": harmonized_distribution,
    "mapping_comparison": mapping_comparison,
    "category_documentation": category_documentation,
    "version_anomalies": version_anomalies,
    "unmapped_categories": unmapped_categories,
    "reconciliation": reconciliation,
    "orders_status_share": orders_status_share,
    "orders_monthly_counts": orders_monthly_counts,
    "events_type_share_by_day": events_type_share_by_day,
    "events_user_multiplicity": events_user_multiplicity,
    "events_cardinality": events_cardinality,
    "documents_text_stats": documents_text_stats,
    "documents_missing": documents_missing,
    "documents_duplicate_texts": documents_duplicate_texts,
    "documents_lang_share": documents_lang_share,
    "working_from_dumps": working_from_dumps,
    "category_distribution_stored": category_distribution_stored,
    "category_days_clustered": category_days_clustered,
    "reduced_parts": reduced_parts,
    "platform_tables": platform_tables,
    "february_dumps": february_dumps,
    "footer_row_counts": footer_row_counts,
    "footer_date_range": footer_date_range,
    "part_columns": part_columns,
    "uuid_multiplicity_filtered": uuid_multiplicity_filtered,
    "duplicate_rows_filtered": duplicate_rows_filtered,
    "documents_duplicate_texts_filtered": documents_duplicate_texts_filtered,
    "topn_values_summaries": topn_values_summaries,
    "uuid_uniqueness_sketched": uuid_uniqueness_sketched,
    "replaced_orders": replaced_orders,
    "run_metrics": run_metrics,
    "supercluster_from_csv_mapping": supercluster_from_csv_mapping,
    "file_manifest": file_manifest,
    "coverage_audit": coverage_audit,
    "file_half_sample": file_half_sample,
    "content_date_agreement_archives": content_date_agreement_archives,
    "content_date_agreement_sampled": content_date_agreement_sampled,
}

# Queries whose result is an estimate: no value oracle.
NO_ORACLE = {"screening_profile_approx"}
