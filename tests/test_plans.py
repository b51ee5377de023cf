"""Physical-plan properties: pushdown, pruning, broadcast of fixed
dimensions, no cartesian products, no Python in analysis plans, bounded
top-N windows."""

import pytest

import __spark_entry__ as E
from sf_paths import SF_SMALL
from moderata import sinks
from moderata import schemas as S
from moderata.functions import filters as P
from moderata.operators import shares
from moderata.plans import prep
from moderata.plans import queries as Q
from moderata.sources.fixture import sor_raw


def plan(df, mode="formatted"):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stored")
    raw_path = str(root / "raw")
    work_path = str(root / "working")
    sor_raw(spark, SF_SMALL).write.parquet(raw_path)
    sinks.write_working(prep.working_dataset(sor_raw(spark, SF_SMALL)), work_path)
    return raw_path, work_path


def test_raw_predicates_reach_the_scan(spark, stored):
    raw_path, _ = stored
    df = prep.working_dataset(spark.read.parquet(raw_path))
    p = plan(df)
    assert "StringContains(territorial_scope,DE)" in p
    assert "GreaterThanOrEqual(application_date,2025-01-01T00:00)" in p
    assert "LessThan(application_date,2026-01-01T00:00)" in p
    # 9 kept columns only: no decision_facts / score in the read schema
    assert "decision_facts" not in p.split("ReadSchema")[1].split("\n")[0]


def test_working_table_partition_pruning_and_pushdown(spark, stored):
    _, work_path = stored
    df = prep.v1_dataset(sinks.read_working(spark, work_path))
    out = shares.group_share(df, ["category"], ["platform_name"])
    p = plan(out)
    assert "PartitionFilters: [isnotnull(api_version" in p and "(api_version#" in p and "= v1)" in p
    assert "Not(In(category, [" in p
    read_schema = [line for line in p.splitlines() if line.startswith("ReadSchema")]
    assert read_schema and all(line == "ReadSchema: struct<category:string>" for line in read_schema), read_schema


def test_month_filter_is_a_range(spark, stored):
    _, work_path = stored
    df = sinks.read_working(spark, work_path).filter(P.month_range("application_date", S.JAN, S.FEB))
    p = plan(df)
    assert "GreaterThanOrEqual(application_date,2025-01-01T00:00)" in p
    assert "LessThan(application_date,2025-03-01T00:00)" in p


def test_stored_table_gives_same_answer(spark, stored):
    _, work_path = stored
    a = shares.group_share(prep.v1_dataset(sinks.read_working(spark, work_path)), ["category"], ["platform_name"])
    b = Q.category_distribution(spark, SF_SMALL)
    key = lambda r: (r["platform_name"], r["category"] or "", r["count"])
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))


ALL = {name: fn for name, fn in E.queries().items() if name in Q.QUERIES}


# Pack and merge a two-level filter in Arrow batches (MapInArrow), over 8-byte hashes only.
FILTERED = {"uuid_multiplicity_filtered", "duplicate_rows_filtered", "documents_duplicate_texts_filtered"}


@pytest.mark.parametrize("name", sorted(ALL))
def test_no_cartesian_no_python_in_plans(spark, name):
    p = plan(ALL[name](spark, SF_SMALL), "extended")
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython") + (() if name in FILTERED | {"footer_date_range"} else ("PythonUDF",)):
        assert bad not in p, (name, bad)


# Read files that they stage first, in several passes over listings and footers.
FILE_LEVEL = {"file_manifest", "coverage_audit", "file_half_sample", "content_date_agreement_archives", "content_date_agreement_sampled", "footer_date_range", "footer_row_counts", "part_columns"}


@pytest.mark.parametrize("name", sorted(set(ALL) - FILE_LEVEL))
def test_input_is_scanned_once(spark, name):
    """As planned on a wide input: exchanges that several branches need are reused, none reads the input again."""
    # two aggregates by different keys, whose difference is the result
    # a filter or summary pass before the count; two versions of a table, two platforms' tables; kept sketches beside the exact count
    two = FILTERED | {"uuid_uniqueness_approx", "topn_values_summaries", "uuid_uniqueness_sketched", "replaced_orders", "platform_tables", "february_dumps"}
    allowed = 2 if name in two else 1
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert 1 <= plan(Q.QUERIES[name](spark, SF_SMALL), "simple").count("FileScan parquet") <= allowed
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_stored_queries_prune_and_push(spark):
    stored = plan(ALL["category_distribution_stored"](spark, SF_SMALL))
    assert "PartitionFilters: [isnotnull(api_version" in stored and "Not(In(category, [" in stored
    dumps = plan(ALL["working_from_dumps"](spark, SF_SMALL))
    assert "StringContains(territorial_scope,DE)" in dumps and "GreaterThanOrEqual(application_date,2025-01-01T00:00)" in dumps


# Bitmaps have no hash aggregate; only the slots seen again are sorted for them.
SORT_AGG_ALLOWED: set[str] = FILTERED


@pytest.mark.parametrize("name", sorted(set(ALL) - SORT_AGG_ALLOWED))
def test_hash_aggregates_only(spark, name):
    p = plan(ALL[name](spark, SF_SMALL))
    assert "SortAggregate" not in p, name


def test_fixed_dimensions_are_broadcast(spark):
    for name in ("monthly_intensity", "harmonized_dataset", "unmapped_categories"):
        p = plan(ALL[name](spark, SF_SMALL))
        assert "BroadcastExchange" in p, name


def test_topn_window_is_limited_before_shuffle(spark):
    p = plan(ALL["topn_values"](spark, SF_SMALL), "simple")
    assert "WindowGroupLimit" in p and ", Partial" in p


def test_shares_use_no_window_over_rows(spark):
    for name in ("category_distribution", "visibility_distribution", "version_split", "automation_by_category"):
        p = plan(ALL[name](spark, SF_SMALL), "simple")
        assert "Window" not in p, name


@pytest.mark.parametrize("name", ["category_distribution", "topn_values", "text_variants", "scope_arity", "visibility_other_share"])
def test_share_totals_reuse_the_count_exchange(spark, name):
    """The totals re-derive the counts in the logical plan; at run time the
    count shuffle is reused, so the input is scanned once."""
    df = ALL[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1, final
    if name != "visibility_other_share":  # that one is a single weighted aggregate, no join
        assert "ReusedExchange" in final


@pytest.mark.parametrize("name", ["category_distribution", "automation_by_category", "monthly_intensity", "filter_funnel", "harmonized_dataset"])
def test_executed_plans_use_whole_stage_codegen(spark, name):
    df = ALL[name](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "*(" in final, final  # WholeStageCodegen stages
    aggregates = [line for line in final.splitlines() if "HashAggregate(" in line]
    assert all("*(" in line for line in aggregates), aggregates
