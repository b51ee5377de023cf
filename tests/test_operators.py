"""Operator semantics on small hand-built frames: invariants and edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moderata import schemas as S
from moderata.functions import columns as C
from moderata.functions import filters as P
from moderata.operators import compare, funnel, harmonize, overlap, profile, shares
from moderata.plans import prep
from moderata.sources import dims


def _key(t):
    return tuple((v is not None, v) for v in t)


def srt(items):
    return sorted(items, key=_key)


def rows(df, *cols):
    cols = cols or df.columns
    return srt(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def small(spark):
    schema = "platform_name string, category string, automated_decision string, v double"
    data = [
        ("A", "c1", "FULLY", 1.0),
        ("A", "c1", "NO", 2.0),
        ("A", "c2", "FULLY", 3.0),
        ("A", None, "FULLY", 4.0),
        ("B", "c1", "NO", 5.0),
        ("B", "c2", "NO", 6.0),
        ("B", "c2", None, None),
    ]
    return spark.createDataFrame(data, schema)


def test_group_share_sums_to_100(small):
    out = shares.group_share(small, ["category"], within=["platform_name"])
    by_p = {r["platform_name"]: r["s"] for r in out.groupBy("platform_name").agg(F.sum("pct").alias("s")).collect()}
    assert by_p == pytest.approx({"A": 100.0, "B": 100.0})
    # the null category is its own group
    assert ("A", None, 1) in rows(out, "platform_name", "category", "count")


def test_group_share_global(small):
    out = shares.group_share(small, ["platform_name"])
    assert rows(out, "platform_name", "count") == [("A", 4), ("B", 3)]
    assert sum(r["pct"] for r in out.collect()) == pytest.approx(100.0)


def test_share_keep_filters_after_total(small):
    out = shares.group_share(small, ["automated_decision"], ["platform_name"], keep=F.col("automated_decision") == "FULLY")
    assert rows(out, "platform_name", "count", "pct") == [("A", 3, 75.0)]


def test_conditional_share_equals_count_share_filter(small):
    pred = F.col("automated_decision") == "FULLY"
    a = shares.conditional_share(small, ["platform_name"], pred)
    b = shares.group_share(small, ["automated_decision"], ["platform_name"], keep=F.col("automated_decision") == "FULLY")
    assert rows(a, "platform_name", "count", "pct") == rows(b, "platform_name", "count", "pct")
    # groups without a match vanish unless keep_zero
    z = shares.conditional_share(small, ["platform_name"], pred, keep_zero=True, total_col="total")
    assert rows(z, "platform_name", "count", "total") == [("A", 3, 4), ("B", 0, 3)]


def test_share_zero_total_is_zero(spark):
    df = spark.createDataFrame([("A", 0), ("A", 0)], "g string, count long")
    out = shares.share_of_counts(df, ["g"])
    assert [r["pct"] for r in out.collect()] == [0.0, 0.0]


def test_top_per_group_tie_goes_to_smallest_value(spark):
    df = spark.createDataFrame([("A", "b", 5, 50.0), ("A", "a", 5, 50.0), ("B", "z", 1, 100.0)], "p string, c string, count long, pct double")
    out = shares.top_per_group(df, ["p"], "c", "count", carry=["pct"], value_alias="top", carry_alias=["top_pct"])
    assert rows(out, "p", "top", "top_pct") == [("A", "a", 50.0), ("B", "z", 100.0)]


def test_compare_periods_inner_semantics(spark):
    df = spark.createDataFrame(
        [("A", "2025-01", 100.0), ("A", "2025-02", 150.0), ("B", "2025-01", 10.0), ("C", "2025-02", 3.0)],
        "p string, month string, rate double",
    )
    out = compare.compare_periods(df, ["p"], "month", "2025-01", "2025-02", "rate")
    assert rows(out, "p", "jan_rate", "feb_rate", "pct_deviation") == [("A", 100.0, 150.0, 50.0)]


def test_tag_period_null_falls_to_last_label(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2025, 6, 30, 23, 59),), (dt.datetime(2025, 7, 1),), (None,)],
        T.StructType([T.StructField("d", T.TimestampNTZType())]),
    )
    got = [r[0] for r in df.select(C.tag_period("d")).collect()]
    assert got == ["v1", "v2", "v2"]
    three = [r[0] for r in df.select(C.tag_period("d", [dt.date(2025, 3, 1), dt.date(2025, 7, 1)], ["a", "b", "c"])).collect()]
    assert three == ["b", "c", "c"]


def test_date_between_inclusive_calendar_days(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2024, 12, 31, 23, 59),), (dt.datetime(2025, 1, 1),), (dt.datetime(2025, 12, 31, 10, 0),), (dt.datetime(2026, 1, 1),), (None,)],
        T.StructType([T.StructField("d", T.TimestampNTZType())]),
    )
    assert df.filter(P.date_between("d")).count() == 2
    # the study's literal form drops a time after midnight on the last day
    assert df.filter(P.date_between_as_written("d")).count() == 1


def test_not_in_drops_null(small):
    assert small.filter(P.not_in("category", ["c2"])).count() == 3
    assert small.filter(P.not_in("category", [])).count() == 7


def test_scope_contains_drops_null(spark):
    df = spark.createDataFrame([('["DE"]',), ('["AT","DE"]',), ('["FR"]',), (None,)], "s string")
    assert df.filter(P.scope_contains("s")).count() == 2
    assert df.filter(P.scope_has_country("s")).count() == 2


def test_month_range(spark):
    df = spark.createDataFrame(
        [(dt.date(2024, 12, 31),), (dt.date(2025, 1, 1),), (dt.date(2025, 2, 28),), (dt.date(2025, 3, 1),)], "d date"
    )
    assert df.filter(P.month_range("d", "2025-01", "2025-02")).count() == 2
    assert df.filter(P.month_range("d", "2024-12", "2024-12")).count() == 1


def test_pct_change_and_per_million_zero_guard(spark):
    df = spark.createDataFrame([(0.0, 1.0, 5, 0), (2.0, 3.0, 5, 10)], "a double, b double, c long, base long")
    got = df.select(C.pct_change("a", "b").alias("x"), C.per_million("c", "base").alias("y")).collect()
    assert got[0]["x"] is None and got[0]["y"] is None
    assert got[1]["x"] == 50.0 and got[1]["y"] == 500000.0


def test_round_half_up(spark):
    v = spark.range(1).select(F.round(F.lit(0.125), 2).alias("r")).first()["r"]
    assert v == 0.13


def test_agreement_counts_reports_all_statuses(spark):
    df = spark.createDataFrame([("A", dt.date(2025, 1, 1), dt.date(2025, 1, 1))], "g string, c date, a date")
    out = funnel.agreement_counts(df, "c", "a", ["g"])
    assert rows(out, "status", "n") == [("different", 0), ("equal", 1), ("null", 0)]


def test_funnel_monotone(spark):
    df = spark.range(100).withColumn("g", F.lit("x"))
    steps = [("all", F.lit(True)), ("even", F.col("id") % 2 == 0), ("even_small", (F.col("id") % 2 == 0) & (F.col("id") < 10))]
    out = rows(funnel.funnel(df, steps, ["g"]), "step_no", "rows", "dropped", "retention_pct")
    assert out == [(1, 100, 0, 100.0), (2, 50, 50, 50.0), (3, 5, 45, 10.0)]


def test_set_overlap_partitions_values(spark):
    df = spark.createDataFrame([("a", "v1"), ("a", "v2"), ("b", "v1"), ("c", "v2"), (None, "v1"), ("d", "v3")], "cat string, ver string")
    out = rows(overlap.set_overlap(df, "cat", "ver", "v1", "v2"), "cat", "membership")
    assert out == srt([("a", "both"), ("b", "v1_only"), ("c", "v2_only"), (None, "v1_only")])


def test_unmapped_keeps_null(spark):
    counts = spark.createDataFrame([("STATEMENT_CATEGORY_VIOLENCE", 3), ("X_UNKNOWN", 1), (None, 2)], "category string, count long")
    out = rows(overlap.unmapped(counts, dims.mapping(spark), "category"), "category", "count")
    assert out == srt([("X_UNKNOWN", 1), (None, 2)])


def test_harmonize_preserves_rows_and_maps(spark):
    df = spark.createDataFrame(
        [("u1", "STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE", dt.datetime(2025, 1, 2)), ("u2", "NOPE", dt.datetime(2025, 8, 1)), ("u3", None, None)],
        T.StructType([T.StructField("uuid", T.StringType()), T.StructField("category", T.StringType()), T.StructField("application_date", T.TimestampNTZType())]),
    )
    out = harmonize.harmonize(df, dims.mapping(spark))
    assert out.count() == 3
    assert out.columns == ["uuid", "category_raw", "category_harmonized", "application_date_raw", "application_date_harmonized"]
    got = {r["uuid"]: (r["category_harmonized"], r["application_date_raw"]) for r in out.collect()}
    assert got == {"u1": ("OTHER", dt.date(2025, 1, 2)), "u2": (None, dt.date(2025, 8, 1)), "u3": (None, None)}


def test_mapping_is_unique_and_has_13_clusters(spark):
    m = dims.mapping(spark)
    assert m.count() == 17
    assert m.select("super_cluster").distinct().count() == 13
    dup = m.unionByName(m.limit(1))
    counts = spark.createDataFrame([(r.original_category, 1) for r in m.limit(1).collect()], "category string, count long")
    assert harmonize.map_counts(counts, m).count() == 1
    with pytest.raises(Exception, match="mapping key not unique"):
        harmonize.map_counts(counts, dup).collect()


def test_lookup_counts_reports_zero(spark):
    df = spark.createDataFrame([("A", "c1", "v1"), ("A", "c1", "v1"), ("B", "c2", "v2")], "p string, category string, api_version string")
    out = rows(harmonize.lookup_counts(df, [("c1", "v1"), ("c2", "v1")], ["p"]), "p", "category", "api_version", "count")
    assert out == [("A", "c1", "v1", 2), ("A", "c2", "v1", 0), ("B", "c1", "v1", 0), ("B", "c2", "v1", 0)]


def test_presence_mask(spark):
    mapping = spark.createDataFrame([("c1", "S1"), ("c2", "S2"), ("c3", "S3")], "original_category string, super_cluster string")
    used = spark.createDataFrame([("c1", "T"), ("c1", "X"), ("c2", "X")], "category string, platform_name string")
    out = overlap.presence_mask(mapping, used, "original_category", "category", "platform_name", [("T", "t"), ("X", "x")])
    assert rows(out, "original_category", "t", "x") == [("c1", "c1", "c1"), ("c2", None, "c2"), ("c3", None, None)]


def test_profile_exact_counts_null_as_value(spark, small):
    out = profile.profile(small, ["category", "v"], exact=True)
    got = {r["column"]: r for r in out.collect()}
    assert got["category"]["unique_count"] == 3  # c1, c2, null
    assert got["category"]["null_count"] == 1
    assert got["category"]["variance"] is None
    assert got["v"]["dtype"] == "double"
    assert got["v"]["variance"] == pytest.approx(3.5)


def test_profile_approx_close_to_exact(spark):
    df = spark.range(20000).select((F.col("id") % 5000).cast("string").alias("k"))
    approx = profile.profile(df, ["k"], exact=False, rsd=0.016).first()["unique_count"]
    assert abs(approx - 5000) / 5000 < 0.06


def test_null_report_and_missing(spark):
    df = spark.createDataFrame([("a", None), (" ", None), (None, None)], "s string, t string")
    nr = {r["column"]: (r["null_count"], r["total_rows"]) for r in profile.null_report(df).collect()}
    assert nr == {"s": (1, 3), "t": (3, 3)}
    cm = {r["column"]: (r["total_missing_pct"], r["severity"]) for r in profile.column_missing(df).collect()}
    assert cm["t"] == (100.0, "empty")
    assert cm["s"][0] == pytest.approx(200 / 3) and cm["s"][1] == "severe"


def test_constant_columns(spark):
    df = spark.createDataFrame([("x", None, "a", 1), ("x", None, "b", 1), ("x", None, None, 1)], "c string, n string, m string, i int")
    out = rows(profile.constant_columns(df), "column", "value")
    assert out == srt([("c", "x"), ("n", None), ("i", "1")])


def test_distinct_counts_and_multiplicity(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), (None, 2)], "k string, j int")
    dc = {r["column"]: r["n_unique"] for r in profile.distinct_counts(df, ["k", "j"]).collect()}
    assert dc == {"k": 3, "j": 2}
    m = profile.multiplicity(df, ["k", "j"]).first()
    assert (m["total_rows"], m["distinct_keys"], m["duplicated_keys"], m["excess_rows"]) == (4, 3, 1, 1)
    h = rows(profile.multiplicity_histogram(df, ["k"]), "copies", "keys")
    assert h == [(1, 2), (2, 1)]


def test_top_values_ranks_and_bases(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",), ("b",), ("c",), (None,)], "s string")
    out = rows(profile.top_values(df, ["s"], n=2), "rank", "value", "count", "pct_of_rows", "pct_of_top")
    assert out == [(1, "a", 3, pytest.approx(300 / 7), 60.0), (2, "b", 2, pytest.approx(200 / 7), 40.0)]


def test_top_values_tie_break_nulls_first(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",)], "s string")
    out = rows(profile.top_values(df, ["s"], n=2), "rank", "value")
    assert out == [(1, None), (2, "a")]


def test_string_stats_and_truncation(spark):
    df = spark.createDataFrame([("abc",), (" ab",), (None,)], "s string")
    st = profile.string_stats(df, ["s"]).first()
    assert (st["len_min"], st["len_max"], st["len_mean"], st["whitespace_anomaly_count"]) == (3, 3, 3.0, 1)
    tf = profile.truncation_flags(df, {"s": 3, "missing_col": 10}).collect()
    assert [(r["column"], r["rows_at_limit"]) for r in tf] == [("s", 2)]


def test_text_variants(spark):
    df = spark.createDataFrame([("Done.",), ("Done",), ("Done. ",), ("Other",)], "t string")
    out = rows(profile.text_variants(df, "t"), "normalized", "raw", "count")
    assert out == [("Done", "Done", 1), ("Done", "Done.", 1), ("Done", "Done. ", 1)]


def test_working_dataset_and_strict_version(spark):
    raw = spark.createDataFrame(
        [
            ("u1", "c", "t", "No", "d", '["DE"]', dt.datetime(2025, 3, 1), "X (formerly Twitter)", None),
            ("u2", "c", "t", "No", "d", '["FR"]', dt.datetime(2025, 3, 1), "X", None),
            ("u3", "c", "t", "No", "d", '["DE"]', dt.datetime(2026, 3, 1), "X", None),
            ("u4", "c", "t", "No", "d", '["DE"]', dt.datetime(2025, 9, 1), "TikTok", None),
        ],
        S.KEEP_SCHEMA,
    )
    w = prep.working_dataset(raw)
    assert w.columns == S.WORKING_COLUMNS
    assert rows(w, "uuid", "api_version") == [("u1", "v1"), ("u4", "v2")]
    v1 = prep.v1_dataset(w, exclude=())
    assert rows(v1, "uuid", "platform_name") == [("u1", "X")]
    with pytest.raises(ValueError, match="api_version"):
        prep.analysed_dataset(w.drop("api_version"))
    lenient = prep.analysed_dataset(w.drop("api_version"), strict=False, exclude=())
    assert lenient.count() == 2
    with pytest.raises(ValueError, match="error_missing_columns:uuid"):
        prep.working_dataset(raw.drop("uuid"))


def test_scope_arity(spark):
    df = spark.createDataFrame([('["DE"]',), ('["AT","DE","FR"]',), ("not json",)], "s string")
    assert [r[0] for r in df.select(C.array_arity("s")).collect()] == [1, 3, None]


def test_sort_by_mixed_directions_and_tie_break(spark):
    from moderata.operators import order

    df = spark.createDataFrame([("B", 1, "z"), ("A", 5, "y"), ("A", 5, "x"), ("A", 9, None), ("A", 5, None)], "p string, n long, c string")
    got = [tuple(r) for r in order.sort_by(df, ["p", ("n", "desc")]).collect()]
    assert got == [("A", 9, None), ("A", 5, None), ("A", 5, "x"), ("A", 5, "y"), ("B", 1, "z")]
    assert [tuple(r) for r in order.head(df, 2, [("n", "asc")]).collect()] == [("B", 1, "z"), ("A", 5, None)]


def test_head_per_group_with_hot_group(spark):
    from moderata.operators import order

    hot = spark.range(30000).select(F.lit("hot").alias("g"), F.col("id"))
    cold = spark.range(3).select(F.lit("cold").alias("g"), F.col("id"))
    df = hot.unionByName(cold)
    out = order.head_per_group(df, 2, ["g"], [("id", "desc")])
    assert rows(out, "g", "id") == [("cold", 1), ("cold", 2), ("hot", 29998), ("hot", 29999)]
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_empty_input(spark):
    from moderata.operators import order

    empty = spark.createDataFrame([], "p string, k string, v double")
    assert shares.group_share(empty, ["k"], ["p"]).count() == 0
    assert shares.group_share(empty, ["k"]).count() == 0
    assert shares.conditional_share(empty, ["p"], F.col("k") == "x").count() == 0
    assert shares.top_per_group(empty, ["p"], "k", "v").count() == 0
    assert profile.top_values(empty, ["k"], 3, ["p"]).count() == 0
    assert profile.profile(empty, ["k", "v"], exact=True).count() == 0
    assert profile.distinct_counts(empty, ["k"]).count() == 0
    assert order.head_per_group(empty, 2, ["p"], ["k"]).count() == 0
    f = funnel.funnel(empty, [("all", F.lit(True))]).collect()
    assert [(r["rows"], r["dropped"], r["retention_pct"]) for r in f] == [(0, 0, 0.0)]
    m = [tuple(r) for r in profile.multiplicity(empty, ["k"]).collect()]
    assert m == [(0, 0, 0, 0)]  # a global aggregate: one row of zero counts
    assert profile.multiplicity(empty, ["k"], ["p"]).count() == 0


def test_signed_pct_text(spark):
    df = spark.createDataFrame([(42.94,), (-8.23,), (0.28,)], "x double")
    assert [r[0] for r in df.select(C.signed_pct_text("x")).collect()] == ["+42.94%", "-8.23%", "+0.28%"]


def test_join_on_full_keeps_right_only_keys(spark):
    from moderata.operators.joins import join_on

    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, a int")
    b = spark.createDataFrame([("x", 10), ("y", 20), (None, 30)], "k string, b int")
    got = rows(join_on(a, b, ["k"], "full"), "k", "a", "b")
    assert got == srt([("x", 1, 10), ("y", None, 20), (None, 2, 30)])
    assert rows(join_on(a, b, ["k"], "left"), "k", "a", "b") == srt([("x", 1, 10), (None, 2, 30)])


def test_fixed_dimensions_have_a_known_size(spark):
    """Inline relations: Spark knows how small they are and broadcasts them by itself."""
    fact = spark.range(5000).select(F.concat(F.lit("STATEMENT_CATEGORY_"), F.col("id").cast("string")).alias("category"))
    mapped = harmonize.map_counts(fact, dims.mapping(spark))
    assert "BroadcastHashJoin" in spark._jvm.PythonSQLUtils.explainString(mapped._jdf.queryExecution(), "simple")
    assert mapped.count() == 5000


def test_open_range(spark):
    df = spark.createDataFrame([(10.0,), (10.5,), (99.9,), (100.0,)], "x double")
    assert [r[0] for r in df.filter(P.open_range("x", 10, 100)).collect()] == [10.5, 99.9]


@pytest.mark.parametrize("shift", [0, 10**6, 10**9, 1.7e15])
def test_variance_of_shifted_values(spark, shift):
    """A large mean with a small spread (ids, epochs) keeps its variance, repeated values and nulls included."""
    import statistics

    values = [shift + v for v in (0, 1, 2, 2, 2, 7, 7, 11)]
    rows = [("a", float(v)) for v in values] + [("a", None), ("b", float(shift)), ("c", None)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.variance for r in profile.profile(df, ["x"], group=["g"], exact=True, variance_digits=None).collect()}
    assert got["a"] == pytest.approx(statistics.variance(values), rel=1e-12)
    assert got["b"] is None and got["c"] is None
    three = spark.createDataFrame([(10**9 + k,) for k in range(3)], "x long")
    assert profile.profile(three, exact=True).first().variance == 1.0
