"""Golden arithmetic: the study's recorded group counts fed into the
post-aggregation half of each analysis must give its recorded results."""

import pytest
from pyspark.sql import functions as F

from moderata import schemas as S
from moderata.operators import compare, shares
from moderata.plans import queries as Q
from moderata.sources import dims

# Recorded monthly v1 counts per platform (the study's monthly count table).
MONTHLY = [
    ("TikTok", "2025-01", 108_870_939),
    ("TikTok", "2025-02", 155_621_404),
    ("TikTok", "2025-03", 202_128_288),
    ("TikTok", "2025-04", 185_115_344),
    ("TikTok", "2025-05", 101_359_626),
    ("TikTok", "2025-06", 77_126_737),
    ("X", "2025-01", 36_112),
    ("X", "2025-02", 33_139),
    ("X", "2025-03", 31_542),
    ("X", "2025-04", 13_586),
    ("X", "2025-05", 6_475),
    ("X", "2025-06", 11_337),
]
RECORDED_RATES = {
    ("TikTok", "2025-01"): 4236223.31,
    ("TikTok", "2025-02"): 6055307.55,
    ("TikTok", "2025-03"): 7864913.93,
    ("TikTok", "2025-04"): 7202931.67,
    ("TikTok", "2025-05"): 3943954.32,
    ("TikTok", "2025-06"): 3001040.35,
    ("X", "2025-01"): 2315.11,
    ("X", "2025-02"): 2124.51,
    ("X", "2025-03"): 2022.13,
    ("X", "2025-04"): 910.03,
    ("X", "2025-05"): 433.72,
    ("X", "2025-06"): 759.39,
}


@pytest.fixture(scope="module")
def intensity(spark):
    counts = spark.createDataFrame(MONTHLY, "platform_name string, month string, raw_count long")
    return compare.rate_per_million(counts, dims.recipients(spark), ["platform_name", "month"])


def test_month_counts_add_up(spark):
    v1_tiktok = sum(c for p, _, c in MONTHLY if p == "TikTok")
    v1_x = sum(c for p, _, c in MONTHLY if p == "X")
    assert (v1_tiktok, v1_x) == (830_222_338, 132_191)


def test_intensity_rates(intensity):
    got = {(r["platform_name"], r["month"]): r["intensity_rate"] for r in intensity.collect()}
    assert got == RECORDED_RATES


def test_intensity_deviation_uses_rounded_rates(intensity):
    dev = compare.compare_periods(intensity, ["platform_name"], "month", S.JAN, S.FEB, "intensity_rate")
    got = {r["platform_name"]: r["pct_deviation"] for r in dev.collect()}
    assert got == {"TikTok": 42.94, "X": -8.23}


def test_automation_deviation_tiny_denominators(spark):
    # X: one fully automated decision of 36,112 in January, one of 33,139 in February.
    df = spark.createDataFrame(
        [("X", "2025-01", S.FULLY_AUTOMATED)] + [("X", "2025-02", S.FULLY_AUTOMATED)],
        "platform_name string, month string, automated_decision string",
    )
    counts = spark.createDataFrame([("X", "2025-01", 1, 36_112), ("X", "2025-02", 1, 33_139)], "platform_name string, month string, n long, total long")
    auto = counts.select("platform_name", "month", (F.col("n") / F.col("total") * 100).alias("auto_pct"))
    dev = compare.compare_periods(auto, ["platform_name"], "month", S.JAN, S.FEB, "auto_pct").first()
    assert dev["pct_deviation"] == 8.97
    assert round(dev["jan_rate"], 4) == 0.0028 and round(dev["feb_rate"], 4) == 0.0030
    assert df.count() == 2


def test_visibility_other_share(spark):
    counts = spark.createDataFrame(
        [
            ("TikTok", '["DECISION_VISIBILITY_CONTENT_REMOVED"]', 503_067_724),
            ("TikTok", '["DECISION_VISIBILITY_OTHER"]', 312_208_060),
            ("TikTok", None, 10_791_902),
            ("TikTok", '["DECISION_VISIBILITY_CONTENT_AGE_RESTRICTED"]', 3_888_374),
            ("TikTok", '["DECISION_VISIBILITY_CONTENT_AGE_RESTRICTED","DECISION_VISIBILITY_CONTENT_REMOVED"]', 151_988),
            ("TikTok", '["DECISION_VISIBILITY_CONTENT_AGE_RESTRICTED","DECISION_VISIBILITY_OTHER"]', 63_350),
            ("TikTok", '["DECISION_VISIBILITY_CONTENT_DEMOTED","DECISION_VISIBILITY_OTHER"]', 27_942),
            ("TikTok", '["DECISION_VISIBILITY_CONTENT_DISABLED"]', 22_998),
            ("X", '["DECISION_VISIBILITY_OTHER"]', 132_191),
        ],
        "platform_name string, decision_visibility string, count long",
    )
    total = counts.agg(F.sum("count")).first()[0]
    assert total == 830_222_338 + 132_191
    dist = {(r["platform_name"], r["decision_visibility"]): round(r["pct"], 2) for r in shares.share_of_counts(counts, ["platform_name"]).collect()}
    assert dist[("TikTok", '["DECISION_VISIBILITY_CONTENT_REMOVED"]')] == 60.59
    assert dist[("TikTok", None)] == 1.30
    other = {r["platform_name"]: round(r["pct"], 2) for r in Q.other_share_from_counts(counts).collect()}
    assert other == {"TikTok": 38.11, "X": 100.0}


def test_category_share_parity_vs_intent(spark):
    # X v1: the as-written exclusion list is a no-op, so the top share is 60,974 / 132,191.
    counts = spark.createDataFrame(
        [("X", "STATEMENT_CATEGORY_SCOPE_OF_PLATFORM_SERVICE", 60_974), ("X", "REST", 132_191 - 60_974)],
        "platform_name string, category string, count long",
    )
    pct = shares.share_of_counts(counts, ["platform_name"]).filter(F.col("category") != "REST").first()["pct"]
    assert round(pct, 2) == 46.13


def test_analysis_suite_equals_single_queries(spark):
    """One scan + checkpointed counts give the same four results as the separate queries."""
    from sf_paths import SF_ORACLE
    from moderata.plans import suite

    out = suite.analysis_suite(Q.v1(spark, SF_ORACLE))
    for name, df in out.items():
        single = Q.QUERIES[name](spark, SF_ORACLE)
        assert df.columns == single.columns, name
        assert [tuple(r) for r in df.collect()] == [tuple(r) for r in single.collect()], name
