"""Invariants on generated inputs (hypothesis): shares per group sum to 100,
the funnel is monotone, harmonisation keeps the row count, union counts add,
overlap labels partition the value set, the file sample is deterministic
and of size max(1, floor(n * fraction)), results equal a brute-force pandas
computation."""

import collections

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moderata.operators import funnel, harmonize, overlap, profile, shares
from moderata.sources import dims, parts

SETTINGS = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])

keys = st.sampled_from(["a", "b", "c", None])
platforms = st.sampled_from(["P", "Q", "R"])
rows_st = st.lists(st.tuples(platforms, keys, st.integers(0, 5)), min_size=1, max_size=60)


def frame(spark, rows):
    return spark.createDataFrame(rows, "p string, k string, v int")


@SETTINGS
@given(rows=rows_st)
def test_shares_sum_to_100_and_match_brute_force(spark, rows):
    out = shares.group_share(frame(spark, rows), ["k"], within=["p"]).collect()
    by_p = collections.defaultdict(float)
    for r in out:
        by_p[r["p"]] += r["pct"]
    assert all(abs(v - 100.0) < 1e-9 for v in by_p.values())
    expect = collections.Counter((p, k) for p, k, _ in rows)
    assert {(r["p"], r["k"]): r["count"] for r in out} == dict(expect)


@SETTINGS
@given(rows=rows_st)
def test_conditional_share_brute_force(spark, rows):
    out = {r["p"]: (r["count"], r["pct"]) for r in shares.conditional_share(frame(spark, rows), ["p"], F.col("v") > 2).collect()}
    tot = collections.Counter(p for p, _, _ in rows)
    hit = collections.Counter(p for p, _, v in rows if v > 2)
    assert out == {p: (hit[p], hit[p] / tot[p] * 100) for p in hit}


@SETTINGS
@given(rows=rows_st)
def test_funnel_is_monotone(spark, rows):
    steps = [("all", F.lit(True)), ("k", F.col("k").isNotNull()), ("k_v", F.col("k").isNotNull() & (F.col("v") > 1))]
    out = sorted((r["p"], r["step_no"], r["rows"], r["dropped"]) for r in funnel.funnel(frame(spark, rows), steps, ["p"]).collect())
    for p in {r[0] for r in out}:
        seq = [r for r in out if r[0] == p]
        assert all(a[2] >= b[2] and b[3] == a[2] - b[2] for a, b in zip(seq, seq[1:]))


@SETTINGS
@given(cats=st.lists(st.sampled_from(["STATEMENT_CATEGORY_VIOLENCE", "STATEMENT_CATEGORY_SELF_HARM", "NOPE", None]), min_size=1, max_size=40))
def test_harmonize_keeps_row_count(spark, cats):
    df = spark.createDataFrame([(str(i), c) for i, c in enumerate(cats)], "uuid string, category string").withColumn("application_date", F.lit(None).cast("timestamp_ntz"))
    out = harmonize.harmonize(df, dims.mapping(spark))
    assert out.count() == len(cats)
    assert out.filter(F.col("category_harmonized").isNull()).count() == sum(1 for c in cats if c not in ("STATEMENT_CATEGORY_VIOLENCE", "STATEMENT_CATEGORY_SELF_HARM"))


@SETTINGS
@given(a=rows_st, b=rows_st)
def test_union_counts_add(spark, a, b):
    u = overlap.union_all([frame(spark, a), frame(spark, b)])
    assert u.count() == len(a) + len(b)


@SETTINGS
@given(rows=st.lists(st.tuples(keys, st.sampled_from(["v1", "v2", "v3"])), min_size=1, max_size=40))
def test_overlap_labels_partition_values(spark, rows):
    df = spark.createDataFrame(rows, "k string, s string")
    out = {r["k"]: r["membership"] for r in overlap.set_overlap(df, "k", "s", "v1", "v2").collect()}
    in1 = {k for k, s in rows if s == "v1"}
    in2 = {k for k, s in rows if s == "v2"}
    assert set(out) == in1 | in2
    for k, m in out.items():
        assert m == ("both" if k in in1 and k in in2 else "v1_only" if k in in1 else "v2_only")


@SETTINGS
@given(n=st.integers(1, 300), fraction=st.sampled_from([0.5, 0.1, 0.9]))
def test_sample_size_and_determinism(spark, n, fraction):
    listing = spark.range(n).select(F.format_string("f%04d.zip", "id").alias("path"), F.lit("t").alias("platform"))
    a = sorted(r.path for r in parts.sample_files(listing, fraction).collect())
    b = sorted(r.path for r in parts.sample_files(listing, fraction).collect())
    assert a == b and len(a) == max(1, int(n * fraction))


@SETTINGS
@given(rows=rows_st)
def test_distinct_and_multiplicity_brute_force(spark, rows):
    df = frame(spark, rows)
    dc = {r["column"]: r["n_unique"] for r in profile.distinct_counts(df, ["k", "v"]).collect()}
    assert dc == {"k": len({k for _, k, _ in rows}), "v": len({v for _, _, v in rows})}
    m = profile.multiplicity(df, ["p", "k", "v"]).first()
    c = collections.Counter(rows)
    assert (m["total_rows"], m["distinct_keys"], m["duplicated_keys"], m["excess_rows"]) == (len(rows), len(c), sum(1 for v in c.values() if v > 1), len(rows) - len(c))


@SETTINGS
@given(rows=rows_st, n=st.integers(1, 4))
def test_top_values_brute_force(spark, rows, n):
    df = frame(spark, rows).select(F.col("k").alias("s"))
    got = sorted((r["rank"], r["value"], r["count"]) for r in profile.top_values(df, ["s"], n).collect())
    c = collections.Counter(k for _, k, _ in rows)
    order = sorted(c.items(), key=lambda kv: (-kv[1], kv[0] is not None, kv[0] or ""))
    assert got == [(i + 1, k, cnt) for i, (k, cnt) in enumerate(order[:n])]


@pytest.mark.parametrize("hot_share", [0.34, 0.9])
def test_hot_key_shares_exact(spark, hot_share):
    """One group holding a third (or most) of all rows: results stay exact."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") < int(n * hot_share), F.lit("hot")).otherwise(F.concat(F.lit("g"), (F.col("id") % 97).cast("string"))).alias("p"),
        (F.col("id") % 7).cast("string").alias("k"),
    )
    out = shares.group_share(df, ["k"], ["p"])
    hot = out.filter(F.col("p") == "hot").agg(F.sum("count"), F.sum("pct")).first()
    assert hot[0] == int(n * hot_share) and abs(hot[1] - 100.0) < 1e-9


