"""Every named query against its DuckDB oracle text (the driver's gate).

sf0.01 is the scale the driver checks; sf0.001 is the smoke scale of
``entry``. Estimates (HLL) have no oracle and get a rows-only check.
"""

import pytest

import __spark_entry__ as E
from moderata.plans import queries as Q
from oracle_harness import compare

from sf_paths import SF_ORACLE, SF_SMALL

QUERIES = {name: fn for name, fn in E.queries().items() if name in Q.QUERIES}
ORACLE = {name: sql for name, sql in E.oracle_sql().items() if name in Q.QUERIES}


def test_every_query_has_oracle_or_is_declared_estimate():
    from moderata.plans.queries import NO_ORACLE

    assert set(QUERIES) - set(ORACLE) == set(NO_ORACLE)
    assert not (set(ORACLE) - set(QUERIES))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_sf001(spark, duck_oracle, name):
    r = compare(spark, duck_oracle, name, SF_ORACLE, QUERIES[name], ORACLE[name])
    assert r["columns_match"], r
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["value_match"], r
    assert r["exact_match"], r  # the driver may hash floats exactly


@pytest.mark.parametrize("name", ["category_distribution", "monthly_intensity", "screening_profile", "topn_values", "filter_funnel"])
def test_oracle_smoke_scale(spark, duck_small, name):
    r = compare(spark, duck_small, name, SF_SMALL, QUERIES[name], ORACLE[name])
    assert r["value_match"], r


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_queries_run(spark, name):
    df = QUERIES[name](spark, SF_ORACLE)
    assert df.count() > 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["platform_name", "category", "count", "pct"]
    assert df.count() > 0


def test_approx_profile_close_to_exact(spark):
    exact = {(r["platform_name"], r["column"]): r["unique_count"] for r in QUERIES["screening_profile_working"](spark, SF_ORACLE).collect()}
    approx = {(r["platform_name"], r["column"]): r["unique_count"] for r in QUERIES["screening_profile_approx"](spark, SF_ORACLE).collect()}
    assert exact.keys() == approx.keys()
    for k, v in exact.items():
        assert abs(approx[k] - v) <= max(2, 0.06 * v), (k, v, approx[k])


SPARK_TO_DUCK = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle_types_match(spark, duck_small, name):
    """Same column types on both sides (DuckDB's count_if is HUGEINT unless cast)."""
    sdf = QUERIES[name](spark, SF_SMALL)
    spark_types = {f.name: SPARK_TO_DUCK.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in sdf.schema.fields}
    rel = duck_small.sql(ORACLE[name])
    duck_types = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    assert spark_types == duck_types
