"""Heavy-hitter summaries: the same top values as the full count, also where the bound fails."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moderata.operators import frequent, profile

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
rows_st = st.lists(st.tuples(st.sampled_from(["p", "q", None]), st.sampled_from(["", "u", "v", "w", None])), max_size=40)


def tuples(df):
    return sorted(map(str, df.collect()))


@SETTINGS
@given(rows=rows_st, n=st.integers(1, 4))
def test_same_rows_as_the_full_count(spark, rows, n):
    df = spark.createDataFrame(rows, "p string, s string")
    assert tuples(frequent.top_values(df, ["s"], n)) == tuples(profile.top_values(df, ["s"], n))
    assert tuples(frequent.top_values(df, ["s"], n, ["p"])) == tuples(profile.top_values(df, ["s"], n, ["p"]))


def skewed(spark):
    """``few``: six values. ``heavy``: 12 values with 5 % of the rows each, else single ones. ``flat``: all values single or twice."""
    row = F.col("id")
    heavy = F.when(row % 5 < 3, F.concat(F.lit("h"), row % 12)).otherwise(F.concat(F.lit("x"), row))
    flat = F.concat(F.lit("f"), F.when(row < 20, F.floor(row / 2)).otherwise(row))
    return spark.range(60_000).repartition(4).select(F.concat(F.lit("c"), row % 6).alias("few"), heavy.alias("heavy"), flat.alias("flat"))


def test_separated_columns_count_candidates_only(spark):
    df = skewed(spark)
    known = {r["column"]: r for r in frequent.summaries(df, df.columns, 10).collect()}
    assert known["few"]["separated"] and len(known["few"]["candidates"]) == 6
    assert known["heavy"]["separated"] and 10 <= len(known["heavy"]["candidates"]) <= 20
    assert not known["flat"]["separated"] and known["flat"]["candidates"] is None  # the bound fails: all values are counted
    assert tuples(frequent.top_values(df, df.columns, 10)) == tuples(profile.top_values(df, df.columns, 10))
    flat = frequent.top_values(df, ["flat"], 10).collect()
    assert sorted((r["value"], r["count"]) for r in flat) == sorted((f"f{i}", 2) for i in range(10))


def test_pairs_beyond_the_broadcast_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(frequent, "PAIRS", 1)
    df = skewed(spark)
    assert tuples(frequent.top_values(df, ["few", "heavy"], 3)) == tuples(profile.top_values(df, ["few", "heavy"], 3))


def test_ties_at_the_last_place_are_candidates(spark):
    df = spark.range(30_000).select(F.concat(F.lit("t"), F.col("id") % 30).alias("s"))
    assert [r["value"] for r in frequent.top_values(df, ["s"], 3).orderBy("rank").collect()] == ["t0", "t1", "t10"]
