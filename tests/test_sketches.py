"""Sketches per period: only new periods are read, merged estimates hold, retries count once."""

from pyspark.sql import functions as F

from moderata.operators import sketches


def days(spark, tmp_path):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "x").otherwise("y").alias("p"),
        (F.col("id") % 9_000).cast("string").alias("u"),
        F.concat(F.lit("2025-01-0"), (F.col("id") % 4 + 1).cast("string")).alias("day"),
    )
    path = str(tmp_path / "rows")
    rows.write.partitionBy("day").parquet(path)
    return spark.read.schema("p string, u string, day string").parquet(path)


def test_merged_estimate_and_retry(spark, tmp_path):
    df, path = days(spark, tmp_path), str(tmp_path / "sketches")
    sketches.add_periods(df.filter("day < '2025-01-03'"), path, "u", ["p"], "day")
    sketches.add_periods(df, path, "u", ["p"], "day")
    sketches.add_periods(df, path, "u", ["p"], "day")  # tried again: nothing is new
    got = {r["p"]: r for r in sketches.merged_distinct(df, path, ["p"], "day").collect()}
    exact = {r["p"]: r for r in df.groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("u").alias("u")).collect()}
    assert got.keys() == exact.keys()
    for p, r in got.items():
        assert r["total_rows"] == exact[p]["n"]
        assert abs(r["approx_unique"] - exact[p]["u"]) <= 3 * 0.016 * exact[p]["u"]


def test_only_new_periods_are_read(spark, tmp_path):
    df, path = days(spark, tmp_path), str(tmp_path / "sketches")
    sketches.add_periods(df.filter("day < '2025-01-04'"), path, "u", ["p"], "day")
    new = sketches.unsketched(df, path, "day")
    assert {f.rsplit("day=", 1)[1].split("/")[0] for f in new.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]} == {"2025-01-04"}
    plan = spark._jvm.PythonSQLUtils.explainString(new._jdf.queryExecution(), "formatted")
    assert "PartitionFilters" in plan and "2025-01-03" in plan.split("PartitionFilters")[1].split("\n")[0]


def test_null_periods_are_left_out(spark, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.createDataFrame([("x", "a", "d1"), ("x", None, "d1"), ("x", "b", None)], "p string, u string, day string")
    sketches.add_periods(df, path, "u", ["p"], "day")
    assert [tuple(r) for r in sketches.merged_distinct(df, path, ["p"], "day").collect()] == [("x", 2, 1)]
