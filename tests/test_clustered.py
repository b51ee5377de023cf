"""A clustered table gives the same rows and reads fewer of them for a filter on its keys."""

import collections

from pyspark.sql import functions as F

from moderata import sinks


def leaves(node):
    children = node.children()
    found = [node] if node.nodeName().startswith("Scan") else []
    return found + [x for k in range(children.size()) for x in leaves(children.apply(k))]


def rows_read(df):
    """Rows that the scan gave to the filter above it."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = df.collect()
        (scan,) = leaves(df._jdf.queryExecution().executedPlan())
        return len(got), scan.metrics().apply("numOutputRows").value()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def table(spark):
    """Eight categories over 60 days in mixed order, one category with a third of the rows."""
    n = F.col("id")
    category = F.when(n % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.xxhash64(n) % 7))
    at = F.timestamp_seconds(F.lit(1735689600) + F.pmod(F.xxhash64(n + 1), F.lit(60 * 86400)))
    return spark.range(120_000).repartition(6).select(n.alias("id"), category.alias("category"), at.alias("at"), (n % 2).cast("string").alias("p"))


def test_fewer_rows_read_for_category_and_dates(spark, tmp_path):
    df = table(spark)
    plain, clustered = str(tmp_path / "plain"), str(tmp_path / "clustered")
    sinks.write_partitioned(df, plain, ["p"])
    sinks.write_clustered(df, clustered, ["category", "at"], ["p"], row_group_bytes=64 << 10)
    assert spark.read.parquet(clustered).count() == 120_000
    assert spark.read.parquet(clustered).agg(F.sum(F.xxhash64("id", "category", "at", F.col("p").cast("string")).cast("decimal(38,0)"))).first() == spark.read.parquet(plain).agg(F.sum(F.xxhash64("id", "category", "at", F.col("p").cast("string")).cast("decimal(38,0)"))).first()
    wanted = (F.col("category") == "hot") & (F.col("at") < F.lit("2025-01-08").cast("timestamp"))
    n_plain, read_plain = rows_read(spark.read.parquet(plain).filter(wanted))
    n, read = rows_read(spark.read.parquet(clustered).filter(wanted))
    assert n == n_plain > 0
    assert read_plain == 120_000 and read < 60_000


def test_a_hot_value_is_split_over_files(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges this small would be put together
    try:
        sinks.write_clustered(table(spark), path, ["category", "at"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = collections.Counter(r["f"] for r in spark.read.parquet(path).filter("category = 'hot'").select(F.input_file_name().alias("f")).collect())
    assert len(files) > 1


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.write_clustered(table(spark).filter("id < 0"), path, ["category", "at"])
    assert spark.read.parquet(path).count() == 0
