"""``cut``: rounds of joins leave no estimate that grows, and no shuffle files."""

import glob

from pyspark.sql import functions as F

from moderata.llm.common import cut


def _guessed_bits(df) -> int:
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length())


def test_size_estimate_does_not_grow_with_rounds(spark):
    rows = cut(spark.range(100).select("id", (F.col("id") * 7 % 100).alias("up")))
    first = _guessed_bits(rows)
    for _ in range(4):
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("further"))
        rows = cut(rows.join(above, "up").select("id", F.least("up", "further").alias("up")))
    assert _guessed_bits(rows) == first <= 64
    assert rows.count() == 100


def test_rows_columns_and_types_stay(spark):
    kept = spark.createDataFrame([(1, "a", [1.5]), (None, None, None)], "x int, y string, z array<double>")
    out = cut(kept)
    assert out.schema == kept.schema
    assert sorted(out.collect(), key=str) == sorted(kept.collect(), key=str)


def test_shuffle_files_go_with_the_action(spark):
    folder = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    count = lambda: len([f for d in folder for f in glob.glob(f"{d}/*/shuffle_*.data")])
    before = count()
    out = cut(spark.range(10_000).groupBy((F.col("id") % 1000).alias("k")).count())
    assert count() == before
    assert out.count() == 1000
