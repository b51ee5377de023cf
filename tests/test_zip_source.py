"""Nested zip archives as a data source: the reader's rows, pushed filters, pruned columns and partitions."""

import pytest
from moderata.plans import oracle, queries
from moderata.sources import archives, zip_source
from pyspark.sql import functions as F
from sf_paths import SF_SMALL
from test_sources import _zip_fixture


@pytest.fixture
def root(spark, tmp_path):
    zip_source.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    _zip_fixture(str(tmp_path / "zips"))
    return str(tmp_path / "zips")


def rows_of(df):
    return sorted(tuple("" if v is None else v.replace("file:", "") for v in r) for r in df.collect())


def test_same_rows_as_the_reader(spark, root):
    got = spark.read.format("nested_zip_csv").load(root)
    assert rows_of(got) == rows_of(archives.read_nested_zip_csv(spark, archives.list_archives(spark, root)))
    assert got.rdd.getNumPartitions() == 2  # one per inner zip


@pytest.mark.parametrize(
    "condition, n",
    [
        ("contains(territorial_scope, 'DE')", 6), ("content_date is null", 1), ("content_date = '2025-01-01'", 3), ("content_date != '2025-01-01'", 3),
        ("content_date in ('2025-01-01', '2024-12-31')", 4), ("content_date not in ('2025-01-01', '2024-12-31')", 2), ("member like 'a.csv.zip%'", 3),
        ("archive like '%day2.zip'", 4), ("application_date >= '2025-02' and contains(territorial_scope, 'FR')", 1), ("length(content_date) > 10", 1),
        ("content_date <=> null", 1), ("content_date = '2025-01-01' or archive like '%day2.zip'", 6), ("archive = 'none'", 0),
    ],
)
def test_pushed_filters_give_the_same_rows(spark, root, condition, n):
    whole = spark.read.format("nested_zip_csv").load(root)
    plain = archives.read_nested_zip_csv(spark, archives.list_archives(spark, root))
    got = rows_of(whole.filter(condition))
    assert len(got) == n and got == rows_of(plain.filter(condition))


def test_filters_reach_partitions_and_rows(spark, root):
    reader = zip_source.NestedZipReader(zip_source.NestedZipCsv({}).schema(), {"path": root})
    left = list(reader.pushFilters([zip_source.D.StringEndsWith(("archive",), "day1.zip"), zip_source.D.EqualTo(("content_date",), 5)]))
    assert [type(f) for f in left] == [zip_source.D.EqualTo]
    assert [(p.archive.rsplit("/", 1)[1], p.inner) for p in reader.partitions()] == [("day1.zip", "a.csv.zip")]
    df = spark.read.format("nested_zip_csv").load(root).filter(F.col("archive").endswith("day1.zip") & F.col("territorial_scope").contains("FR"))
    assert "Filter" not in df._jdf.queryExecution().executedPlan().toString().split("BatchScan")[0] and df.rdd.getNumPartitions() == 1


def test_schema_prunes_and_options_add_columns(spark, root):
    assert rows_of(spark.read.format("nested_zip_csv").schema("other string").load(root)) == [("",)] * 4 + [("x",), ("y",), ("z",)]
    assert spark.read.format("nested_zip_csv").option("columns", "other, content_date").load(root).columns == ["archive", "member", "other", "content_date"]
    with pytest.raises(Exception, match="text columns only"):
        spark.read.format("nested_zip_csv").schema("other int").load(root).collect()


def test_no_archives(spark, root, tmp_path):
    (tmp_path / "empty").mkdir()
    assert spark.read.format("nested_zip_csv").load(str(tmp_path / "empty")).count() == 0


def test_query_reads_through_the_source(spark):
    df = queries.content_date_agreement_archives(spark, SF_SMALL)
    assert "nested_zip_csv" in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.count() > 0 and "content_date_agreement_archives" in oracle.oracle_sql()
