"""The pipeline's stages and the registered queries."""

import __spark_entry__ as E
import corpus_pipeline
from moderata.llm import queries
from moderata.llm.common import bitmap, fresh_folder, split_by_bitmap


def test_queries_are_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert names == [f"op{k}" for k in range(1, 14)]
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE) <= set(E.oracle_sql())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "mixing", "bpe"]


def test_stages_keep_the_columns(spark, docs, rows):
    sf = fresh_folder(spark, "test-sf")
    spark.createDataFrame([(k, 1, int(k == 18)) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs.write.parquet(f"{sf}/documents.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        folder = fresh_folder(spark, f"test-{name}")
        stage(spark, now, sf).write.parquet(folder)
        now = spark.read.parquet(folder)
        if name != "bpe":
            assert now.columns == columns
        assert now.count() > 0
    assert now.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_line_dedup_drops_what_lost_all_lines(spark):
    text = "this line is in two documents\nand this one too as well"
    docs = spark.createDataFrame([(1, text, 54), (2, text, 54), (3, None, None), (4, "", 0), (5, "a line of its own here\nthis line is in two documents", 52)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, docs, "").collect()}
    assert got == {1: (text, 54), 3: (None, None), 4: ("", 0), 5: ("a line of its own here", 22)}


def test_bitmap_loses_no_row(spark):
    rows = spark.range(20_000).selectExpr("cast(id as string) as k", "id")
    keys = spark.range(0, 20_000, 7).selectExpr("cast(id as string) as k")
    may, rest = split_by_bitmap(rows, "k", bitmap(keys, "k"))
    assert may.join(keys, "k").count() == keys.count()
    assert may.count() + rest.count() == 20_000 and may.count() < keys.count() + 100
    assert may.columns == rows.columns
