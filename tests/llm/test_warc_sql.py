"""The DuckDB text of the WARC query against the operator on pages with copies (the given tables hold no revisits)."""

import duckdb

from moderata.llm import warc


def test_sql_gives_the_operators_rows(spark):
    large, wide = "x" * 1000, "é" * 500
    html = [large, large, "x" * 999, "x" * 999, None, "", wide, wide, wide, large + "y"]
    rows = [(k, f"http://h/{k}", h) for k, h in enumerate(html)]
    got = warc.round_trip(spark, spark.createDataFrame(rows, "page_id long, url string, html string"))
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    found = con.execute(warc.SQL)
    names = [c[0] for c in found.description]
    want = sorted(found.fetchall())
    assert [r[4] for r in want] == [1, None, None, None, None, None, 8, 8, None, None]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == want
