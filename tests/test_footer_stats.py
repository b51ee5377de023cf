"""Ranges from row-group statistics; row groups without them are read."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import types as T

from moderata.sources import footer_stats

D = [dt.datetime(2025, 1, d) for d in range(1, 9)]


def test_ranges_with_and_without_statistics(spark, tmp_path):
    def part(name, values, **kw):
        pq.write_table(pa.table({"d": pa.array(values, pa.timestamp("us")), "x": list(range(len(values)))}), tmp_path / name, row_group_size=2, **kw)
        return f"file:{tmp_path / name}"

    paths = [
        part("stats", [D[3], None, D[1], D[5], None, None]),
        part("plain", [D[6], D[2], None, D[0]], write_statistics=False),
        part("nulls", [None, None, None]),
        part("none", []),
    ]
    pq.write_table(pa.table({"x": [1]}), tmp_path / "other")
    listing = spark.createDataFrame([(p, i) for i, p in enumerate([*paths, f"file:{tmp_path / 'other'}"])], "path string, n int")
    got = {r["n"]: tuple(r)[2:] for r in footer_stats.column_ranges(listing, "d", T.TimestampNTZType()).collect()}
    assert got[0] == (D[1], D[5], 3, 0)  # no data page read
    assert got[1] == (D[0], D[6], 2, 2)
    assert got[2] == (None, None, 2, 0)
    assert got[3][:2] == (None, None) and got[3][3] == 0
    assert got[4] == (None, None, 1, 0)
    whole = footer_stats.date_range(listing.selectExpr("path", "n < 2 as early"), "d", ["early"], T.TimestampNTZType())
    assert {r["early"]: (r["earliest"], r["latest"]) for r in whole.collect()} == {True: (D[0], D[6]), False: (None, None)}
