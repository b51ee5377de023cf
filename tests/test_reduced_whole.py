"""Reduced parts are whole or the run fails: damaged data pages, and parts that an interrupted run left short."""

import os

import pyarrow.parquet as pq
import pytest

from moderata.sources import parts
from test_sources import _part, _row


def _day(root):
    return f"{root}/tiktok___full/daily_dumps_chunked/sor-tiktok-2025-01-01-full"


def _table(root, n=400):
    rows = [_row(f"u{k}", "2025-01-01") for k in range(n)]
    _part(f"{_day(root)}/part-0000.parquet", rows, list(rows[0]))
    _part(f"{_day(root)}/part-0001.parquet", [_row("z", "2025-01-01")], list(rows[0]))


def test_a_damaged_data_page_fails_the_run_and_is_copied_later(spark, tmp_path):
    root, dst, log = str(tmp_path / "raw"), str(tmp_path / "reduced"), str(tmp_path / "log")
    _table(root)
    place = f"{_day(root)}/part-0000.parquet"
    whole = open(place, "rb").read()
    column = pq.ParquetFile(place).metadata.row_group(0).column(0)
    at = column.dictionary_page_offset or column.data_page_offset
    with open(place, "r+b") as f:
        f.seek(at)
        f.write(b"\xff" * column.total_compressed_size)
    assert pq.ParquetFile(place).metadata.num_rows == 400  # the footer can be read
    with pytest.raises(Exception):
        parts.reduce_parts(spark, root, dst, manifest_path=log)
    assert not os.path.exists(log)  # no manifest says 'processed'
    with open(place, "wb") as f:
        f.write(whole)
    parts.reduce_parts(spark, root, dst, manifest_path=log)
    assert spark.read.parquet(dst).count() == 401


def test_a_short_part_is_not_taken_as_written(spark, tmp_path):
    root, dst = str(tmp_path / "raw"), str(tmp_path / "reduced")
    _table(root)
    parts.reduce_parts(spark, root, dst)
    folder = f"{dst}/dump_folder=sor-tiktok-2025-01-01-full/source_part=part-0000"
    name = next(x for x in os.listdir(folder) if x.endswith(".parquet"))
    pq.write_table(pq.read_table(f"{folder}/{name}", partitioning=None).slice(0, 100), f"{folder}/{name}")
    crc = f"{folder}/.{name}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    status = {r.source_file.rsplit("/", 1)[1]: r.status for r in parts.reduce_parts(spark, root, dst).collect()}
    assert status == {"part-0000.parquet": "processed", "part-0001.parquet": "skipped_exists"}
    assert spark.read.parquet(dst).select("uuid").distinct().count() == spark.read.parquet(dst).count() == 401


def test_rows_are_compared_part_by_part(spark, tmp_path):
    root, dst = str(tmp_path / "raw"), str(tmp_path / "reduced")
    _table(root)
    man = parts.reduce_parts(spark, root, dst)
    parts._check_written(spark, man, dst)
    with pytest.raises(OSError, match="part-0000"):
        parts._check_written(spark, man.withColumn("rows", man.rows + (man.rows > 1).cast("long")), dst)
