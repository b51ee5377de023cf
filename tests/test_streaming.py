"""Incremental preparation: each run consumes only new dump files."""

import os
import shutil

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from moderata import sinks
from moderata.plans import prep
from moderata.sources import parts, staging
from moderata.streaming import ingest

from sf_paths import SF_SMALL


def test_incremental_ingest_matches_batch(spark, tmp_path):
    src = staging.staged_daily_tree(spark, SF_SMALL).replace("file:", "")
    # Arrival simulation: copy January first, then the rest.
    arrive = tmp_path / "arrive"
    files = []
    for dirpath, _, names in os.walk(src):
        files += [os.path.join(dirpath, n) for n in names if n.startswith("part-")]
    first = [f for f in files if "-2025-01-" in f]
    rest = [f for f in files if f not in first]
    assert first and rest

    def copy(paths):
        for f in paths:
            dst = arrive / os.path.relpath(f, src)
            dst.parent.mkdir(parents=True, exist_ok=True)
            shutil.copy(f, dst)

    out, ckpt = str(tmp_path / "working"), str(tmp_path / "ckpt")
    cout, cckpt = str(tmp_path / "monthly"), str(tmp_path / "ckpt_monthly")
    copy(first)
    ingest.ingest_working(spark, str(arrive), out, ckpt)
    ingest.monthly_counts_stream(spark, str(arrive), cout, cckpt)
    n1 = spark.read.parquet(out).count()
    jan_rows = sum(pq.read_metadata(f).num_rows for f in first)
    assert 0 < n1 <= jan_rows
    copy(rest)
    ingest.ingest_working(spark, str(arrive), out, ckpt)
    ingest.monthly_counts_stream(spark, str(arrive), cout, cckpt)
    got = sinks.read_working(spark, out)
    batch = prep.working_dataset(parts.load_parts(spark, src).drop("source_file", "dump_day"))
    assert got.count() == batch.count()
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
    # a third run with no new files changes nothing
    ingest.ingest_working(spark, str(arrive), out, ckpt)
    assert spark.read.parquet(out).count() == batch.count()
    monthly = spark.read.parquet(cout)
    assert monthly.agg(F.sum("row_count")).first()[0] == batch.count()
