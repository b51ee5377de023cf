"""Nested zip archives of CSV dumps (S9): outer zip -> ``*.csv.zip`` -> ``*.csv``.

Spark has no zip source and a zip is not splittable as a byte stream, but
its central directory lists the members: the unit of parallelism is one
inner ``*.csv.zip`` member. Archive paths and then (archive, member) pairs
are DataFrames spread over tasks; each task opens its archive from the
shared filesystem and streams its member in bounded blocks (``mapInArrow``),
yielding text columns. Typing (non-strict date casts), filters and aggregation are then
ordinary Spark expressions, so per-archive counts combine through a normal
partial + final aggregate instead of Python additions on the driver.
"""

from __future__ import annotations

import contextlib
import zipfile
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..session import ship_package
from .files import open_fs

#: Bytes of CSV that a task parses at a time.
BLOCK_BYTES = 4 << 20


def _inner_zips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One (archive, inner) row for each ``*.csv.zip`` entry of each archive's directory."""
    for batch in batches:
        for place in batch.column(0).to_pylist():
            fs, p = open_fs(place)
            with fs.open_input_file(p) as raw, zipfile.ZipFile(raw) as archive:
                found = [entry.filename for entry in archive.infolist() if entry.filename.endswith(".csv.zip")]
            yield pa.RecordBatch.from_arrays([pa.array([place] * len(found), pa.string()), pa.array(found, pa.string())], ["archive", "inner"])


def _csv_blocks(stream, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """``columns`` of one CSV stream as text, block by block; a column the file lacks is null, as is empty text."""
    convert = csv.ConvertOptions(
        column_types={c: pa.string() for c in columns}, include_columns=list(columns), include_missing_columns=True,
        null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True,
    )
    try:
        reader = csv.open_csv(stream, csv.ReadOptions(block_size=BLOCK_BYTES), csv.ParseOptions(newlines_in_values=True), convert)
    except pa.ArrowInvalid as e:
        if "Empty CSV" in str(e):
            return
        raise
    with reader:
        yield from reader


def _member_rows(columns: Sequence[str]):
    """Rows of every ``*.csv`` of the (archive, inner) pairs; nested entries are read as streams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, inner in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, p = open_fs(place)
                with contextlib.ExitStack() as opened:
                    archive = opened.enter_context(zipfile.ZipFile(opened.enter_context(fs.open_input_file(p))))
                    nested = opened.enter_context(zipfile.ZipFile(opened.enter_context(archive.open(inner))))
                    for entry in nested.infolist():
                        if not entry.filename.endswith(".csv"):
                            continue
                        for block in _csv_blocks(opened.enter_context(nested.open(entry)), columns):
                            names = [pa.repeat(v, block.num_rows) for v in (place, f"{inner}/{entry.filename}")]
                            yield pa.RecordBatch.from_arrays([*names, *block.columns], ["archive", "member", *columns])

    return run


def list_archives(spark: SparkSession, root: str, glob: str = "*.zip") -> DataFrame:
    """Paths of the outer archives under ``root`` (no bytes read)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path")
    )


def read_nested_zip_csv(spark: SparkSession, archives: DataFrame, columns: Sequence[str] = S.ARCHIVE_COLUMNS) -> DataFrame:
    """Rows of every ``*.csv`` inside every ``*.csv.zip`` inside each listed archive.

    ``archives`` has a ``path`` column (e.g. from ``list_archives`` or
    ``sample_files``). Columns come back as text (``archive``, ``member``,
    then ``columns``); other members are skipped.

    Two passes, so that one huge archive (a day holding a third of all rows)
    does not become one task: each archive's directory is read first (cheap),
    then the (archive, inner) pairs are dealt over the session's shuffle
    partitions. A task holds one block of CSV at a time.
    """
    kinds = ", ".join(f"`{c}` string" for c in ["archive", "member", *columns])
    ship_package(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = archives.select("path").repartition(width, "path").mapInArrow(_inner_zips, "archive string, inner string")
    return pairs.repartition(width, "archive", "inner").mapInArrow(_member_rows(columns), kinds)


def typed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-strict text -> date casts (malformed values become null)."""
    return df.select(*[F.expr(f"try_cast(`{c}` AS DATE)").alias(c) if c in columns else F.col(c) for c in df.columns])
