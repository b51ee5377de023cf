"""Write raw records derived from the driver's tables in the dump layouts.

The file-level operators (listing, manifest, coverage, sampling, archive
reading) need files in the study's layouts. These writers derive them from
the SoR view over ``lineitem`` so their work grows with the tables:

* daily Parquet tree ``<root>/<platform>___full/daily_dumps_chunked/
  sor-<platform>-<day>-full/part-<salt>-<number>.parquet``
* nested archives ``<root>/<platform>___full/sor-<platform>-<day>-full-<salt>-<number>.zip``
  holding ``*.csv.zip`` members of at most ``chunk_rows`` rows (the stage's: ``ROWS_PER_MEMBER``, for a
  member is a task of its reader).

Rows are dealt by (platform, day, salt) and sorted (the stages deal the narrow
table rows, and derive the records afterwards), so a task has one file
open at a time and holds one batch of rows; the salt splits a day that holds
a large share of all rows. Names depend on the rows only, so a retried task
writes the same files again. Stages lie under the shared
``spark.checkpoint.dir`` folder, named after the paths, lengths and times of
their inputs; a marker with the checked row count says that one is whole.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from .. import sinks
from ..functions.columns import normalize_values
from ..plans import prep
from ..session import ship_package, stage_root
from . import dims, parts
from .files import exists, open_fs, write_bytes
from .fixture import LINEITEM_COLUMNS, lineitem, sor_columns, sor_raw, with_duplicates

STATUS = "file string, rows long"
SALTS = 2
ROWS_PER_FILE = 1_000_000
ROWS_PER_MEMBER = 100_000
#: Bump when the staged layout or file schema changes, so that older stages are not used.
STAGE_VERSION = "5"


#: What a file's rows have in common: platform, day and salt.
_KEYS = ("_plat", "_day", "_salt")


def _keyed(raw: DataFrame) -> DataFrame:
    day = F.coalesce(F.to_date("application_date"), F.to_date("content_date"), F.lit("1970-01-01").cast("date"))
    salt = F.conv(F.substring(F.md5(F.col("uuid")), 1, 2), 16, 10).cast("int") % SALTS
    return raw.select("*", F.lower(normalize_values("platform_name")).alias("_plat"), F.date_format(day, "yyyy-MM-dd").alias("_day"), salt.alias("_salt"))


def _dealt(raw: DataFrame) -> DataFrame:
    width = int(raw.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return _keyed(raw).repartition(width, *_KEYS).sortWithinPartitions(*_KEYS, "uuid")


def _dealt_records(li: DataFrame) -> DataFrame:
    """As ``_dealt`` of the raw records of ``li``; its narrow rows are dealt and sorted, and the records derived where they then lie."""
    width = int(li.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    narrow = _keyed(sor_columns(li, LINEITEM_COLUMNS)).select(*LINEITEM_COLUMNS, F.xxhash64(*_KEYS).alias("_file")).repartition(width, "_file")
    ordered = _keyed(sor_columns(narrow, LINEITEM_COLUMNS)).select(*LINEITEM_COLUMNS, *_KEYS, "uuid").sortWithinPartitions(*_KEYS, "uuid")
    return with_duplicates(sor_columns(ordered, _KEYS), _KEYS)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((platform, day, salt), rows) for each run of rows with one key; the three key columns are taken off."""
    for batch in batches:
        if not batch.num_rows:
            continue
        plain, keys = batch.select(batch.schema.names[:-3]), batch.columns[-3:]
        codes = np.stack([k.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False) for k in keys])
        starts = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist()]
        for start, stop in zip(starts, [*starts[1:], batch.num_rows]):
            yield tuple(k[start].as_py() for k in keys), plain.slice(start, stop - start)


class _TreeFile:
    """A Parquet part, written batch by batch."""

    def __init__(self, sink, schema: pa.Schema, name: str, chunk_rows: int):
        import pyarrow.parquet as pq

        self.writer = pq.ParquetWriter(sink, schema, coerce_timestamps="us", allow_truncated_timestamps=True)

    @staticmethod
    def place(root: str, plat: str, day: str, salt: int, seq: int) -> str:
        return f"{root}/{plat}___full/daily_dumps_chunked/sor-{plat}-{day}-full/part-{salt}-{seq:05d}.parquet"

    def add(self, rows: pa.RecordBatch) -> None:
        self.writer.write_batch(rows)

    def close(self) -> None:
        self.writer.close()


class _ArchiveFile:
    """A zip of ``*.csv.zip`` members, each of at most ``chunk_rows`` rows; they are deflated already, so the outer zip stores them."""

    def __init__(self, sink, schema: pa.Schema, name: str, chunk_rows: int):
        self.outer, self.name, self.chunk_rows, self.n = zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED), name, chunk_rows, 0
        self.held, self.n_held = [], 0

    @staticmethod
    def place(root: str, plat: str, day: str, salt: int, seq: int) -> str:
        return f"{root}/{plat}___full/sor-{plat}-{day}-full-{salt}-{seq:05d}.zip"

    def add(self, rows: pa.RecordBatch) -> None:
        while rows.num_rows:
            some = rows.slice(0, self.chunk_rows - self.n_held)
            self.held.append(some)
            self.n_held += some.num_rows
            rows = rows.slice(some.num_rows)
            if self.n_held == self.chunk_rows:
                self._member()

    def _member(self) -> None:
        from pyarrow import csv

        body, inner_bytes = io.BytesIO(), io.BytesIO()
        csv.write_csv(pa.Table.from_batches(self.held), body)
        with zipfile.ZipFile(inner_bytes, "w", zipfile.ZIP_DEFLATED) as inner:
            inner.writestr(f"{self.name}-{self.n:05d}.csv", body.getvalue())
            inner.writestr("README.txt", b"not a csv member")
        self.outer.writestr(f"{self.name}-{self.n:05d}.csv.zip", inner_bytes.getvalue())
        self.held, self.n_held, self.n = [], 0, self.n + 1

    def close(self) -> None:
        if self.n_held:
            self._member()
        self.outer.writestr("checksums.txt", b"not an archive member")
        self.outer.close()


def _writer(root: str, kind: type, chunk_rows: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        key, seq, rows, done = None, 0, 0, []
        file = sink = place = tmp = fs = None

        def finish():
            file.close()
            sink.close()
            fs.move(tmp, place[1])
            done.append((place[0], rows))

        for now, part in _runs(batches):
            if file is not None and (now != key or rows >= ROWS_PER_FILE):
                finish()
                file, seq = None, seq + 1 if now == key else 0
            if file is None:
                if now != key:
                    key, seq = now, 0
                full = kind.place(root, *now, seq)
                fs, inner = open_fs(full)
                place, tmp, rows = (full, inner), f"{inner}.inprogress-{uuid.uuid4().hex}", 0
                fs.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                sink = fs.open_output_stream(tmp)
                file = kind(sink, part.schema, full.rsplit("/", 1)[1].rsplit(".", 1)[0], chunk_rows)
            file.add(part)
            rows += part.num_rows
        if file is not None:
            finish()
        yield pa.RecordBatch.from_pydict({"file": [f for f, _ in done], "rows": [n for _, n in done]}, pa.schema([("file", pa.string()), ("rows", pa.int64())]))

    return write


def _tree_files(dealt: DataFrame, root: str) -> DataFrame:
    ship_package(dealt.sparkSession)
    return dealt.mapInArrow(_writer(root.rstrip("/"), _TreeFile, 0), STATUS)


def _archive_files(dealt: DataFrame, root: str, chunk_rows: int = ROWS_PER_MEMBER) -> DataFrame:
    ship_package(dealt.sparkSession)
    columns = [F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in ("application_date", "content_date") else F.col(c) for c in S.ARCHIVE_COLUMNS]
    return dealt.select(*columns, *_KEYS).mapInArrow(_writer(root.rstrip("/"), _ArchiveFile, chunk_rows), STATUS)


def write_daily_tree(raw: DataFrame, root: str) -> DataFrame:
    """Write ``raw`` as a daily Parquet part tree; returns (file, rows) per written file."""
    return _tree_files(_dealt(raw), root)


def write_archives(raw: DataFrame, root: str, chunk_rows: int = 5_000) -> DataFrame:
    """Write ``raw`` as nested zip archives of CSV chunks; returns (file, rows)."""
    return _archive_files(_dealt(raw), root, chunk_rows)


def _stage_folder(spark: SparkSession, sf_dir: str, kind: str) -> str:
    """A folder named after the paths, lengths and times of the files that a stage is made from."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{sf_dir}/lineitem.parquet")
    inputs = found.agg(F.bit_xor(F.xxhash64("path", "length", F.col("modificationTime").cast("long")))).first()[0]
    return stage_root(spark, f"{kind}-v{STAGE_VERSION}-{(inputs or 0) & (2**64 - 1):016x}")


def _stage_table(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[str], object]) -> str:
    """The folder of a stage that Spark's writers make; its marker lies beside it."""
    root = _stage_folder(spark, sf_dir, kind)
    if not exists(f"{root}.whole"):
        write(root)
        write_bytes(f"{root}.whole", b"")
    return root


def _stage(spark: SparkSession, sf_dir: str, kind: str, write: Callable[[DataFrame, str], DataFrame]) -> str:
    """The folder of a stage; written and counted unless one of the same inputs is whole."""
    root = _stage_folder(spark, sf_dir, kind)
    if not exists(f"{root}/_SUCCESS"):
        dealt = _dealt_records(lineitem(spark, sf_dir))
        wrote, want = write(dealt, root).agg(F.sum("rows")).first()[0] or 0, sor_raw(spark, sf_dir).count()
        if wrote != want:
            raise OSError(f"{root} holds {wrote} rows of {want}")
        write_bytes(f"{root}/_SUCCESS", str(want).encode())
    return root


def staged_daily_tree(spark: SparkSession, sf_dir: str) -> str:
    """Root of the daily tree derived from ``sf_dir`` (written once for the same inputs)."""
    return _stage(spark, sf_dir, "daily-tree", _tree_files)


def staged_archives(spark: SparkSession, sf_dir: str) -> str:
    """Root of the nested archives derived from ``sf_dir`` (written once for the same inputs)."""
    return _stage(spark, sf_dir, "archives", _archive_files)


def staged_working(spark: SparkSession, sf_dir: str) -> str:
    """A stored working table (partitioned by version, platform, month) made from ``sf_dir``."""
    return _stage_table(spark, sf_dir, "working", lambda root: sinks.write_working(prep.working_dataset(sor_raw(spark, sf_dir)), root, "overwrite"))


def staged_working_clustered(spark: SparkSession, sf_dir: str) -> str:
    """As ``staged_working``, clustered by category and date inside the partitions."""
    return _stage_table(spark, sf_dir, "clustered", lambda root: sinks.write_working_clustered(prep.working_dataset(sor_raw(spark, sf_dir)), root, "overwrite"))


def staged_platform_tables(spark: SparkSession, sf_dir: str) -> str:
    """A folder with one stored working table per platform, without the version column."""

    def write(root: str) -> None:
        rows = prep.working_dataset(sor_raw(spark, sf_dir)).drop("api_version")
        label = F.lower(normalize_values("platform_name"))
        for platform in ("tiktok", "x"):
            sinks.write_partitioned(rows.filter(label == platform), f"{root}/{platform}", mode="overwrite")

    return _stage_table(spark, sf_dir, "platforms", write)


def staged_reduced_tree(spark: SparkSession, sf_dir: str) -> str:
    """The daily tree of ``sf_dir`` reduced to the kept columns; whole once it has the tree's rows."""
    tree = staged_daily_tree(spark, sf_dir)

    def write(root: str) -> None:
        parts.reduce_parts(spark, tree, root)
        want = parts.footers(parts.list_files(spark, tree)).agg(F.sum("footer_rows")).first()[0] or 0
        found = parts.written_parts(spark, root)
        wrote = (found.agg(F.sum("written_rows")).first()[0] or 0) if found is not None else 0
        if wrote != want:
            raise OSError(f"{root} holds {wrote} rows of {want}")

    return _stage_table(spark, sf_dir, "reduced", write)


def staged_mapping_csv(spark: SparkSession, sf_dir: str) -> str:
    """The taxonomy mapping as a CSV file."""
    return _stage_table(spark, sf_dir, "mapping", lambda root: sinks.write_small_csv(dims.mapping(spark), root))
