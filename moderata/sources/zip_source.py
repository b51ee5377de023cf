"""Nested zip archives of CSV as a Spark data source, ``nested_zip_csv``.

``spark.read.format("nested_zip_csv").load(root)`` reads every ``*.csv`` of
every ``*.csv.zip`` of every ``*.zip`` below ``root`` as text columns
``archive``, ``member`` and those named in the option ``columns`` (by default
the three that the date check needs). A partition is one inner zip; planning
reads the archives' directories only, as Spark's own readers list files. A
schema given to the reader prunes columns: others are not parsed.

Filters (comparisons with text, ``IN``, null tests, contains, starts with,
ends with) are pushed: those on ``archive`` drop partitions before any task
starts, those on ``member`` skip CSV files, those on CSV columns drop rows
before they leave the task's reader. Needs ``spark.sql.python.filterPushdown.enabled``
(a session setting of this package); without it Spark filters by itself, with
the same rows.

Defined cases: a column that a file lacks is null, as is empty text; archives
without CSV members and a folder without archives have no rows; a column that
isn't text in the given schema is an error.
"""

from __future__ import annotations

import contextlib
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql.types import StringType, StructField, StructType

from .. import schemas as S
from ..session import ship_package
from .archives import _csv_blocks
from .files import open_fs

NAME = "nested_zip_csv"
#: Archive directories read at a time while a query is planned.
LISTERS = 16

_TESTS = {
    D.EqualTo: pc.equal, D.GreaterThan: pc.greater, D.GreaterThanOrEqual: pc.greater_equal, D.LessThan: pc.less, D.LessThanOrEqual: pc.less_equal,
    D.StringContains: pc.match_substring, D.StringStartsWith: pc.starts_with, D.StringEndsWith: pc.ends_with,
}


@dataclass
class InnerZip(D.InputPartition):
    archive: str
    inner: str


def _pushable(f: D.Filter) -> bool:
    if isinstance(f, D.Not):
        return _pushable(f.child)
    if len(f.attribute) != 1:
        return False
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return True
    if isinstance(f, D.In):
        return all(isinstance(v, str) for v in f.value)
    return type(f) in _TESTS and isinstance(f.value, str)


def _column(f: D.Filter) -> str:
    return _column(f.child) if isinstance(f, D.Not) else f.attribute[0]


def _verdict(f: D.Filter, values: pa.Array) -> pa.Array:
    """The filter's value for each text; null where SQL's is."""
    if isinstance(f, D.Not):
        return pc.invert(_verdict(f.child, values))
    if isinstance(f, (D.IsNull, D.IsNotNull)):
        return values.is_null() if isinstance(f, D.IsNull) else values.is_valid()
    if isinstance(f, D.In):
        return pc.if_else(values.is_valid(), pc.is_in(values, pa.array(f.value, pa.string())), None)
    return _TESTS[type(f)](values, f.value)


def _holds(f: D.Filter, text: str) -> bool:
    return _verdict(f, pa.array([text], pa.string()))[0].as_py() is True


class NestedZipReader(D.DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        if not all(isinstance(f.dataType, StringType) for f in schema):
            raise ValueError(f"{NAME} reads text columns only: {schema.simpleString()}")
        self.names, self.root, self.filters = schema.names, options.get("path"), []
        if not self.root:
            raise ValueError(f"{NAME} needs a path")

    def pushFilters(self, filters):
        for f in filters:
            if _pushable(f):
                self.filters.append(f)
            else:
                yield f

    def _on(self, *columns: str) -> list[D.Filter]:
        return [f for f in self.filters if _column(f) in columns]

    def partitions(self) -> list[InnerZip]:
        import pyarrow.fs as pafs

        fs, place = open_fs(self.root)
        prefix = self.root[: len(self.root) - len(place)] if self.root.endswith(place) else ""
        found = [prefix + i.path for i in fs.get_file_info(pafs.FileSelector(place, recursive=True)) if i.is_file and i.path.endswith(".zip")]
        wanted = [p for p in sorted(found) if all(_holds(f, p) for f in self._on("archive"))]

        def inner(path):
            opened, p = open_fs(path)
            with opened.open_input_file(p) as raw, zipfile.ZipFile(raw) as archive:
                return [InnerZip(path, e.filename) for e in archive.infolist() if e.filename.endswith(".csv.zip")]

        with ThreadPoolExecutor(LISTERS) as pool:
            return [part for parts in pool.map(inner, wanted) for part in parts]

    def read(self, partition: InnerZip) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a root without partitions is planned as one empty task
            return
        fs, p = open_fs(partition.archive)
        tested = self._on(*(set(map(_column, self.filters)) - {"archive", "member"}))
        parsed = list(dict.fromkeys(c for c in [*self.names, *map(_column, tested)] if c not in ("archive", "member")))
        with contextlib.ExitStack() as opened:
            archive = opened.enter_context(zipfile.ZipFile(opened.enter_context(fs.open_input_file(p))))
            nested = opened.enter_context(zipfile.ZipFile(opened.enter_context(archive.open(partition.inner))))
            for entry in nested.infolist():
                member = f"{partition.inner}/{entry.filename}"
                if not entry.filename.endswith(".csv") or not all(_holds(f, member) for f in self._on("member")):
                    continue
                for block in _csv_blocks(opened.enter_context(nested.open(entry)), parsed):
                    for f in tested:
                        block = block.filter(_verdict(f, block.column(_column(f))))
                    fixed = {"archive": partition.archive, "member": member}
                    columns = [pa.repeat(fixed[c], block.num_rows) if c in fixed else block.column(c) for c in self.names]
                    if block.num_rows:
                        yield pa.RecordBatch.from_arrays(columns, self.names)


class NestedZipCsv(D.DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        columns = [c.strip() for c in self.options.get("columns", ",".join(S.ARCHIVE_COLUMNS)).split(",")]
        return StructType([StructField(c, StringType()) for c in ["archive", "member", *columns]])

    def reader(self, schema: StructType) -> NestedZipReader:
        return NestedZipReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes ``nested_zip_csv`` known to the session; again is harmless."""
    ship_package(spark)
    spark.dataSource.register(NestedZipCsv)
