"""Value ranges answered from Parquet footers.

The row-group statistics of a part give the smallest and largest value of a
column without a data page being read. Row groups without statistics are read,
that column alone, so the answer is exact in any case. Tasks open the footers
of their share of the listing; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .files import open_fs


def row_group_range(file, group: int, column: str):
    """(smallest, largest, whether data was read) of a column in a row group; nulls when it has no value."""
    import pyarrow.compute as pc

    meta = file.metadata.row_group(group)
    names = [meta.column(i).path_in_schema for i in range(meta.num_columns)]
    if column not in names or not meta.num_rows:
        return None, None, False
    stats = meta.column(names.index(column)).statistics
    if stats is not None and stats.has_min_max:
        return stats.min, stats.max, False
    if stats is not None and stats.has_null_count and stats.null_count == meta.num_rows:
        return None, None, False
    both = pc.min_max(file.read_row_group(group, columns=[column]).column(0)).as_py()
    return both["min"], both["max"], True


def column_ranges(listing: DataFrame, column: str, dtype: T.DataType) -> DataFrame:
    """``listing`` with ``smallest``, ``largest`` (of ``dtype``), ``row_groups`` and ``groups_read`` of every file.

    A file that lacks the column, or has only nulls in it, gives nulls.
    """
    ship_package(listing.sparkSession)
    fields = [T.StructField("smallest", dtype), T.StructField("largest", dtype), T.StructField("row_groups", T.LongType()), T.StructField("groups_read", T.LongType())]
    at = listing.columns.index("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(dtype)
        for batch in batches:
            found = []
            for path in batch.column(at).to_pylist():
                fs, inside = open_fs(path)
                with fs.open_input_file(inside) as handle:
                    file = pq.ParquetFile(handle)
                    groups = [row_group_range(file, g, column) for g in range(file.metadata.num_row_groups)]
                low, high = [g[0] for g in groups if g[0] is not None], [g[1] for g in groups if g[1] is not None]
                found.append((min(low, default=None), max(high, default=None), len(groups), sum(g[2] for g in groups)))
            more = [pa.array([f[i] for f in found], type=t) for i, t in enumerate((kind, kind, pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *[f.name for f in fields]])

    return listing.mapInArrow(run, T.StructType(listing.schema.fields + fields))


def date_range(listing: DataFrame, column: str, keys: list[str], dtype: T.DataType) -> DataFrame:
    """Earliest and latest ``column`` per ``keys`` of the listing, from the footers."""
    return column_ranges(listing, column, dtype).groupBy(*keys).agg(F.min("smallest").alias("earliest"), F.max("largest").alias("latest"))
