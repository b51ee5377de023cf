"""Sinks: partitioned tables, staged overwrite, small CSV extracts, run metrics
(S12, S13, S15, S19).

Writes are Spark's own task-parallel writers. Nothing here deletes inputs;
an overwrite keeps the previous version beside the new one unless told not to.
"""

from __future__ import annotations

import datetime as _dt
import uuid as _uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas as S
from .functions.columns import month_text

WORKING_PARTITIONS = ["api_version", "platform_name", "month"]


# Upper bound of rows per written file (keeps files splittable and retries cheap).
MAX_RECORDS_PER_FILE = 5_000_000


def write_partitioned(df: DataFrame, path: str, partition_cols: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet write, one directory level per partition column.

    No shuffle before the write: each task sorts its own rows by the
    partition columns (Spark's partitioned writer does) and writes one file
    per directory it touches. Daily-dump input tasks touch about one
    directory each, so a repartition would only add a full shuffle.
    """
    df.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).partitionBy(*partition_cols).parquet(path)


def write_working(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Store the working dataset partitioned by version, platform and month.

    Analyses on one version or month then read only their directories
    (partition pruning), and the remaining predicates push into the scan.
    """
    write_partitioned(df.withColumn("month", month_text("application_date")), path, WORKING_PARTITIONS, mode)


def write_clustered(df: DataFrame, path: str, by: Sequence[str], partition_cols: Sequence[str] = (), mode: str = "errorifexists", row_group_bytes: int = 16 << 20) -> None:
    """Parquet write with the rows of a partition in ranges of ``by``, so that files and row groups hold few values each.

    One shuffle deals the rows by sampled ranges of (partition columns,
    ``by``), each task sorts its range, and a filter on leading columns of
    ``by`` skips row groups and pages by their smallest and largest values. Put
    the column with few values first and a fine one (a time) last: a value that
    holds a third of all rows is then split by the fine one over many files.
    Worth its shuffle for tables that are read often by such filters; otherwise
    ``write_partitioned`` needs none.
    """
    keys = [*partition_cols, *by]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt.write.mode(mode).option("maxRecordsPerFile", MAX_RECORDS_PER_FILE).option("parquet.block.size", row_group_bytes).partitionBy(*partition_cols).parquet(path)


def write_working_clustered(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The working table partitioned as by ``write_working``, clustered by category and date inside a partition."""
    write_clustered(df.withColumn("month", month_text("application_date")), path, ["category", "application_date"], WORKING_PARTITIONS, mode)


def read_working(spark: SparkSession, path: str) -> DataFrame:
    """Read a stored working table with its declared column order."""
    return spark.read.parquet(path).select(*S.WORKING_COLUMNS)


def write_small_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One CSV file with a header (S13). For small, already aggregated results only."""
    df.coalesce(1).write.mode(mode).option("header", True).csv(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def staged_overwrite(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    partition_cols: Sequence[str] = (),
    expect_rows: int | None = None,
    keep_previous: bool = True,
) -> str:
    """Replace the table at ``path`` with ``df``, even when ``df`` reads ``path``.

    Spark cannot overwrite a path it is reading. The new version is written
    to a staging directory next to the target, its row count checked from
    the written files (if ``expect_rows`` is given), and only then swapped
    in by two renames. The previous version is kept as ``<path>.prev-<id>``
    unless ``keep_previous=False``. Returns the staging id.
    """
    run = _uuid.uuid4().hex[:12]
    staging = f"{path.rstrip('/')}.staging-{run}"
    df.write.mode("errorifexists").partitionBy(*partition_cols).parquet(staging)
    if expect_rows is not None:
        got = spark.read.parquet(staging).count()
        if got != expect_rows:
            raise ValueError(f"staged write has {got} rows, expected {expect_rows}; target left unchanged")
    fs, target, jvm = _fs(spark, path)
    if fs.exists(target):
        prev = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.prev-{run}")
        if not fs.rename(target, prev):
            raise OSError(f"could not move {path} aside")
        if not keep_previous:
            fs.delete(prev, True)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(staging), target):
        raise OSError(f"could not move staging {staging} to {path}")
    return run


def current_version(spark: SparkSession, path: str) -> int:
    """Number of the version that readers get; 0 where nothing is committed.

    A record without content belongs to a run that is committing, or died
    while it did, and isn't a version.
    """
    fs, folder, _ = _fs(spark, f"{path.rstrip('/')}/_commits")
    records = fs.listStatus(folder) if fs.exists(folder) else []
    return max((int(r.getPath().getName()) for r in records if r.getPath().getName().isdigit() and r.getLen() > 0), default=0)


def read_version(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A committed version of the table at ``path``, the newest by default.

    The version is chosen once, here: a replacement that commits later doesn't
    change the frame, and there is no moment without a table.
    """
    number = version or current_version(spark, path)
    fs, record, _ = _fs(spark, f"{path.rstrip('/')}/_commits/{number:012d}")
    folder = spark.read.text(record.toString()).first() if number and fs.exists(record) else None
    if folder is None:
        raise FileNotFoundError(f"{path} has no version {number}" if number else f"{path} has no committed version")
    return spark.read.parquet(f"{path.rstrip('/')}/{folder[0]}")


def replace_version(
    spark: SparkSession,
    df: DataFrame,
    path: str,
    read: int | None = None,
    partition_cols: Sequence[str] = (),
    expect_rows: int | None = None,
) -> int:
    """Write ``df`` as the next version of the table at ``path``, even when ``df`` reads it.

    The rows go to a folder of their own; then a commit record with the next
    number is created only if absent. Readers resolve the newest record, so
    they see the old or the new table and never none. ``read`` is the version
    that ``df`` was made from: if another one was committed since, this write
    fails and leaves the table as it is. Without ``read`` the next free number
    is taken. A run that dies before its record leaves only an unused folder.
    The record is as exclusive as the file system's create (HDFS: atomic).
    """
    folder = f"v-{_uuid.uuid4().hex}"
    write_partitioned(df, f"{path.rstrip('/')}/{folder}", partition_cols)
    if expect_rows is not None:
        got = spark.read.parquet(f"{path.rstrip('/')}/{folder}").count()
        if got != expect_rows:
            raise ValueError(f"written version has {got} rows, expected {expect_rows}; table left unchanged")
    number = (current_version(spark, path) if read is None else read) + 1
    while True:
        fs, record, jvm = _fs(spark, f"{path.rstrip('/')}/_commits/{number:012d}")
        if not fs.exists(record):
            try:
                out = fs.create(record, False)
            except Exception:
                if not fs.exists(record):
                    raise
            else:
                out.write(bytearray(folder.encode()))
                out.close()
                return number
        if read is not None:
            raise RuntimeError(f"version {number} of {path} was committed by another run")
        number += 1


def record_metrics(metrics: DataFrame, path: str) -> None:
    """Put metric rows into the table at ``path``, a folder per run id, replaced as a whole.

    A run recorded again (a retry) replaces its own rows and no other run's,
    so every run is in the table exactly once however often it is tried.
    """
    metrics.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id", "description").parquet(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """The metrics table with its declared columns."""
    return spark.read.schema(S.METRICS_SCHEMA).parquet(path).select(*S.METRICS_SCHEMA.fieldNames())


def append_metrics(spark: SparkSession, path: str, description: str, metrics: dict[str, float], run_id: str | None = None) -> DataFrame:
    """Record run metrics (date, description, metric, value) in a Parquet table.

    Replaces the study's append-only markdown log; every row carries a
    ``run_id`` so repeated runs never overwrite each other.
    """
    rid = run_id or _uuid.uuid4().hex[:12]
    today = _dt.date.today()
    rows = [(rid, today, description, k, float(v)) for k, v in metrics.items()]
    df = spark.createDataFrame(rows, S.METRICS_SCHEMA)
    record_metrics(df, path)
    return df


def metrics_from(df: DataFrame, description: str, run_id: str | None = None) -> DataFrame:
    """Turn a one-row DataFrame of numeric results into metric rows, without collecting."""
    rid = run_id or _uuid.uuid4().hex[:12]
    numeric = [f.name for f in df.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "float", "short")]
    structs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numeric]
    return df.select(
        F.lit(rid).alias("run_id"),
        F.current_date().alias("run_date"),
        F.lit(description).alias("description"),
        F.inline(F.array(*structs)),
    )


def result_metrics(df: DataFrame, keys: Sequence[str], values: Sequence[str], description: str, run_id: str, upper: bool = False) -> DataFrame:
    """Rows of a small result as metric rows: metric = ``key1|key2|...|value column``, in capitals if ``upper``.

    A reshape of the result itself (no collect), ready for ``record_metrics``.
    """
    label = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    name = lambda v: F.upper(F.concat_ws("|", label, F.lit(v))) if upper else F.concat_ws("|", label, F.lit(v))
    structs = [F.struct(name(v).alias("metric"), F.col(v).cast("double").alias("value")) for v in values]
    return df.select(
        F.lit(run_id).alias("run_id"),
        F.current_date().alias("run_date"),
        F.lit(description).alias("description"),
        F.inline(F.array(*structs)),
    )
