"""Daily-dump part files: load, list, footers, manifest, coverage, sampling
(S1-S8, S10, S14, S16-S18, A21).

Layout of the raw dumps: ``<root>/<platform dir>/daily_dumps_chunked/
sor-<platform>-<YYYY-MM-DD>-full/part-*.parquet``. The day is parsed from
the path (``_metadata.file_path`` for rows, the listing path for files), so
a restriction to a day prefix is a glob that prunes the listing itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..session import ship_package, stage_root
from .files import exists, open_fs

# Day-folder naming of the dumps.
DAY_FOLDER_RE = r"(sor-([A-Za-z0-9]+)-(\d{4}-\d{2}-\d{2})[^/]*)"


def part_glob(root: str, platform_dir: str | None = None, day_prefix: str | None = None) -> str:
    return f"{root.rstrip('/')}/{platform_dir or '*'}/daily_dumps_chunked/{day_prefix or 'sor-'}*/part-*.parquet"


def day_of(path: Column) -> Column:
    return F.to_date(F.regexp_extract(path, DAY_FOLDER_RE, 3))


def platform_of(path: Column) -> Column:
    return F.regexp_extract(path, DAY_FOLDER_RE, 2)


def relative_path(path: Column) -> Column:
    """The last two levels of a path (platform or day folder, file): the same wherever the tree stands."""
    return F.regexp_extract(path, r"((?:[^/]+/)?[^/]+)$", 1)


def day_folder_of(path: Column) -> Column:
    return F.regexp_extract(path, DAY_FOLDER_RE, 1)


def list_files(spark: SparkSession, root: str, glob: str = "*.parquet") -> DataFrame:
    """File listing as a DataFrame: path, length, modified, platform, day, day_folder.

    ``binaryFile`` without its ``content`` column reads no file bytes.
    """
    df = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length", F.col("modificationTime").alias("modified"))
    )
    p = F.col("path")
    return df.select("*", platform_of(p).alias("platform"), day_of(p).alias("day"), day_folder_of(p).alias("day_folder"))


def load_parts(
    spark: SparkSession,
    root: str,
    platform_dir: str | None = None,
    day_prefix: str | None = None,
    schema: T.StructType = S.RAW_SCHEMA,
    missing: str = "error",
) -> DataFrame:
    """Scan daily part files with a declared schema.

    Columns absent from a part read as null (raw and reduced parts coexist).
    ``day_prefix`` (e.g. ``sor-x-2025-02``) restricts the glob.
    ``missing="skip"`` returns an empty frame when nothing matches instead of
    raising. Adds ``source_file`` and ``dump_day``.
    """
    try:
        df = spark.read.schema(schema).parquet(part_glob(root, platform_dir, day_prefix))
    except Exception as e:  # noqa: BLE001 - Spark raises AnalysisException for an empty glob
        if missing == "skip" and ("PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)):
            return spark.createDataFrame([], T.StructType(schema.fields + [T.StructField("source_file", T.StringType()), T.StructField("dump_day", T.DateType())]))
        raise
    src = F.col("_metadata.file_path")
    return df.select("*", src.alias("source_file"), day_of(src).alias("dump_day"))


def load_platform_tables(
    spark: SparkSession,
    paths: dict[str, str],
    columns: Sequence[str] | None = None,
    label_col: str = "platform_name",
    missing: str = "error",
) -> DataFrame:
    """One stored table per platform, each tagged with its platform, unioned.

    ``paths`` maps a platform label to a Parquet path. ``columns`` prunes the
    scan (and an absent optional column such as ``api_version`` is simply not
    requested). The label overwrites any stored platform column, as the
    per-file constant does. ``missing="skip"`` drops absent tables instead of
    raising. Filters applied later push into every side of the union.
    """
    frames = []
    for label, path in paths.items():
        try:
            df = spark.read.parquet(path)
        except Exception as e:  # noqa: BLE001 - AnalysisException for a missing path
            if missing == "skip" and ("PATH_NOT_FOUND" in str(e) or "does not exist" in str(e)):
                continue
            raise
        if columns is not None:
            df = df.select(*[c for c in columns if c in df.columns and c != label_col])
        frames.append(df.withColumn(label_col, F.lit(label)))
    if not frames:
        raise FileNotFoundError("none of the platform tables exist: " + ", ".join(paths.values()))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


# ---------------------------------------------------------------------------
# Footers (S7, S8) and manifest
# ---------------------------------------------------------------------------

FOOTER_FIELDS = [
    T.StructField("footer_rows", T.LongType()),
    T.StructField("cols_in", T.LongType()),
    T.StructField("columns", T.ArrayType(T.StringType())),
    T.StructField("footer_error", T.StringType()),
]


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        rows, ncols, names_col, errors = [], [], [], []
        for path in batch["path"]:
            try:
                fs, p = open_fs(path)
                with fs.open_input_file(p) as f:
                    md = pq.ParquetFile(f).metadata
                    names = [md.schema.column(i).name for i in range(md.num_columns)]
                rows.append(int(md.num_rows))
                ncols.append(len(names))
                names_col.append(names)
                errors.append(None)
            except Exception as e:  # noqa: BLE001 - an unreadable part is reported, not fatal
                rows.append(None)
                ncols.append(None)
                names_col.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        out = batch.copy()
        out["footer_rows"] = pd.array(rows, dtype="Int64")
        out["cols_in"] = pd.array(ncols, dtype="Int64")
        out["columns"] = names_col
        out["footer_error"] = errors
        yield out


def footers(listing: DataFrame) -> DataFrame:
    """Listing + row count and column names of every file, from footers only.

    Each ``mapInPandas`` task opens the footers of its share of the listing
    and passes the listing columns through; no data pages are read and
    nothing is gathered on the driver.
    """
    ship_package(listing.sparkSession)
    return listing.mapInPandas(_read_footers, T.StructType(listing.schema.fields + FOOTER_FIELDS))


def schema_listing(df: DataFrame) -> DataFrame:
    """Column name and type of a frame as a two-column DataFrame."""
    spark = df.sparkSession
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in df.schema.fields], "column string, dtype string")


def part_of(path: Column) -> Column:
    """A part's file name without its extension: with the day folder, its identity in every tree."""
    return F.regexp_extract(path, r"([^/]+)\.parquet$", 1)


def written_parts(spark: SparkSession, dst_root: str) -> DataFrame | None:
    """(day_folder, part, written_rows) of the parts present in a reduced tree, rows from the footers; None without a tree."""
    if not exists(dst_root):
        return None
    path = F.col("path")
    keyed = footers(list_files(spark, dst_root)).select(F.regexp_extract(path, r"dump_folder=([^/]+)", 1).alias("day_folder"), F.regexp_extract(path, r"source_part=([^/]+)", 1).alias("part"), "footer_rows")
    # a file whose footer can't be read makes its part -1: not whole
    return keyed.groupBy("day_folder", "part").agg(F.when(F.count("footer_rows") == F.count(F.lit(1)), F.sum("footer_rows")).otherwise(F.lit(-1)).alias("written_rows"))


def manifest(
    listing: DataFrame,
    keep: Sequence[str] = S.KEEP_COLUMNS,
    written: DataFrame | None = None,
    dst_root: str | None = None,
    overwrite: bool = False,
    in_place: bool = False,
    dry_run: bool = False,
) -> DataFrame:
    """Per-file manifest of a reduction run (S7, S16, S17): the 7 manifest columns.

    ``status``: ``skipped_exists`` (this part is in the output already with all
    its rows, unless ``overwrite``), ``error_missing_columns:a,b``, ``skipped_already_reduced``
    (in place, columns already equal ``keep`` in order, unless ``overwrite``),
    ``dry_run`` with empty counts for what a real run would do, else
    ``processed`` / ``replaced_in_place``. ``rows`` comes from the footer.
    """
    keep_arr = F.array(*[F.lit(c) for c in keep])
    f = footers(listing).withColumn("part", part_of(F.col("path")))
    if written is not None and not overwrite:
        done = written.select(F.col("day_folder").alias("_day"), F.col("part").alias("_part"), F.col("written_rows").alias("_rows"))
        f = f.join(done, (f["day_folder"] == done["_day"]) & (f["part"] == done["_part"]), "left")
        f = f.withColumn("_done", F.when(F.col("_rows") == F.coalesce("footer_rows", "_rows"), F.lit(True)))
    else:
        f = f.withColumn("_done", F.lit(None).cast("boolean"))
    missing = F.array_except(keep_arr, F.coalesce(F.col("columns"), F.array().cast("array<string>")))
    status = (
        F.when(F.col("_done"), F.lit("skipped_exists"))
        .when(F.col("footer_error").isNotNull(), F.concat(F.lit("error_unreadable:"), F.col("footer_error")))
        .when(F.size(missing) > 0, F.concat(F.lit("error_missing_columns:"), F.array_join(missing, ",")))
        .when(F.lit(in_place and not overwrite) & (F.col("columns") == keep_arr), F.lit("skipped_already_reduced"))
        .otherwise(F.lit("dry_run" if dry_run else "replaced_in_place" if in_place else "processed"))
    )
    parts_of_output = [F.lit(f"{(dst_root or '').rstrip('/')}/dump_folder="), F.col("day_folder"), F.lit("/source_part="), F.col("part")]
    out_file = F.col("path") if in_place or not dst_root else F.concat(*parts_of_output)
    done = status.isin("processed", "replaced_in_place", "skipped_already_reduced")
    return f.select(
        F.col("path").alias("source_file"),
        out_file.alias("output_file"),
        status.alias("status"),
        F.when(done, F.col("footer_rows")).alias("rows"),
        F.when(F.col("_done").isNull() & (status != "dry_run"), F.col("cols_in")).alias("cols_in"),
        F.when(done, F.lit(len(keep)).cast("long")).alias("cols_out"),
        F.when(done, F.col("cols_in") - len(keep)).alias("dropped_cols"),
    )


def _recorded(spark: SparkSession, man: DataFrame, manifest_path: str | None, run_id: str | None, dry_run: bool) -> DataFrame:
    """The manifest, written before anything is copied, so that its decisions can't shift once output appears."""
    import uuid

    rid = run_id or uuid.uuid4().hex[:12]
    path = manifest_path or stage_root(spark, f"manifest-{rid}")
    man.withColumn("run_id", F.lit(rid)).withColumn("dry_run", F.lit(dry_run)).write.mode("append").parquet(path)
    return spark.read.parquet(path).filter(F.col("run_id") == rid).drop("run_id", "dry_run")


def reduce_parts(
    spark: SparkSession,
    src_root: str,
    dst_root: str,
    keep: Sequence[str] = S.KEEP_COLUMNS,
    overwrite: bool = False,
    dry_run: bool = False,
    manifest_path: str | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Project the part files to ``keep`` and write each under its day folder and part.

    Returns the manifest. Parts whole in the output are skipped unless
    ``overwrite`` (then they are replaced, as is a part that an interrupted
    run left short); a part that arrives later in a written day is written.
    The manifest's rows are dealt to tasks, so no list of paths passes through the
    driver. A task copies one part row group by row group to a temporary name, compares the
    rows with the footer and moves it into its folder, under a name fixed by the part: a
    retried task does no harm, and a part that can't be read to its end fails
    the run and leaves nothing in the output. Afterwards the rows written are
    compared with the footers part by part; only then is the manifest
    appended to ``manifest_path`` with a ``run_id``.
    """
    import uuid

    listing = list_files(spark, src_root).filter(F.col("path").rlike(r"part-[^/]*\.parquet$"))
    man = manifest(listing, keep, written_parts(spark, dst_root), dst_root, overwrite, dry_run=dry_run)
    man = _recorded(spark, man, None, uuid.uuid4().hex, dry_run)
    todo = man.filter(F.col("status") == "processed").select("source_file", "output_file")
    if not dry_run:
        ship_package(spark)
        if todo.repartition("source_file").mapInPandas(_copy_files(keep), "source_file string").count():
            _check_written(spark, man, dst_root)
    return _recorded(spark, man, manifest_path, run_id, dry_run) if manifest_path else man


def _check_written(spark: SparkSession, man: DataFrame, dst_root: str) -> None:
    """Raises unless each part marked ``processed`` is in the output with as many rows as its footer says."""
    path = F.col("source_file")
    want = man.filter(F.col("status") == "processed").select(day_folder_of(path).alias("day_folder"), part_of(path).alias("part"), "rows")
    found = written_parts(spark, dst_root)
    if found is None:
        raise OSError(f"{dst_root} was not written")
    short = want.join(found, ["day_folder", "part"], "left").filter(F.coalesce("written_rows", F.lit(0)) != F.col("rows"))
    bad = short.limit(5).collect()
    if bad:
        raise OSError(f"{dst_root}: parts not written whole, such as " + ", ".join(f"{r.day_folder}/{r.part} ({r.written_rows or 0} rows of {r.rows})" for r in bad))


def _projected(place: str, target_fs, tmp: str, keep: Sequence[str]) -> int:
    """A part's columns ``keep`` written to ``tmp``, row group by row group; returns the rows, raises if some were lost."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    fs, p = open_fs(place)
    with fs.open_input_file(p) as source:
        file = pq.ParquetFile(source)
        want = file.metadata.num_rows
        schema = pa.schema([file.schema_arrow.field(c) for c in keep])
        with target_fs.open_output_stream(tmp) as sink, pq.ParquetWriter(sink, schema) as writer:
            for group in range(file.num_row_groups):
                writer.write_table(file.read_row_group(group, columns=list(keep)).select(list(keep)))
    with target_fs.open_input_file(tmp) as check:
        if pq.ParquetFile(check).metadata.num_rows != want:
            raise OSError(f"{tmp}: rows were lost; {place} is unchanged")
    return want


def _replace_files(keep: Sequence[str]):
    def replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for batch in batches:
            for place in batch["source_file"]:
                fs, p = open_fs(place)
                tmp = f"{p}.inprogress-{uuid.uuid4().hex}"
                _projected(place, fs, tmp, keep)
                fs.move(tmp, p)
            yield batch

    return replace


def _copy_files(keep: Sequence[str]):
    """Copies (source_file, output_file): the output folder then holds the part's projection and nothing else."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow.fs import FileSelector

        for batch in batches:
            for place, folder in zip(batch["source_file"], batch["output_file"]):
                fs, p = open_fs(folder)
                fs.create_dir(p, recursive=True)
                tmp, target = f"{p}/_inprogress-{uuid.uuid4().hex}", f"{p}/part-00000.parquet"
                rows = 0
                try:
                    rows = _projected(place, fs, tmp, keep)
                finally:
                    if not rows:  # unreadable, or without rows: such a part has no file
                        fs.delete_file(tmp)
                if rows:
                    fs.move(tmp, target)
                for other in fs.get_file_info(FileSelector(p)):  # of an earlier run that was cut short
                    if other.is_file and other.base_name != "part-00000.parquet" and not other.base_name.startswith("_inprogress"):
                        fs.delete_file(other.path)
            yield batch[["source_file"]]

    return copy


def reduce_in_place(
    spark: SparkSession,
    root: str,
    keep: Sequence[str] = S.KEEP_COLUMNS,
    overwrite: bool = False,
    dry_run: bool = False,
    manifest_path: str | None = None,
    run_id: str | None = None,
) -> DataFrame:
    """Replace each part under ``root`` by its projection to ``keep`` (S15); returns the manifest.

    A task copies one part row group by row group to a temporary name beside
    it, compares the row counts and moves it over the part, so a part is
    whole at any time and a retried task does no harm.
    """
    listing = list_files(spark, root).filter(F.col("path").rlike(r"part-[^/]*\.parquet$"))
    man = _recorded(spark, manifest(listing, keep, overwrite=overwrite, in_place=True, dry_run=dry_run), manifest_path, run_id, dry_run)
    todo = man.filter(F.col("status") == "replaced_in_place").select("source_file")
    if not dry_run:
        ship_package(spark)
        todo.repartition("source_file").mapInPandas(_replace_files(keep), "source_file string").count()
    return man


# ---------------------------------------------------------------------------
# Coverage (A21) and reproducible file sample
# ---------------------------------------------------------------------------


def coverage_audit(listing: DataFrame) -> DataFrame:
    """Per platform and month: calendar days, day folders, non-empty days, files, missing days.

    The months run from January of the first day's year to December of the
    last one's, over all platforms; the calendar comes from ``sequence``
    exploded per platform, then meets the listing aggregate.
    """
    f = footers(listing).withColumn("month", F.trunc("day", "month"))
    per_month = f.groupBy("platform", "month").agg(
        F.countDistinct("day_folder").alias("day_folders"),
        F.countDistinct(F.when(F.col("footer_rows") > 0, F.col("day"))).alias("non_empty_days"),
        F.count(F.lit(1)).alias("files"),
    )
    first, last = (listing.select(F.trunc(edge("day"), "year").alias("d")).select("d").scalar() for edge in (F.min, F.max))
    months = F.sequence(first, F.add_months(last, 11), F.expr("INTERVAL 1 MONTH"))
    cal = listing.select("platform").distinct().select("platform", F.explode(months).alias("month"))
    cal = cal.withColumn("calendar_days", F.dayofmonth(F.last_day("month")))
    out = cal.join(per_month, ["platform", "month"], "left")
    return out.select(
        "platform",
        "month",
        "calendar_days",
        F.coalesce("day_folders", F.lit(0)).alias("day_folders"),
        F.coalesce("non_empty_days", F.lit(0)).alias("non_empty_days"),
        F.coalesce("files", F.lit(0)).alias("files"),
        (F.col("calendar_days") - F.coalesce("day_folders", F.lit(0))).alias("missing_days"),
    )


# 2**16 hash buckets: the only single-task steps below touch at most this many rows.
_SAMPLE_BUCKET_SHIFT = 44


def sample_hash(path: Column, seed: int) -> Column:
    """60 bits of the md5 of the seed and the path's last levels."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), relative_path(path))), 1, 15), 16, 10).cast("long")


def sample_files(listing: DataFrame, fraction: float = 0.5, seed: int = S.SAMPLE_SEED, group: Sequence[str] = ("platform",)) -> DataFrame:
    """Reproducible sample of exactly ``max(1, floor(n * fraction))`` files per group.

    Files are ranked by ``sample_hash`` (so the same tree elsewhere gives the
    same sample); the k lowest are kept. The rank is found without a global
    sort or a global window: counts per (group, top-16-bit hash bucket) locate
    the bucket holding the k-th file, files in lower buckets are kept outright
    and only that one bucket is ranked exactly. Same size and repeatable; not
    the same files as the study's Mersenne-Twister draw.
    """
    g = list(group)
    h = sample_hash(F.col("path"), seed)
    hashed = listing.select("*", h.alias("_h"), F.shiftright(h, _SAMPLE_BUCKET_SHIFT).alias("_b"))
    buckets = hashed.groupBy(*g, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tot = Window.partitionBy(*g)
    cum = buckets.select(
        *g,
        "_b",
        "_n",
        F.sum("_n").over(w).alias("_cum"),
        F.greatest(F.lit(1), F.floor(F.sum("_n").over(tot) * F.lit(fraction))).cast("long").alias("_k"),
    )
    cut = cum.filter(F.col("_cum") >= F.col("_k")).groupBy(*g).agg(
        F.min("_b").alias("_cut_b"),
        F.min_by(F.col("_k") - F.col("_cum") + F.col("_n"), F.col("_b")).alias("_cut_r"),
    )
    marked = hashed.join(cut, g, "inner")
    below = marked.filter(F.col("_b") < F.col("_cut_b"))
    edge = marked.filter(F.col("_b") == F.col("_cut_b"))
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(*g, "_b").orderBy("_h", relative_path(F.col("path"))))).filter(F.col("_r") <= F.col("_cut_r"))
    cols = listing.columns
    return below.select(*cols).unionByName(edge.select(*cols))
