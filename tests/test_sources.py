"""File sources and sinks on generated fixtures (daily part tree, nested
archives, staged overwrite, metrics, sampling)."""

import datetime as dt
import io
import os
import zipfile

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from moderata import schemas as S
from moderata import sinks
from moderata.functions import filters as P
from moderata.operators import funnel
from moderata.sources import archives, parts, staging
from moderata.sources.fixture import sor_raw

from sf_paths import SF_SMALL


def _part(path, rows, columns=None):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    cols = columns or S.KEEP_COLUMNS
    df = pd.DataFrame(rows, columns=cols)
    schema = pa.schema([(c, pa.timestamp("ms") if c == "application_date" else pa.string()) for c in cols])
    pq.write_table(pa.Table.from_pandas(df, schema=schema, preserve_index=False), path)


def _row(uuid, day, platform="TikTok", scope='["DE"]'):
    return {
        "uuid": uuid,
        "category": "STATEMENT_CATEGORY_VIOLENCE",
        "content_type": '["CONTENT_TYPE_TEXT"]',
        "automated_detection": "Yes",
        "automated_decision": "AUTOMATED_DECISION_FULLY",
        "territorial_scope": scope,
        "application_date": pd.Timestamp(day),
        "platform_name": platform,
        "decision_visibility": None,
        "decision_facts": "extra raw column",
    }


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("dumps"))
    raw_cols = S.KEEP_COLUMNS + ["decision_facts"]
    t = f"{root}/tiktok___full/daily_dumps_chunked"
    x = f"{root}/x___full/daily_dumps_chunked"
    _part(f"{t}/sor-tiktok-2025-01-01-full/part-0000.parquet", [_row("a", "2025-01-01"), _row("b", "2025-01-01")], raw_cols)
    _part(f"{t}/sor-tiktok-2025-01-01-full/part-0001.parquet", [_row("c", "2025-01-01")], raw_cols)
    _part(f"{t}/sor-tiktok-2025-01-02-full/part-0000.parquet", [_row("d", "2025-01-02", scope='["FR"]')], raw_cols)
    _part(f"{t}/sor-tiktok-2025-02-01-full/part-0000.parquet", [], raw_cols)  # empty day
    _part(f"{x}/sor-x-2025-02-03-full/part-0000.parquet", [_row("e", "2025-02-03", "X")], raw_cols)
    bad = [{k: v for k, v in _row("f", "2025-02-04", "X").items() if k != "category"}]
    _part(f"{x}/sor-x-2025-02-04-full/part-0000.parquet", bad, [c for c in raw_cols if c != "category"])
    reduced = [{k: v for k, v in _row("g", "2025-02-05", "X").items() if k in S.KEEP_COLUMNS}]
    _part(f"{x}/sor-x-2025-02-05-full/part-0000.parquet", reduced, S.KEEP_COLUMNS)
    return root


def test_load_parts_schema_day_and_prefix(spark, tree):
    df = parts.load_parts(spark, tree)
    assert df.count() == 7
    assert {r["dump_day"] for r in df.select("dump_day").distinct().collect()} == {
        dt.date(2025, 1, 1), dt.date(2025, 1, 2), dt.date(2025, 2, 3), dt.date(2025, 2, 4), dt.date(2025, 2, 5)
    }
    # the part without `category` reads null there (declared schema)
    assert df.filter(F.col("uuid") == "f").first()["category"] is None
    x_feb = parts.load_parts(spark, tree, "x___full", "sor-x-2025-02")
    assert x_feb.count() == 3
    empty = parts.load_parts(spark, tree, "x___full", "sor-x-2024", missing="skip")
    assert empty.count() == 0
    with pytest.raises(Exception):
        parts.load_parts(spark, tree, "x___full", "sor-x-2024").count()


def test_working_from_parts_pushes_scope(spark, tree):
    from moderata.plans import prep

    w = prep.working_dataset(parts.load_parts(spark, tree))
    assert sorted(r["uuid"] for r in w.collect()) == ["a", "b", "c", "e", "f", "g"]


def test_manifest_statuses(spark, tree):
    listing = parts.list_files(spark, tree)
    man = {os.path.basename(os.path.dirname(r["source_file"])) + "/" + os.path.basename(r["source_file"]): r for r in parts.manifest(listing).collect()}
    assert len(man) == 7
    ok = man["sor-tiktok-2025-01-01-full/part-0000.parquet"]
    assert (ok["status"], ok["rows"], ok["cols_in"], ok["cols_out"], ok["dropped_cols"]) == ("processed", 2, 10, 9, 1)
    assert man["sor-x-2025-02-04-full/part-0000.parquet"]["status"] == "error_missing_columns:category"
    assert man["sor-x-2025-02-04-full/part-0000.parquet"]["rows"] is None
    inplace = {r["source_file"].rsplit("/", 2)[-2]: r["status"] for r in parts.manifest(listing, in_place=True).collect()}
    assert inplace["sor-x-2025-02-05-full"] == "skipped_already_reduced"
    assert inplace["sor-x-2025-02-03-full"] == "replaced_in_place"


def test_reduce_parts_then_skip_existing(spark, tree, tmp_path):
    dst = str(tmp_path / "reduced")
    man = parts.reduce_parts(spark, tree, dst, dry_run=True)
    assert not os.path.exists(dst)
    planned = man.filter(F.col("status") == "dry_run")
    assert planned.count() == 6 and planned.filter("rows is not null or cols_in is not null or cols_out is not null").isEmpty()
    parts.reduce_parts(spark, tree, dst)
    out = spark.read.parquet(dst)
    assert sorted(out.columns) == sorted(S.KEEP_COLUMNS + ["dump_folder", "source_part"])
    assert out.count() == 6  # the part missing `category` is not copied
    mpath = str(tmp_path / "manifests")
    again = {r["source_file"].rsplit("/", 2)[-2]: r["status"] for r in parts.reduce_parts(spark, tree, dst, manifest_path=mpath, run_id="r2").collect()}
    parts.reduce_parts(spark, tree, dst, manifest_path=mpath, run_id="r3")
    logged = spark.read.parquet(mpath)
    assert logged.select("run_id").distinct().count() == 2 and logged.count() == 14
    # an empty part writes no file, so it is (harmlessly) processed again
    assert again.pop("sor-tiktok-2025-02-01-full") == "processed"
    assert set(again.values()) == {"skipped_exists", "error_missing_columns:category"}
    assert spark.read.parquet(dst).count() == 6


def test_reduce_parts_writes_a_late_part_of_a_written_day(spark, tmp_path):
    root, dst = str(tmp_path / "late"), str(tmp_path / "late-reduced")
    cols = list(_row("a", "2025-01-01", "TikTok"))
    day = f"{root}/tiktok___full/daily_dumps_chunked/sor-tiktok-2025-01-01-full"
    _part(f"{day}/part-0000.parquet", [_row(u, "2025-01-01", "TikTok") for u in "ab"], cols)
    parts.reduce_parts(spark, root, dst)
    assert spark.read.parquet(dst).count() == 2
    _part(f"{day}/part-0001.parquet", [_row(u, "2025-01-01", "TikTok") for u in "cde"], cols)
    status = {r["source_file"].rsplit("/", 1)[1]: r["status"] for r in parts.reduce_parts(spark, root, dst).collect()}
    assert status == {"part-0000.parquet": "skipped_exists", "part-0001.parquet": "processed"}
    assert sorted(r.uuid for r in spark.read.parquet(dst).collect()) == list("abcde")
    # overwriting replaces every part once more
    parts.reduce_parts(spark, root, dst, overwrite=True)
    assert sorted(r.uuid for r in spark.read.parquet(dst).collect()) == list("abcde")


def test_reduce_in_place(spark, tmp_path):
    root = str(tmp_path / "place")
    cols = list(_row("a", "2025-01-01", "TikTok"))
    day = f"{root}/tiktok___full/daily_dumps_chunked/sor-tiktok-2025-01-01-full"
    _part(f"{day}/part-0000.parquet", [_row(u, "2025-01-01", "TikTok") for u in "abc"], cols)
    dry = parts.reduce_in_place(spark, root, dry_run=True).first()
    assert dry["status"] == "dry_run" and dry["rows"] is None and len(spark.read.parquet(day).columns) == len(cols)
    first = parts.reduce_in_place(spark, root).first()
    assert (first["status"], first["rows"], first["output_file"]) == ("replaced_in_place", 3, first["source_file"])
    again = spark.read.parquet(day)
    assert again.columns == S.KEEP_COLUMNS and sorted(r.uuid for r in again.collect()) == list("abc")
    assert parts.reduce_in_place(spark, root).first()["status"] == "skipped_already_reduced"
    assert parts.reduce_in_place(spark, root, overwrite=True).first()["status"] == "replaced_in_place"
    assert os.listdir(day) and not [f for f in os.listdir(day) if "inprogress" in f]


def test_sample_does_not_depend_on_the_root(spark):
    def picked(root):
        names = spark.range(20).select(F.format_string(f"{root}/tiktok___full/sor-tiktok-%03d-full.zip", "id").alias("path"), F.lit("TikTok").alias("platform"))
        return sorted(r.path.rsplit("/", 1)[1] for r in parts.sample_files(names).collect())

    assert picked("file:/a") == picked("file:/another/place") and len(picked("file:/a")) == 10


def test_coverage_audit_reports_other_years(spark):
    days = [("x", "2024-12-31"), ("x", "2025-02-01")]
    listing = spark.createDataFrame([(p, dt.date.fromisoformat(d), f"sor-x-{d}-full", "/none.parquet") for p, d in days], "platform string, day date, day_folder string, path string")
    got = {r["month"]: r["files"] for r in parts.coverage_audit(listing).collect()}
    assert len(got) == 24 and got[dt.date(2024, 12, 1)] == 1 and got[dt.date(2025, 2, 1)] == 1


def test_missing_shared_folder_is_an_error_off_local():
    from moderata import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "yarn"

        def getConf(self):
            return Conf()

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_dir(Session())


def test_coverage_audit(spark, tree):
    cov = {(r["platform"], r["month"]): r for r in parts.coverage_audit(parts.list_files(spark, tree)).collect()}
    assert len(cov) == 24
    jan = cov[("tiktok", dt.date(2025, 1, 1))]
    assert (jan["calendar_days"], jan["day_folders"], jan["non_empty_days"], jan["files"], jan["missing_days"]) == (31, 2, 2, 3, 29)
    feb = cov[("tiktok", dt.date(2025, 2, 1))]
    assert (feb["day_folders"], feb["non_empty_days"], feb["files"]) == (1, 0, 1)
    assert cov[("x", dt.date(2025, 3, 1))]["files"] == 0


def test_sample_files_exact_size_and_repeatable(spark):
    listing = spark.range(1001).select(F.format_string("file:/d/f%05d.zip", "id").alias("path"), F.when(F.col("id") < 900, "a").otherwise("b").alias("platform"))
    s1 = parts.sample_files(listing)
    got = {r["platform"]: r["n"] for r in s1.groupBy("platform").agg(F.count("*").alias("n")).collect()}
    assert got == {"a": 450, "b": 50}
    s2 = parts.sample_files(listing)
    assert sorted(r.path for r in s1.collect()) == sorted(r.path for r in s2.collect())
    other = parts.sample_files(listing, seed=7)
    assert sorted(r.path for r in s1.collect()) != sorted(r.path for r in other.collect())
    one = parts.sample_files(listing.limit(1))
    assert one.count() == 1  # max(1, n // 2)
    # the kept files are exactly the lowest hashes
    h = listing.filter(F.col("platform") == "a").select("path", parts.sample_hash(F.col("path"), 42).alias("h")).orderBy("h", "path").limit(450)
    assert sorted(r.path for r in h.collect()) == sorted(r.path for r in s1.filter(F.col("platform") == "a").collect())


def _zip_fixture(root):
    os.makedirs(root, exist_ok=True)
    csv1 = "content_date,application_date,territorial_scope,other\n2025-01-01,2025-01-01,\"[\"\"DE\"\"]\",x\n2025-01-01,2025-01-02,\"[\"\"DE\"\",\"\"FR\"\"]\",y\n,2025-01-03,\"[\"\"DE\"\"]\",z\n"
    csv2 = "application_date,content_date,territorial_scope\nnot-a-date,2025-01-01,\"[\"\"DE\"\"]\"\n2025-03-01 00:00:00,2025-02-28 00:00:00,\"[\"\"DE\"\"]\"\n2025-03-01,2025-03-01,\"[\"\"FR\"\"]\"\n2024-12-31,2024-12-31,\"[\"\"DE\"\"]\"\n"
    for name, members in {"day1.zip": {"a.csv.zip": {"a.csv": csv1, "notes.txt": "skip"}}, "day2.zip": {"b.csv.zip": {"b.csv": csv2}, "stray.txt": None}}.items():
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as outer:
            for inner_name, inner_members in members.items():
                if inner_members is None:
                    outer.writestr(inner_name, "not an archive")
                    continue
                ib = io.BytesIO()
                with zipfile.ZipFile(ib, "w") as inner:
                    for n, text in inner_members.items():
                        inner.writestr(n, text)
                outer.writestr(inner_name, ib.getvalue())
        with open(os.path.join(root, name), "wb") as fh:
            fh.write(buf.getvalue())


def test_nested_zip_reader_and_agreement(spark, tmp_path):
    root = str(tmp_path / "zips")
    _zip_fixture(root)
    rows = archives.read_nested_zip_csv(spark, archives.list_archives(spark, root))
    assert rows.columns == ["archive", "member", "content_date", "application_date", "territorial_scope"]
    assert rows.count() == 7
    typed = archives.typed_dates(rows.filter(P.scope_contains("territorial_scope")), ["application_date", "content_date"])
    assert typed.filter(F.col("application_date").isNull()).count() == 1  # malformed -> null
    kept = typed.filter(P.date_between("application_date")).withColumn("g", F.lit("all"))
    got = {r["status"]: r["n"] for r in funnel.agreement_counts(kept, "content_date", "application_date", ["g"]).collect()}
    assert got == {"null": 1, "equal": 1, "different": 2}


def test_staged_tree_and_archives_match_table(spark):
    root = staging.staged_daily_tree(spark, SF_SMALL)
    assert os.path.exists(root.replace("file:", "") + "/_SUCCESS")
    tree_rows = parts.load_parts(spark, root).count()
    assert tree_rows == sor_raw(spark, SF_SMALL).count()
    again = staging.staged_daily_tree(spark, SF_SMALL)
    assert again == root
    aroot = staging.staged_archives(spark, SF_SMALL)
    arows = archives.read_nested_zip_csv(spark, archives.list_archives(spark, aroot))
    assert arows.count() == tree_rows


def test_staged_overwrite_from_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(10).write.parquet(path)
    src = spark.read.parquet(path)
    sinks.staged_overwrite(spark, src.filter(F.col("id") < 4), path, expect_rows=4)
    assert spark.read.parquet(path).count() == 4
    prev = [p for p in os.listdir(tmp_path) if p.startswith("t.prev-")]
    assert len(prev) == 1 and spark.read.parquet(str(tmp_path / prev[0])).count() == 10
    with pytest.raises(ValueError):
        sinks.staged_overwrite(spark, spark.read.parquet(path), path, expect_rows=99)
    assert spark.read.parquet(path).count() == 4


def test_metrics_append_and_csv(spark, tmp_path):
    path = str(tmp_path / "metrics")
    sinks.append_metrics(spark, path, "run one", {"rows": 10, "kept": 7})
    sinks.append_metrics(spark, path, "run two", {"rows": 11})
    m = spark.read.parquet(path)
    assert m.count() == 3 and m.select("run_id").distinct().count() == 2
    one = spark.createDataFrame([(5, 2.5)], "a long, b double")
    assert sorted((r["metric"], r["value"]) for r in sinks.metrics_from(one, "d").collect()) == [("a", 5.0), ("b", 2.5)]
    out = str(tmp_path / "csv")
    sinks.write_small_csv(one, out)
    assert spark.read.option("header", True).csv(out).count() == 1


def test_write_working_partitions(spark, tmp_path):
    from moderata.plans import prep

    path = str(tmp_path / "working")
    sinks.write_working(prep.working_dataset(sor_raw(spark, SF_SMALL)), path)
    versions = sorted(p for p in os.listdir(path) if p.startswith("api_version="))
    assert versions == ["api_version=v1", "api_version=v2"]
    assert sinks.read_working(spark, path).count() == prep.working_dataset(sor_raw(spark, SF_SMALL)).count()


def test_typed_mapping_csv_roundtrip(spark, tmp_path):
    from moderata.operators import harmonize
    from moderata.sources import dims

    out = str(tmp_path / "mapping_csv")
    sinks.write_small_csv(dims.mapping(spark), out)
    back = dims.read_mapping_csv(spark, out)
    assert back.schema == S.MAPPING_SCHEMA or [f.name for f in back.schema.fields] == S.MAPPING_SCHEMA.fieldNames()
    assert back.exceptAll(dims.mapping(spark)).count() == 0 and dims.mapping(spark).exceptAll(back).count() == 0
    assert harmonize.unique_mapping(back).count() == len(S.MAPPING)


def test_one_big_archive_spreads_over_tasks(spark, tmp_path):
    """A single archive holding all rows is read member by member in several tasks."""
    root = tmp_path / "big"
    root.mkdir()
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as outer:
        for i in range(8):
            rows = "".join(f"2025-01-0{1 + j % 9},2025-01-0{1 + j % 9},\"[\"\"DE\"\"]\"\n" for j in range(50))
            ib = io.BytesIO()
            with zipfile.ZipFile(ib, "w") as inner:
                inner.writestr(f"m{i}.csv", "content_date,application_date,territorial_scope\n" + rows)
            outer.writestr(f"m{i}.csv.zip", ib.getvalue())
    (root / "day.zip").write_bytes(buf.getvalue())
    rows = archives.read_nested_zip_csv(spark, archives.list_archives(spark, str(root)))
    assert rows.count() == 400
    assert rows.select(F.spark_partition_id()).distinct().count() >= 2
    assert rows.select("member").distinct().count() == 8


def test_load_platform_tables(spark, tmp_path):
    from moderata.plans import prep

    working = prep.working_dataset(sor_raw(spark, SF_SMALL))
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    working.filter(F.col("platform_name") == "TikTok").write.parquet(a)
    working.filter(F.col("platform_name") != "TikTok").drop("api_version").write.parquet(b)  # an older file without api_version
    both = parts.load_platform_tables(spark, {"TikTok": a, "X": b}, ["category", "api_version", "platform_name"])
    assert both.count() == working.count()
    assert sorted(r[0] for r in both.select("platform_name").distinct().collect()) == ["TikTok", "X"]
    assert both.filter(F.col("platform_name") == "X").filter(F.col("api_version").isNull()).count() == working.filter(F.col("platform_name") != "TikTok").count()
    only = parts.load_platform_tables(spark, {"TikTok": a, "Y": str(tmp_path / "missing")}, missing="skip")
    assert only.select("platform_name").distinct().count() == 1
    with pytest.raises(Exception):
        parts.load_platform_tables(spark, {"Y": str(tmp_path / "missing")})


def test_run_analyses_job(spark, tmp_path):
    from moderata.plans import jobs, prep
    from moderata.plans import queries as Q

    wpath = str(tmp_path / "working")
    sinks.write_working(prep.working_dataset(sor_raw(spark, SF_SMALL)), wpath)
    out = str(tmp_path / "results")
    r1 = jobs.run_analyses(spark, wpath, out)
    r2 = jobs.run_analyses(spark, wpath, out)
    assert r1 != r2
    top = spark.read.option("header", True).csv(f"{out}/top_category")
    assert top.count() == Q.top_category(spark, SF_SMALL).count()
    m = spark.read.parquet(f"{out}/run_metrics")
    assert m.select("run_id").distinct().count() == 2
    one = m.filter((F.col("run_id") == r1) & (F.col("description") == "top_category")).collect()
    expect = {(f"{r['platform_name']}|{r['top_category']}|top_pct", r["top_pct"]) for r in Q.top_category(spark, SF_SMALL).collect()}
    assert {(r["metric"], r["value"]) for r in one} == expect


def test_schema_listing_and_typed_csv(spark, tmp_path):
    from moderata.sources import dims

    df = sor_raw(spark, SF_SMALL)
    listing = {r["column"]: r["dtype"] for r in parts.schema_listing(df).collect()}
    assert listing["application_date"] == "timestamp_ntz" and listing["score"] == "double" and len(listing) == 13
    out = str(tmp_path / "m")
    sinks.write_small_csv(spark.createDataFrame([("a", 1.5)], "metric string, value double"), out)
    back = dims.read_typed_csv(spark, out, "metric string, value double")
    assert [tuple(r) for r in back.collect()] == [("a", 1.5)]
