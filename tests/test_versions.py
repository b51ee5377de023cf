"""Replacement by versions: a reader between any two steps has a table."""

import os

import pytest

from moderata import sinks


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_replace_a_table_read_by_itself(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path)
    assert sinks.replace_version(spark, spark.range(5), path) == 1
    old = sinks.read_version(spark, path)
    assert sinks.replace_version(spark, old.filter("id > 2"), path, read=1, expect_rows=2) == 2
    assert ids(sinks.read_version(spark, path)) == [3, 4]
    assert ids(old) == ids(sinks.read_version(spark, path, 1)) == [0, 1, 2, 3, 4]
    with pytest.raises(FileNotFoundError):
        sinks.read_version(spark, path, 7)


def test_reader_between_all_steps(spark, tmp_path, monkeypatch):
    path, seen = str(tmp_path / "t"), []
    sinks.replace_version(spark, spark.range(3), path)
    plain_write, plain_fs = sinks.write_partitioned, sinks._fs

    def watch(step):
        monkeypatch.setattr(sinks, "_fs", plain_fs)
        seen.append((step, ids(sinks.read_version(spark, path))))
        monkeypatch.setattr(sinks, "_fs", fs)

    def write(*args, **kw):
        watch("before rows")
        plain_write(*args, **kw)
        watch("rows written")

    def fs(session, p):
        watch("at " + os.path.basename(os.path.dirname(p)))
        return plain_fs(session, p)

    monkeypatch.setattr(sinks, "write_partitioned", write)
    monkeypatch.setattr(sinks, "_fs", fs)
    sinks.replace_version(spark, spark.range(9), path)
    assert len(seen) >= 4 and all(rows == [0, 1, 2] for _, rows in seen)
    monkeypatch.undo()
    assert ids(sinks.read_version(spark, path)) == list(range(9))


def test_second_writer_fails_and_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_version(spark, spark.range(2), path)
    sinks.replace_version(spark, spark.range(3), path, read=1)
    with pytest.raises(RuntimeError):
        sinks.replace_version(spark, spark.range(4), path, read=1)
    assert sinks.current_version(spark, path) == 2 and ids(sinks.read_version(spark, path)) == [0, 1, 2]


def test_unfinished_record_is_no_version(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_version(spark, spark.range(2), path)
    open(os.path.join(path, "_commits", f"{2:012d}"), "w").close()  # a run died here
    assert sinks.current_version(spark, path) == 1
    assert sinks.replace_version(spark, spark.range(5), path) == 3
    assert ids(sinks.read_version(spark, path)) == [0, 1, 2, 3, 4]


def test_short_write_is_not_committed(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_version(spark, spark.range(2), path)
    with pytest.raises(ValueError):
        sinks.replace_version(spark, spark.range(5), path, expect_rows=6)
    assert sinks.current_version(spark, path) == 1
