"""The driver loads __spark_entry__ by path, from another working directory,
with its own plain session: queries that run Python inside tasks must still
find the package on the executors."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").getOrCreate()
spec = importlib.util.spec_from_file_location("entry_mod", {os.path.join(ROOT, "__spark_entry__.py")!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
assert E.entry(spark).count() > 0
q = E.queries()
assert q["content_date_agreement_archives"](spark, "/root/testdata/sf0.001").count() > 0
assert q["file_manifest"](spark, "/root/testdata/sf0.001").count() > 0
print("ISOLATION_OK")
"""


def test_entry_from_foreign_cwd(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True, text=True, timeout=600, env={**os.environ, "PYTHONPATH": ""})
    assert "ISOLATION_OK" in out.stdout, out.stderr[-3000:]


def test_bench_prints_one_json_line(tmp_path):
    import json

    env = {**os.environ, "BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_QUERIES": "platform_ratio,version_split", "BENCH_REPEAT": "1", "BENCH_SLOPE": "0", "BENCH_CPUS": "4"}
    out = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], cwd=str(tmp_path), capture_output=True, text=True, timeout=600, env=env)
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout
    d = json.loads(lines[0])
    assert {"metric", "value", "unit", "queries", "sf"} <= d.keys() and d["unit"] == "sec"
    assert set(d["queries"]) == {"platform_ratio", "version_split"} and d["sf"] == 0.001
