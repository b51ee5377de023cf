"""Steps that grew faster than the tables: what they shuffle, and how many tasks they need."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from moderata import schemas as S
from moderata.operators import profile
from moderata.sources import staging
from moderata.sources.fixture import LINEITEM_COLUMNS, sor_columns, with_duplicates


def _items(spark, n, suppliers=5, days=400):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 50 != 7, (i % days) * 1000 + 1).alias("l_orderkey"),
        (i * 7 % 997).alias("l_partkey"),
        F.when(i % 60 != 9, i % suppliers).alias("l_suppkey"),
        F.lit(1).cast("int").alias("l_linenumber"),
        (i % 50).cast("double").alias("l_quantity"),
        F.lit("A").alias("l_returnflag"),
        F.lit("F").alias("l_linestatus"),
    )


def test_profile_does_not_deal_values_by_column(spark):
    df = spark.range(500).select((F.col("id") % 2).cast("string").alias("g"), F.concat(F.lit("u"), "id").alias("u"), (F.col("id") % 7).cast("double").alias("x"))
    out = profile.profile(df, ["u", "x"], ["g"], exact=True)
    found = {(r["g"], r["column"]): (r["unique_count"], r["variance"]) for r in out.collect()}
    exact = {r["g"]: round(r["v"], 6) for r in df.groupBy("g").agg(F.var_samp("x").alias("v")).collect()}
    assert found == {**{(g, "x"): (7, v) for g, v in exact.items()}, **{(g, "u"): (250, None) for g in exact}}
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan


def test_stages_deal_narrow_rows(spark):
    li = _items(spark, 3000)
    dealt = staging._dealt_records(li)
    want = staging._dealt(with_duplicates(sor_columns(li)))
    assert dealt.columns == want.columns and sorted(map(str, dealt.collect())) == sorted(map(str, want.collect()))
    rows = dealt.select(F.spark_partition_id().alias("p"), F.struct(*staging._KEYS, "uuid").alias("now")).collect()
    key = lambda r: tuple((x is not None, x) for x in r["now"])
    assert all(a["p"] != b["p"] or key(a) <= key(b) for a, b in zip(rows, rows[1:]))
    files = {(r["p"], key(r)[:3]) for r in rows}
    assert len(files) == len({f for _, f in files})
    exchanges = []

    def walk(node):
        if node.nodeName().startswith("Exchange") or "RepartitionByExpression" in node.nodeName():
            exchanges.append({a.name() for a in _seq(node.output())})
        for c in _seq(node.children()):
            walk(c)

    def _seq(s):
        return [s.apply(k) for k in range(s.size())]

    walk(dealt._jdf.queryExecution().optimizedPlan())
    assert len(exchanges) == 1 and exchanges[0] <= {*LINEITEM_COLUMNS, "_file"}  # the literals of this test are folded


def test_archive_members_are_filled_across_batches(spark, tmp_path):
    raw = with_duplicates(sor_columns(_items(spark, 30_000, suppliers=1, days=1).filter("l_orderkey is not null and l_suppkey is not null")))
    wrote = staging._archive_files(staging._dealt(raw), str(tmp_path)).collect()
    members = 0
    for r in wrote:
        with zipfile.ZipFile(r["file"]) as outer:
            inner = [e for e in outer.infolist() if e.filename.endswith(".csv.zip")]
            assert all(e.compress_type == zipfile.ZIP_STORED for e in inner)
            members += len(inner)
    assert sum(r["rows"] for r in wrote) == raw.count() > 25_000 and members == len(wrote)
    # a member holds chunk_rows at most, and no row is lost where a batch ends
    staging._archive_files(staging._dealt(raw), str(tmp_path / "small"), 7000).collect()
    from moderata.sources import archives

    rows = archives.read_nested_zip_csv(spark, archives.list_archives(spark, str(tmp_path / "small")))
    assert rows.groupBy("member").count().agg(F.max("count")).first()[0] == 7000
    assert rows.count() == raw.count() and set(S.ARCHIVE_COLUMNS) <= set(rows.columns)
