"""The two-level filter against plain counts, and what it leaves to shuffle."""

import collections

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moderata.operators import copies, profile

SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "g string, k string, x double"
rows_st = st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.sampled_from(["", "u", "v", None]), st.sampled_from([0.0, -0.0, 1.5, None])), max_size=40)


def tuples(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_packed_words_keep_slots_and_flags():
    slots = np.array([5, 5, 7, (3 << copies.OFFSET_BITS) + 9, (3 << copies.OFFSET_BITS) + 2, 0], np.int64)
    batch = copies.pack(slots)
    lists = {s: np.frombuffer(p.as_buffer(), "<u4").tolist() for s, p in zip(batch.column(0).to_pylist(), batch.column(1))}
    assert lists == {0: [0, 5 << 1 | 1, 7 << 1], 3: [2 << 1, 9 << 1]}


def test_merge_finds_slots_of_two_lists_or_seen_again_in_one():
    words = np.array([1 << 1, 2 << 1 | 1, 3 << 1, 3 << 1, 4 << 1, 4 << 1 | 1, 9 << 1], np.uint32)
    assert copies.seen_again(words).tolist() == [2, 3, 4]
    assert copies.seen_again(np.zeros(0, np.uint32)).tolist() == []


@SETTINGS
@given(rows=rows_st)
def test_same_rows_as_the_plain_count(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for keys, group in ((["k", "x"], ["g"]), (["g", "k"], [])):
        assert tuples(copies.multiplicity(df, keys, group)) == tuples(profile.multiplicity(df, keys, group))
        assert tuples(copies.multiplicity_histogram(df, keys, group)) == tuples(profile.multiplicity_histogram(df, keys, group))


def test_only_keys_that_repeat_are_left(spark):
    """50,000 single keys, 100 pairs over different tasks, one key with a third of all rows."""
    single = spark.range(50_000).select(F.concat(F.lit("s"), "id").alias("k"))
    pairs = spark.range(200).select(F.concat(F.lit("p"), F.col("id") % 100).alias("k"))
    hot = spark.range(25_000).select(F.lit("hot").alias("k"))
    df = single.union(pairs).union(hot).repartition(16)
    left = collections.Counter(r["k"] for r in copies.may_repeat(df, ["k"]).filter("_maybe").collect())
    assert left.pop("hot") == 25_000
    assert all(left.pop(f"p{i}") == 2 for i in range(100))
    assert sum(left.values()) <= 3  # single keys that share a bit with a repeated one
    packed = df.select(copies._slot(df, ["k"]).alias("slot")).mapInArrow(copies._pack_task, copies.PACKED)
    words = packed.agg(F.sum(F.length("packed")) / 4).first()[0]
    assert words <= 50_000 + 200 + 16  # the hot key is one entry a task
    m = copies.multiplicity(df, ["k"]).first()
    assert tuple(m) == (75_200, 50_101, 101, 75_200 - 50_101)


def test_many_flushes_of_one_task(spark, monkeypatch):
    slots = [np.arange(10, dtype=np.int64), np.arange(5, 15, dtype=np.int64)]
    import pyarrow as pa

    monkeypatch.setattr(copies, "HELD", 8)
    batches = list(copies._pack_task(pa.RecordBatch.from_arrays([pa.array(s)], names=["slot"]) for s in slots))
    assert len(batches) == 2
    merged = list(copies._merge_task(iter(batches)))
    assert [b.column(0).to_pylist() for b in merged] == [[5, 6, 7, 8, 9]]


@pytest.mark.parametrize("group", [[], ["g"]])
def test_empty_input(spark, group):
    df = spark.createDataFrame([], SCHEMA)
    assert tuples(copies.multiplicity(df, ["k"], group)) == tuples(profile.multiplicity(df, ["k"], group))
