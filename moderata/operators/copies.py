"""Rows and copies per key by a two-level filter.

``profile.multiplicity`` shuffles every distinct key. Where nearly all keys
occur once (uuids, whole rows), this form moves four bytes a row first, and
whole keys only where they may repeat:

1. Each task hashes its keys to slots of a sparse filter of 2^43 and packs them
   by segment: which slots it saw, and which it saw again. A key with a third
   of all rows is one entry a task.
2. The packed entries are dealt by segment and merged: a slot seen by two
   tasks, or again by one, is seen again.
3. Slots seen again fill a bitmap of fixed size, which is broadcast. Rows
   outside it surely hold keys of one row and are counted where they lie; the
   others are counted by whole key.

The result is exact: two keys in one slot or bit only move more rows. With
very many repeated keys the bitmap fills and all rows move, as in
``profile``. The input is read twice, so the plain form stays better for
narrow keys and for keys that mostly repeat.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

SEGMENT_BITS = 12
OFFSET_BITS = 31
SLOT_BITS = SEGMENT_BITS + OFFSET_BITS
#: Slots that a task holds before it packs them (8 bytes each).
HELD = 1 << 21
#: Bits of the broadcast bitmap: 16 MB at most, whatever the number of keys.
BITMAP_BITS = 1 << 27

PACKED = "segment int, packed binary"


def _slot(df: DataFrame, keys: Sequence[str]) -> Column:
    # 0.0 and -0.0 are one key, so they need one hash
    same = [F.col(f"`{k}`") + F.lit(0.0) if df.schema[k].dataType.typeName() in ("double", "float") else F.col(f"`{k}`") for k in keys]
    return F.shiftrightunsigned(F.xxhash64(*same), 64 - SLOT_BITS)


def pack(slots: np.ndarray) -> pa.RecordBatch:
    """Per segment the distinct slots in order, as 32-bit words: offset, then one bit that says "seen again"."""
    seen, times = np.unique(slots, return_counts=True)
    words = (((seen & ((1 << OFFSET_BITS) - 1)) << 1) | (times > 1)).astype("<u4")
    segment = (seen >> OFFSET_BITS).astype(np.int32)
    first = np.flatnonzero(np.diff(segment, prepend=-1))
    ends = (np.append(first, len(seen)) * 4).astype(np.int32)
    packed = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(words.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(segment[first]), packed], names=["segment", "packed"])


def seen_again(words: np.ndarray) -> np.ndarray:
    """Offsets that two packed lists of a segment hold, or that one holds as seen again."""
    words = np.sort(words)
    offsets = words >> 1
    twice = np.zeros(len(words), bool)
    twice[1:] = offsets[1:] == offsets[:-1]
    return np.unique(offsets[twice | (words & 1 == 1)]).astype(np.int64)


def _pack_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        held.append(batch.column(0).to_numpy(zero_copy_only=False))
        n += len(held[-1])
        if n >= HELD:
            yield pack(np.concatenate(held))
            held, n = [], 0
    if n:
        yield pack(np.concatenate(held))


def _merge_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of segment; one segment is held at a time."""

    def merged(segment: int, lists: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array((segment << OFFSET_BITS) + seen_again(np.concatenate(lists)))], names=["slot"])

    current, held = -1, []
    for batch in batches:
        for segment, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            if segment != current:
                if held:
                    yield merged(current, held)
                current, held = segment, []
            held.append(np.frombuffer(packed.as_buffer(), "<u4"))
    if held:
        yield merged(current, held)


def repeated_slots(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Slots (one column, ``slot``) that more than one row of ``df`` has by its ``keys``."""
    ship_package(df.sparkSession)
    packed = df.select(_slot(df, keys).alias("slot")).mapInArrow(_pack_task, PACKED)
    return packed.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merge_task, "slot long")


def may_repeat(df: DataFrame, keys: Sequence[str], label: str = "_maybe") -> DataFrame:
    """``df`` with a boolean ``label``: false where no other row has the same ``keys``, nulls equal."""
    bit = lambda c: F.pmod(c, F.lit(BITMAP_BITS))
    again = repeated_slots(df, keys).select(bit(F.col("slot")).alias("bit"))
    bits = again.groupBy(F.bitmap_bucket_number("bit").alias("_block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    own = bit(_slot(df, keys))
    rows = df.select("*", F.bitmap_bucket_number(own).alias("_at"), F.bitmap_bit_position(own).cast("int").alias("_place"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(F.col("_place"), F.lit(8))) == 1, F.lit(False))
    joined = rows.join(F.broadcast(bits), F.col("_at") == F.col("_block"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], hit.alias(label))


def _per_key(df: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """Rows per key that may repeat; all other rows of a group in one row."""
    known = [F.when(F.col("_maybe"), F.col(f"`{k}`")).alias(f"_k{i}") for i, k in enumerate(keys)]
    return may_repeat(df.select(*group, *[k for k in keys if k not in group]), [*group, *keys]).groupBy(*group, "_maybe", *known).agg(F.count(F.lit(1)).alias("_m"))


def multiplicity(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The rows of ``profile.multiplicity``."""
    zero, maybe, m = F.lit(0).cast("long"), F.col("_maybe"), F.col("_m")
    return _per_key(df, keys, group).groupBy(*group).agg(
        F.coalesce(F.sum(m), zero).alias("total_rows"),
        F.coalesce(F.sum(F.when(maybe, 1).otherwise(m)), zero).alias("distinct_keys"),
        F.count_if(maybe & (m > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(maybe, m - 1).otherwise(0)), zero).alias("excess_rows"),
    )


def multiplicity_histogram(df: DataFrame, keys: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """The rows of ``profile.multiplicity_histogram``."""
    maybe, m = F.col("_maybe"), F.col("_m")
    copies = F.when(maybe, m).otherwise(F.lit(1).cast("long"))
    return _per_key(df, keys, group).groupBy(*group, copies.alias("copies")).agg(F.sum(F.when(maybe, 1).otherwise(m)).alias("keys"))
