"""Helpers shared by the corpus operators.

``WORD`` is the word pattern of every operator here: runs of anything but the
six ASCII white-space characters, which is also what ``bytes.split()`` cuts by.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
WHITE = b" \t\n\x0b\x0c\r"
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"


#: Characters of a plan's text that the driver keeps for each of an operator's many jobs.
PLAN_TEXT = 20_000


#: Removes an action's shuffle files when it ends; a frame keeps the value it was made with.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back; its lineage ends there.

    Nor is the size kept that Spark guesses for it, a join's being the product
    of its sides': in rounds of joins that number's digits double with every
    round, until it fills the driver's memory. Without a guess nothing is broadcast
    unasked but what Spark has measured. The shuffle files behind ``df`` go at once.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if spark.conf.get("spark.sql.maxPlanStringLength").startswith("2147483632"):  # Spark's default
        spark.conf.set("spark.sql.maxPlanStringLength", str(PLAN_TEXT))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        written = df.select("*").checkpoint(eager=True)._jdf
    finally:
        spark.conf.set(_CLEANUP, before)
    rows = written.logicalPlan().rdd()
    out = DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, written.schema(), False), spark)
    out.written_at = rows.getCheckpointFile().get()
    return out


def remove(df: DataFrame) -> None:
    """Removes what ``cut`` wrote for ``df``; nothing derived from it may be read afterwards."""
    context = df.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(df.written_at)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def discard(*frames: DataFrame) -> None:
    """``remove`` for each of ``frames``. What executors hold in memory for earlier jobs, broadcasts above all, goes too: Spark drops it when the driver has collected its garbage."""
    for df in frames:
        remove(df)
    frames[0].sparkSession.sparkContext._jvm.System.gc()


def row_key(doc_id: Column, text: Column) -> Column:
    """20 bytes that tell rows apart by id and text; never null."""
    return F.unhex(F.sha1(F.concat_ws("/", F.coalesce(doc_id.cast("string"), F.lit("null")), F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit("text"), text)))))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column end to end, and its n+1 offsets; null is empty."""
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str, most: int = 4 << 20):
    """The batch cut into pieces of about ``most`` bytes of column ``name``; a longer row is a piece of its own."""
    column = batch.column(batch.schema.get_field_index(name))
    _, at = strings(column)
    start, n = 0, len(column)
    while start < n:
        stop = int(np.searchsorted(at, at[start] + most, "right")) - 1
        stop = min(n, max(start + 1, stop))
        yield batch.slice(start, stop - start)
        start = stop


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            have = _powers[k]
            with np.errstate(over="ignore"):
                _powers[k] = np.concatenate([have, have * (have[-1] * base)])
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans of ``data``, the same for the same bytes wherever they lie."""
    up, down = _power(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        raw = (total[stops] - total[starts]) * down[starts]
        return mix(raw + (stops - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE = np.zeros(256, bool)
_SPACE[list(WHITE)] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text number of each word; texts lie end to end in ``data``."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    first[edge] |= solid[edge]
    last[edge - 1] |= solid[edge - 1]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, stops, np.searchsorted(offsets, starts, "right") - 1


def with_lookup(rows: DataFrame, lookup: DataFrame, on: str, most_rows: int = 100_000, salts: int = 64) -> DataFrame:
    """Left join of ``rows`` with ``lookup``, which has one narrow row per key.

    ``lookup`` must be cut (written) already: its rows are counted, and up to
    ``most_rows`` of them are broadcast. Beyond that both sides are dealt by
    key and salt, so a key with a third of all rows is spread over ``salts``
    tasks. Keys compare null-safe.
    """
    if lookup.count() <= most_rows:
        right = F.broadcast(lookup.withColumnRenamed(on, "__key"))
        return rows.join(right, F.col(on).eqNullSafe(F.col("__key")), "left").drop("__key")
    left = rows.withColumn("__salt", F.pmod(F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]), F.lit(salts)))
    right = lookup.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))).withColumnsRenamed({on: "__key", "__salt": "__salt2"})
    return left.join(right, F.col(on).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__salt2")), "left").drop("__key", "__salt", "__salt2")


#: A key with more than this share of all rows is joined by broadcast, so fewer than HOT rows are ever broadcast.
HOT = 4096


def hot_join(rows: DataFrame, lookup: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (inner or left) with ``lookup`` (cut already; one row per key, ``n``: how many of ``rows`` have it) on ``key``.

    Keys with more than a ``HOT``-th of all counted rows, of which there are
    fewer than ``HOT``, are looked up by broadcast where the rows lie, and
    those rows are dealt by a hash of the whole row. The others are shuffled by
    key, so no task gets more than a ``HOT``-th of the rows by one key. ``n``
    isn't in the result; the row count decides nothing else. Null keys have no
    match.
    """
    total = lookup.agg(F.sum(n)).first()[0] or 0
    more = [c for c in lookup.columns if c not in (key, n)]
    heavy = F.col(n) * F.lit(HOT) > F.lit(total)
    side = lambda name: [F.col(c).alias(f"__{name}_{c}") for c in (key, *more)]
    hot = lookup.filter(heavy).select(*side("hot"))
    cold = lookup.filter(~heavy).select(*side("cold"), F.lit(0).alias("__cold_salt"))
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col(f"__hot_{key}"), "left")
    spread = [c for c, t in rows.dtypes if not t.startswith("map")]
    salt = F.when(F.col(f"__hot_{key}").isNotNull() | F.col(key).isNull(), F.pmod(F.xxhash64(*spread), F.lit(1 << 20)) + 1).otherwise(0)
    dealt = marked.withColumn("__salt", salt.cast("int"))
    found = dealt.join(cold, (F.col(key) == F.col(f"__cold_{key}")) & (F.col("__salt") == F.col("__cold_salt")), "left")
    if how == "inner":
        found = found.filter(F.col(f"__hot_{key}").isNotNull() | F.col(f"__cold_{key}").isNotNull())
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(f"__hot_{c}", f"__cold_{c}").alias(c) for c in more])


BITMAP_BITS = 1 << 25


def _bit(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BITMAP_BITS))


def bitmap(keys: DataFrame, key: str) -> DataFrame:
    """Which of 2^25 hash values ``key`` takes in ``keys``: at most 1024 rows of 4 KB, whatever the number of keys."""
    hits = keys.select(_bit(key).alias("bit"))
    return cut(hits.groupBy(F.bitmap_bucket_number("bit").alias("__block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits")))


def split_by_bitmap(rows: DataFrame, key: str, bits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` in two: those whose ``key`` may be in the bitmap (all that are, and a few others), and the rest.

    Wide rows that surely have no partner needn't move for a join. The bitmap
    is broadcast, 4 MB at most. With very many keys most rows are in the first
    part, which is slower but as right.
    """
    place = F.bitmap_bit_position(_bit(key)).cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8))) == 1, F.lit(False))
    marked = rows.withColumn("__at", F.bitmap_bucket_number(_bit(key))).join(F.broadcast(bits), F.col("__at") == F.col("__block"), "left").withColumn("__hit", hit)
    names = [F.col(f"`{c}`") for c in rows.columns]
    return marked.filter("__hit").select(*names), marked.filter("not __hit").select(*names)
