"""Top values from mergeable heavy-hitter summaries, recounted exactly.

``profile.top_values`` shuffles every distinct value of every column. Here a
frequent-items summary of fixed size per (group, column) names candidates, and
only they are counted by value:

* A summary of ``MAP_SIZE`` counters overstates no value's count by more than
  ``ERROR`` of the rows, and a value that it doesn't report has at most twice
  that. So if the n-th reported count, less the error, is above that
  bound, no value outside the candidates can be among the first n; ties at the
  n-th count are candidates too.
* A summary that reports fewer than ``SURE`` values whose counts sum to all
  rows has dropped none: its counts are exact.
* Otherwise the summary doesn't separate the column (ids, free text), and all
  its values are counted, as in ``profile``.

Summaries hold 64-bit hashes of the values, so long texts take no more room.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import join_on
from .profile import ranked_counts, values_long

#: Values that a summary may report; Spark gives it the next power of two above a third more counters.
REPORTED = 3_000
MAP_SIZE = 4_096
#: Share of the rows by which an estimate may be off, for any stream (Spark's frequent-items sketch).
ERROR = 3.5 / MAP_SIZE
#: A purge takes its cut from half of at least 1,024 counters, so this few reported values can't make up for it.
SURE = 512
#: Summaries whose candidates are broadcast: (group, column) pairs with the most rows. Each has at most 1/(2 ERROR) candidates of 8 bytes.
PAIRS = 4_096


def _hashed(long: DataFrame) -> DataFrame:
    return long.withColumn("_h", F.xxhash64(F.col("value"), F.col("value").isNull()))


def summaries(df: DataFrame, columns: Sequence[str], n: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """Per (group, column): ``rows``, whether the summary ``separated`` the first ``n``, and the ``candidates`` (hashes)."""
    found = _hashed(values_long(df, columns, group)).groupBy(*group, "column").agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(_h, {REPORTED}, {REPORTED})").alias("_top")
    )
    counts = F.transform("_top", lambda x: x["count"])
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    error, last = F.col("rows") * F.lit(ERROR), F.get(counts, F.lit(n - 1))
    whole = (F.size("_top") < SURE) & (total == F.col("rows"))
    least = F.coalesce(F.when(whole, last).otherwise(last - error), F.lit(0.0))
    separated = whole | F.coalesce(last - error > 2 * error, F.lit(False))
    out = found.select(*group, "column", "rows", separated.alias("separated"), "_top", least.alias("_least"))
    near = F.transform(F.filter("_top", lambda x: x["count"] >= F.col("_least")), lambda x: x["item"])
    return out.select(*group, "column", "rows", "separated", F.when(F.col("separated"), near).alias("candidates"))


def top_values(df: DataFrame, columns: Sequence[str], n: int = 10, group: Sequence[str] = ()) -> DataFrame:
    """The rows of ``profile.top_values``."""
    keys = [*group, "column"]
    known = summaries(df, columns, n, group).filter("separated").orderBy(F.desc("rows"), *keys).limit(PAIRS)
    pairs = known.select(*keys, F.lit(True).alias("_separated"))
    named = lambda h: F.xxhash64(*keys, h)
    wanted = known.select(*keys, F.explode("candidates").alias("_h")).select(named(F.col("_h")).alias("_c")).distinct()
    long = _hashed(values_long(df, columns, group)).withColumn("_c", named(F.col("_h"))).drop("_h")
    marked = join_on(long, F.broadcast(pairs), keys, "left").join(F.broadcast(wanted.withColumn("_wanted", F.lit(True))), "_c", "left")
    kept = F.col("_separated").isNull() | F.col("_wanted").isNotNull()
    counted = marked.select(*keys, "value", kept.alias("_kept"))
    counts = counted.groupBy(*keys, "_kept", F.when(F.col("_kept"), F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_rows"))
    return ranked_counts(counts, totals, n, group, kept="_kept")
