"""Mixing sources to target weights by hash thresholds.

Word counts are summed by source and hash bucket; the bucket in which the sum
passes a source's budget is the only one that is split further, level by
level, until it is one hash value. The mix is then a filter on the hash:
nothing is sorted, and a source that holds a third of all rows is summed in
every task before its sums move.

Defined cases: null text or text without words has size 0; null sources are
one source, ordered last; null ids hash like the text ``null``; rows with the
same id have the same hash and are taken or left together; an empty table
gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, with_lookup

LEVELS, BITS = 4, 12


def id_hash(doc_id: Column) -> Column:
    """48 bits of the md5 of the id's text, as a long."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")), 1, LEVELS * BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], total: float, cap: float) -> DataFrame:
    """source, source_size, target: ``total`` times all words, shared by weight, none above ``cap`` times its size.

    Resharing the excess until no source is above its cap ends where every
    open source gets the same amount per weight. With sources ordered by cap
    per weight that amount follows from running sums. One row per source.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before, whole = full.rowsBetween(Window.unboundedPreceding, -1), full.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = (
        by_source.withColumn("weight", weight)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("per_weight", F.col("most") / F.col("weight"))
        .withColumn("left", F.sum("source_size").over(whole) * F.lit(float(total)) - F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("each", F.when(F.col("left") / F.col("open") <= F.col("per_weight"), F.col("left") / F.col("open")))
    )
    level = F.first("each", ignorenulls=True).over(whole)
    return filled.select("source", "source_size", F.least("most", F.coalesce(level * F.col("weight"), F.col("most"))).alias("target"))


def thresholds(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: whole copies, the boundary hash value, and whether its rows are in."""
    state = goal.withColumn("full", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(2))).otherwise(0).cast("int"))
    state = cut(state.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size")).withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0.0)).withColumn("inside", F.lit(0.0)))
    by_bucket = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        edge = with_lookup(sizes, state.select("source", "prefix"), "source")
        sums = (
            edge.filter(F.shiftright("h", shift + BITS) == F.col("prefix"))
            .groupBy("source", F.shiftright("h", shift).alias("bucket"))
            .agg(F.sum("size").cast("double").alias("in_bucket"))
            .withColumn("upto", F.sum("in_bucket").over(by_bucket))
            .withColumnRenamed("source", "source2")
        )
        joined = state.join(sums, F.col("source").eqNullSafe(F.col("source2")) & (F.col("upto") + F.col("below") > F.col("rest")), "left")
        found = joined.groupBy("source", "source_size", "target", "full", "rest", "below").agg(F.min_by(F.struct("bucket", "upto", "in_bucket"), "bucket").alias("at"))
        none = F.lit(1 << (BITS * (level + 1))).cast("long")
        state = cut(
            found.select(
                "source", "source_size", "target", "full", "rest",
                F.coalesce("at.bucket", none).alias("prefix"),
                F.coalesce(F.col("below") + F.col("at.upto") - F.col("at.in_bucket"), F.col("below")).alias("below"),
                F.coalesce("at.in_bucket", F.lit(0.0)).alias("inside"),
            )
        )
    nearer = (F.col("inside") > 0) & (F.col("below") + F.col("inside") - F.col("rest") < F.col("rest") - F.col("below"))
    return cut(state.select("source", "source_size", "target", "full", F.col("prefix").alias("edge"), nearer.alias("edge_in")))


def _decided(rows: DataFrame, edges: DataFrame) -> DataFrame:
    second = (F.col("h") < F.col("edge")) | ((F.col("h") == F.col("edge")) & F.col("edge_in"))
    return with_lookup(rows, edges, "source").withColumn("copies", F.least(F.col("full") + second.cast("int"), F.lit(2)))


def _sized(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return cut(docs.select("doc_id", "source", size.alias("size"), id_hash(F.col("doc_id")).alias("h")))


def mixed_sizes(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every row."""
    sizes = _sized(docs)
    rows = _decided(sizes, thresholds(sizes, targets(sizes, weights, total, cap)))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: every row as often as it is taken (0 to 2 times), with the columns of ``docs``."""
    sizes = _sized(docs)
    edges = thresholds(sizes, targets(sizes, weights, total, cap)).select("source", "full", "edge", "edge_in")
    names = docs.columns
    packed = docs.select(F.col("source"), id_hash(F.col("doc_id")).alias("h"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    rows = _decided(packed, edges).select("row", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in names])


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, source_size * 2.0::DOUBLE AS most, source_size * 2.0::DOUBLE / weight AS per_weight FROM s
), f AS (
  SELECT *, (SELECT sum(source_size) FROM s)::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER w, 0) AS rest_all,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER w, 0) AS open_all
  FROM r WINDOW w AS (ORDER BY per_weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), lv AS (
  SELECT arg_min(rest_all / open_all, (per_weight, source IS NULL, source)) AS each FROM f WHERE rest_all / open_all <= per_weight
), t AS (
  SELECT source, source_size, least(most, coalesce((SELECT each FROM lv) * weight, most)) AS target FROM r
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(least(floor(target / source_size), 2) AS BIGINT) ELSE 0 END AS fully FROM t
), c AS (
  SELECT d.*, u.source_size, u.target, u.fully, u.target - u.fully * u.source_size AS rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto,
         CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS DOUBLE) AS inside
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source
), e AS (
  SELECT *, min(CASE WHEN upto > rest THEN h END) OVER (PARTITION BY source) AS edge FROM c
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, fully + CASE WHEN edge IS NULL OR h < edge OR (h = edge AND upto - rest < rest - (upto - inside)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
"""
