"""Connected components of an edge table, by propagation of the smallest label with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import cut, discard, remove, shuffle_width


#: A node with more than this share of all edges is a hub; there are fewer than HUB of them.
HUB = 4096


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, root (the component's smallest node) of every node of ``edges`` (two long columns, no nulls).

    The edges are first contracted where they lie, by one end and by the other
    (``_contracted``), which leaves few and short paths.
    Every node starts with its smallest neighbour's label. In a round, nodes
    whose label has changed tell their neighbours, and every node jumps to its
    label's label. The labels of hubs, fewer than ``HUB`` of them, are broadcast to
    their edges where these lie, so a hub with a third of all edges isn't one
    task's; a partial minimum per task follows. Each round is one job,
    whose labels are written to the shared folder in place of the last ones; rounds end when no label
    has changed. Self-edges keep their node in the result; repeated edges do
    no harm.
    """
    one = _contracted(edges.select(F.col(a).cast("long").alias("node"), F.col(b).cast("long").alias("other")))
    seen = Observation()
    both = cut(one.union(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct().observe(seen, F.count(F.lit(1)).alias("edges")))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root"), F.count("*").alias("n"))
    wide = F.lit(seen.get["edges"]) < F.col("n") * F.lit(HUB)
    labels = cut(_jump(least.withColumn("next", F.col("root")), least).drop("old").withColumn("fresh", F.lit(True)))
    hubs = [r.node for r in least.filter(wide).select("node").collect()]  # fewer than HUB
    of_hubs, of_others = both.filter(F.col("other").isin(hubs)), both.filter(~F.col("other").isin(hubs))
    while True:
        fresh = labels.filter("fresh").select(F.col("node").alias("other"), F.col("root").alias("said"))
        told = _merge(of_others, fresh, "other")
        if hubs:
            told = told.union(of_hubs.join(F.broadcast(fresh.filter(F.col("other").isin(hubs))), "other"))
        heard = told.groupBy("node").agg(F.min("said").alias("said")).withColumnRenamed("node", "heard_by")
        lower = labels.join(heard.hint("merge"), F.col("node") == F.col("heard_by"), "left").select("node", "root", F.least("root", "said").alias("next"))
        jumped = _jump(lower, labels).withColumn("fresh", F.col("root") < F.col("old"))
        seen = Observation()
        last, labels = labels, cut(jumped.drop("old").observe(seen, F.count_if(F.col("fresh")).alias("moved")))
        remove(last)
        if not seen.get["moved"]:
            discard(both)
            return labels.drop("fresh")


#: Edges contracted together in a task.
_HELD = 1 << 20


def _contracted(edges: DataFrame) -> DataFrame:
    """Edges with the same components: within each task, of each part the smallest node with each of the others.

    Done as the edges lie, then dealt by one end, then by the other; a task holds ``_HELD`` edges at a time.
    """
    local = lambda e: e.mapInArrow(_stars, "node long, other long")
    width = shuffle_width(edges.sparkSession)
    return local(local(local(edges).repartition(width, "node")).repartition(width, "other"))


def _stars(batches):
    schema = pa.schema([("node", pa.int64()), ("other", pa.int64())])
    held, n = [], 0

    def stars():
        ends, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = at.reshape(2, -1)
        root = np.arange(len(ends))
        while True:
            x, y = root[a], root[b]
            if (x == y).all():
                break
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while (root[root] != root).any():
                root = root[root]
        # self-edges keep their node
        alone = np.zeros(len(ends), bool)
        alone[a[a == b]] = True
        linked = np.flatnonzero((root != np.arange(len(ends))) | alone)
        return pa.RecordBatch.from_arrays([pa.array(ends[linked]), pa.array(ends[root[linked]])], schema=schema)

    for batch in batches:
        if batch.num_rows:
            held.append(np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(2)]))
            n += batch.num_rows
        if n >= _HELD:
            yield stars()
            held, n = [], 0
    if held:
        yield stars()


def _merge(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """A join by shuffle whatever the sizes: labels grow with the data, and the driver's memory should not hold them."""
    return left.join(right.hint("merge"), on)


def _jump(lower: DataFrame, labels: DataFrame) -> DataFrame:
    """node, root (the label of ``next``, if smaller), old (its root so far)."""
    above = labels.select(F.col("node").alias("next"), F.col("root").alias("further"))
    return _merge(lower, above, "next").select("node", F.least("next", "further").alias("root"), F.col("root").alias("old"))
