"""Near-duplicate documents by MinHash with tensored banding.

Two collections of ``GROUPS`` keys are computed, each key from ``ROWS``
minhashes. The tables are all pairs of a key of the one and a key of the other
(GROUPS^2 tables of 2*ROWS minhashes), so the minhashes needed grow with the
square root of the number of tables. At similarity 0.85 a pair shares no table
with probability 2 * (1 - 0.85^ROWS)^GROUPS, below 1e-6. Keys that no other
text has are dropped before pairs are formed.

Documents that meet in a table are gathered in candidate groups (connected by
each bucket's smallest member, so no pairs are emitted), and the links are
confirmed on the full shingle sets within each group. Large groups are cut into
blocks by their total number of shingles; every pair of blocks is compared in
a task of its own. A task puts its documents in order of size, counts common
shingles with all earlier ones through an inverted index, and keeps only links
that join two parts not yet joined, so its output is at most one row per
document. Equal sets are one node throughout.

Defined cases: null or wordless text has an empty set and no links; fewer than
five words are one shingle; repeated rows are linked as equal sets; null ids
come after all others (a group of null ids only keeps its null ids).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, cut, mix, row_key, slices, span_hashes, strings, word_spans
from .graph import components

SHINGLE = 5
GROUPS, ROWS = 20, 4
#: Shingles in a block of a candidate group.
BLOCK = 1 << 19
_LOWER = np.frombuffer(LOWER, np.uint8)
_random = np.random.default_rng(20240229)
_TIMES = (_random.integers(1, 1 << 32, 2 * GROUPS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_PLUS = _random.integers(0, 1 << 32, 2 * GROUPS * ROWS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's shingles."""
    data, offsets = strings(column)
    data = _LOWER[data]
    starts, stops, owner = word_spans(data, offsets)
    words = span_hashes(data, starts, stops)
    first = np.searchsorted(owner, np.arange(len(offsets)))
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        rolled = np.zeros(n, np.uint64)
        for k in range(size):
            rolled = mix(rolled + words[k : k + n] + np.uint64(k + 1))
    out = []
    for k in range(len(offsets) - 1):
        low, high = int(first[k]), int(first[k + 1])
        if high - low >= size:
            out.append(np.unique(rolled[low : high - size + 1]))
        elif high > low:
            whole = hashlib.blake2b(b" ".join(data[starts[j] : stops[j]].tobytes() for j in range(low, high)), digest_size=8)
            out.append(np.array([int.from_bytes(whole.digest(), "little")], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def table_keys(shingles: np.ndarray) -> np.ndarray:
    """The keys of both collections, 2 * GROUPS of them."""
    small = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_TIMES), 0xFFFFFFFF, np.uint32)
    for from_ in range(0, len(small), 256):
        part = small[from_ : from_ + 256, None] * _TIMES + _PLUS
        least = np.minimum(least, part.min(axis=0))
    rows = least.reshape(2 * GROUPS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.arange(1, 2 * GROUPS + 1, dtype=np.uint64)
        for k in range(ROWS):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def _signed(batches):
    """Rows (doc_id, row key, text) to rows (doc_id, row key, set size, set digest, node, keys)."""
    for batch in batches:
        for piece in slices(batch, "text", 2 << 20):
            sets = shingle_sets(piece.column(2))
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            nodes = [int.from_bytes(d[:8], "little", signed=True) if d else None for d in digests]
            keys = pa.array([table_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64()))
            columns = [piece.column(0), piece.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(nodes, pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "rk", "n_shingles", "digest", "node", "keys"])


class _Parts:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def confirmed_links(sets: list[np.ndarray], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * common >= percent * union; sides: only pairs of different sides, if given.

    Sets are taken in order of size. Each is compared with all earlier ones
    that may be large enough, by counting how often its shingles occur in them.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes = np.array([len(sets[k]) for k in order], np.int64)
    flat = np.concatenate([sets[k] for k in order]) if order else np.zeros(0, np.uint64)
    _, codes, often = np.unique(flat, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(order), dtype=np.int64), sizes)
    by_code = np.argsort(codes, kind="stable")  # the sets of each shingle, ascending
    holders, first = owner[by_code], np.concatenate([[0], np.cumsum(often)])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    rank = np.empty(len(codes), np.int64)
    rank[by_code] = np.arange(len(codes))
    side = np.array([sides[k] for k in order]) if sides else None
    parts, links = _Parts(len(order)), []
    for k in range(len(order)):
        mine = slice(begin[k], begin[k + 1])
        low = first[codes[mine]]
        counts = rank[mine] - low  # earlier sets that hold each shingle
        total = int(counts.sum())
        if not total:
            continue
        ends = np.cumsum(counts)
        at = np.repeat(low - ends + counts, counts) + np.arange(total)
        least = int(np.searchsorted(sizes, -(-percent * sizes[k] // 100)))
        common = np.bincount(holders[at] - 0, minlength=k)[:k]
        near = np.flatnonzero((100 + percent) * common[least:] >= percent * (sizes[least:k] + sizes[k])) + least
        if side is not None:
            near = near[side[near] != side[k]]
        for other in near.tolist():
            if parts.join(k, other):
                links.append((order[k], order[other]))
    return links


def _verified(percent: int):
    """A candidate block, or a pair of blocks, of texts: to its confirmed links (node, other)."""

    def run(frame: pa.Table) -> pa.Table:
        once = {d: k for k, d in enumerate(frame.column("digest").to_pylist())}  # repeated rows come twice
        frame = frame.take(pa.array(list(once.values()))).combine_chunks()
        sets = shingle_sets(frame.column("text").chunk(0))
        blocks, digests = frame.column("block").to_pylist(), frame.column("digest").to_pylist()
        sides = blocks if len(set(blocks)) > 1 else None
        links = confirmed_links(sets, percent, sides)
        return pa.table({"digest": pa.array([digests[a] for a, _ in links], pa.binary()), "other": pa.array([digests[b] for _, b in links], pa.binary())})

    return run


def _signatures(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row key, text) of every row, and each row's set and keys."""
    kind = dict(docs.dtypes)["doc_id"]
    text = F.col("text").cast("string")
    rows = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("rk"), F.coalesce(text, F.lit("")).alias("text"))
    return rows.select("rk", "text"), cut(rows.mapInArrow(_signed, f"doc_id {kind}, rk binary, n_shingles long, digest binary, node long, keys array<long>"))


def candidate_groups(texts: DataFrame) -> DataFrame:
    """node, root of all nodes that meet another in a table."""
    singles = texts.select("node", F.posexplode("keys").alias("place", "key"))
    common = singles.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    shared = singles.join(common, "key", "left_semi")
    first, second = (F.transform(F.filter("live", side), lambda x: x.key) for side in (lambda x: x.place < GROUPS, lambda x: x.place >= GROUPS))
    live = cut(shared.groupBy("node").agg(F.collect_list(F.struct("place", "key")).alias("live")).select("node", first.alias("a"), second.alias("b")))
    pairs = live.select("node", "b", F.explode("a").alias("x")).select("node", F.explode(F.transform("b", lambda y: F.xxhash64(F.col("x"), y))).alias("pair"))
    buckets = pairs.groupBy("pair").agg(F.min("node").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    return components(pairs.join(buckets, "pair").filter("node != hub").select("node", "hub").distinct(), "node", "hub")


def _links(rows: DataFrame, signed: DataFrame, percent: int) -> DataFrame:
    """Confirmed links between set digests, a spanning forest of each block pair."""
    texts = cut(signed.filter("digest is not null").groupBy("digest", "node", "n_shingles").agg(F.first("keys").alias("keys"), F.min("rk").alias("rk")))
    members = cut(texts.join(candidate_groups(texts), "node").select("digest", "rk", "n_shingles", "root"))
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n_shingles") / F.lit(BLOCK)).cast("int").alias("n_blocks"))
    placed = members.join(blocks, "root").withColumn("block", F.pmod(F.xxhash64("digest"), F.col("n_blocks")).cast("int"))
    texted = placed.join(rows, "rk").select("digest", "text", "root", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("with"))
    dealt = texted.select("digest", "text", "root", "block", F.least("block", "with").alias("p"), F.greatest("block", "with").alias("q"))
    return cut(dealt.groupBy("root", "p", "q").applyInArrow(_verified(percent), "digest binary, other binary"))


def _parted(signed: DataFrame, links: DataFrame) -> DataFrame:
    """``signed`` with ``part``, the same for all rows of a component; null without words."""
    joined = components(links.select(F.xxhash64("digest").alias("a"), F.xxhash64("other").alias("b")), "a", "b")
    named = signed.withColumn("number", F.xxhash64("digest"))
    return named.join(joined, named.number == joined.node, "left").withColumn("part", F.coalesce(F.col("root").cast("string"), F.hex("digest")))


def grouped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows, signed = _signatures(docs)
    parted = _parted(signed, _links(rows, signed, percent))
    least = cut(parted.filter("part is not null").groupBy("part").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).filter("n > 1"))
    out = parted.join(least, "part", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicated(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each component (smallest doc_id, nulls last, then row key); rows without words all stay."""
    rows, signed = _signatures(docs)
    parted = _parted(signed, _links(rows, signed, percent))
    first = parted.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")).alias("first")).filter("part is not null").select(F.col("first.rk").alias("__rk"))
    empty = parted.filter("part is null").select(F.col("rk").alias("__rk")).distinct()
    text = F.col("text").cast("string")
    keyed = docs.withColumn("__rk", row_key(F.col("doc_id"), text))
    kept = keyed.join(cut(first.withColumn("__words", F.lit(True)).union(empty.withColumn("__words", F.lit(False)))), "__rk")
    # rows repeated with id and text are one document
    some = kept.filter("__words").dropDuplicates(["__rk"])
    return some.union(kept.filter("not __words")).select(*[F.col(f"`{c}`") for c in docs.columns])
