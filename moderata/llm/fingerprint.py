"""Improbable-feature digests of documents.

Every 64-byte window of a text has an entropy; how often each (quantised)
entropy occurs is counted over all windows of all texts, and windows are
ranked by that rarity. Of each run of 64 neighbouring windows the rarest
(leftmost of equals) gets a point; windows with enough points are the text's
features. Their hashes go into a chain of Bloom filters of 2048 bits, a new one
after 160 features. Two digests are compared filter by filter: common bits
beyond those expected by chance, over the most that are possible; each filter
of the shorter chain takes its best partner, and filters count by their bits.

``rarity`` can be passed on, so that digests of different runs compare.

Defined cases: null is the empty text, whose digest has no filter; texts under
64 bytes, or without any informative window, have one feature, the whole text;
equal digests are alike 1, an empty and another one 0; documents with one id
are ordered by text hash, null ids come last; a single document follows
itself; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_folder, mix, shuffle_width, slices, strings

WINDOW = 64
POINTS = 16
LEVELS, LEAST_LEVEL = 1000, 100
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Part of the possible overlap beyond chance that still counts as none.
MARGIN = 0.1
#: Bytes worked on at a time; a longer text is cut into pieces that overlap.
PIECE = 1 << 21
_X = np.arange(1, WINDOW + 1)
_SUMS = np.concatenate([[0], np.round(_X * np.log2(_X) * 65536)]).astype(np.int64)
_STEP = np.diff(_SUMS).astype(np.int32)


def entropy_levels(data: np.ndarray) -> np.ndarray:
    """Quantised entropy of the window that starts at each place (n - 63 of them).

    The sum of c log c over a window's byte counts c changes, from one window
    to the next, by how often the byte that comes and the byte that goes occur
    in it; both are found by comparing the text with itself, shifted by 1 to 63.
    """
    n = len(data)
    back, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for low in range(0, n, 1 << 15):
        high = min(n, low + (1 << 15))
        for d in range(1, WINDOW):
            a = max(low, d)
            if a < high:
                same = (data[a:high] == data[a - d : high - d]).view(np.uint8)
                back[a:high] += same
                ahead[a - d : high - d] += same
    change = _STEP[back]
    change[WINDOW:] -= _STEP[ahead[:-WINDOW]]
    total = np.cumsum(change, dtype=np.int64)[WINDOW - 1 :]
    return (LEVELS - total * LEVELS // (6 * 65536 * WINDOW)).astype(np.int16)


def _pieces(data: np.ndarray, offsets: np.ndarray, overlap: int):
    """(from, to, first text, last text) of runs of whole texts of about ``PIECE`` bytes, and overlapping parts of longer texts."""
    k, n = 0, len(offsets) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + PIECE, "right")) - 1)
        if offsets[stop] - offsets[k] <= PIECE:
            yield int(offsets[k]), int(offsets[stop]), k, stop
        else:
            at, end = int(offsets[k]), int(offsets[k + 1])
            while True:
                yield at, min(end, at + PIECE), k, k + 1
                if at + PIECE >= end:
                    break
                at += PIECE - overlap
        k = stop


def level_counts(column: pa.Array) -> np.ndarray:
    """How often each entropy level occurs among the windows of a column of texts."""
    data, offsets = strings(column)
    out = np.zeros(LEVELS + 1, np.int64)
    for a, b, k, stop in _pieces(data, offsets, WINDOW - 1):
        if b - a < WINDOW:
            continue
        levels = entropy_levels(data[a:b])
        whole = np.ones(len(levels), bool)
        for edge in offsets[k + 1 : stop] - a:  # windows over a text's end
            whole[max(0, edge - WINDOW + 1) : edge] = False
        out += np.bincount(levels[whole], minlength=LEVELS + 1)
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level, the rarest first; levels that carry too little are out (the largest number)."""
    order = np.lexsort((np.arange(LEVELS + 1), counts))
    rank = np.empty(LEVELS + 1, np.uint32)
    rank[order] = np.arange(LEVELS + 1)
    rank[:LEAST_LEVEL] = _OUT
    return rank


_OUT = 1023


def _feature_places(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the features of all texts, ascending, and the text of each."""
    places, texts = [], []
    for a, b, k, stop in _pieces(data, offsets, 4 * WINDOW):
        if b - a < WINDOW:
            continue
        part = data[a:b]
        value = rank[entropy_levels(part)]
        n = len(value)
        starts = np.maximum(offsets[k:stop], a) - a
        ends = np.minimum(offsets[k + 1 : stop + 1], b) - a
        owner = np.repeat(np.arange(stop - k), np.maximum(0, ends - starts))[:n]
        left = ends[owner] - np.arange(n)  # bytes from here to the text's end
        value[left < WINDOW] = _OUT
        best = value << np.uint32(22) | np.arange(n, dtype=np.uint32)
        for shift in (1, 2, 4, 8, 16, 32):
            if len(best) > shift:
                best[:-shift] = np.minimum(best[:-shift], best[shift:])
        runs = np.flatnonzero(left >= 2 * WINDOW - 1)
        runs = runs[best[runs] >> np.uint32(22) < _OUT]
        points = np.bincount(best[runs] & np.uint32((1 << 22) - 1), minlength=n)
        # texts with few runs need fewer points; with none, their rarest window has one
        n_runs = np.maximum(0, ends - starts - 2 * WINDOW + 2)
        for j in np.flatnonzero((n_runs == 0) & (ends - starts >= WINDOW)):
            low, high = int(starts[j]), int(ends[j]) - WINDOW + 1
            first = low + int(np.argmin(value[low:high]))
            if value[first] < _OUT:
                points[first] = 1
        found = np.flatnonzero(points >= np.clip(n_runs[owner], 1, POINTS))
        whole = offsets[k + 1] - offsets[k] <= b - a
        if not whole:  # a part of a long text: what its neighbours see better is theirs
            low = 2 * WINDOW if a > offsets[k] else 0
            high = n if b == offsets[k + 1] else b - a - 2 * WINDOW
            found = found[(found >= low) & (found < high)]
        places.append(found + a)
        texts.append(owner[found] + k)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *places]), np.concatenate([none, *texts])


class Digest:
    """A chain of Bloom filters (rows of bits) and the number of features in it."""

    __slots__ = ("filters", "n", "ones")

    def __init__(self, filters: np.ndarray, n: int):
        self.filters, self.n = filters, n
        self.ones = np.bitwise_count(filters).sum(axis=1, dtype=np.int64)

    def text(self) -> str:
        return f"{len(self.filters)}:{self.n}:{base64.b64encode(self.filters.tobytes()).decode()}"


def parse(text: str) -> Digest:
    filters, n, bits = text.split(":")
    return Digest(np.frombuffer(base64.b64decode(bits), np.uint8).reshape(int(filters), FILTER_BITS // 8), int(n))


def digests(column: pa.Array, rank: np.ndarray) -> list[Digest]:
    data, offsets = strings(column)
    n = len(offsets) - 1
    places, texts = _feature_places(data, offsets, rank)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    word = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    hashes = np.zeros(len(places), np.uint64)
    for k in range(0, WINDOW, 8):
        hashes = mix(hashes + word[np.minimum(places + k, len(data))])
    bare = np.setdiff1d(np.flatnonzero(np.diff(offsets) > 0), texts)
    if len(bare):
        own = [int.from_bytes(hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=8).digest(), "little") for k in bare]
        hashes, texts, places = np.concatenate([hashes, np.array(own, np.uint64)]), np.concatenate([texts, bare]), np.concatenate([places, offsets[bare]])
    # once per text and hash, in the order of their first places
    order = np.lexsort((places, hashes, texts))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (texts[order][1:] != texts[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    keep = order[fresh]
    keep = keep[np.lexsort((places[keep], texts[keep]))]
    hashes, texts = hashes[keep], texts[keep]
    counts = np.bincount(texts, minlength=n)
    number = np.arange(len(texts)) - np.repeat(np.cumsum(counts) - counts, counts)
    chains = -(-counts // FILTER_FEATURES)
    first = np.concatenate([[0], np.cumsum(chains)])
    bits = np.zeros((int(first[-1]), FILTER_BITS), bool)
    rows = first[texts] + number // FILTER_FEATURES
    for k in range(HASHES):
        bits[rows, (hashes >> np.uint64(11 * k)) & np.uint64(FILTER_BITS - 1)] = True
    packed = np.packbits(bits, axis=1)
    return [Digest(packed[first[k] : first[k + 1]], int(counts[k])) for k in range(n)]


def likeness(a: Digest, b: Digest) -> float:
    """0 to 1: overlap of the filters' bits beyond chance."""
    if a.filters.shape == b.filters.shape and (a.filters == b.filters).all():
        return 1.0
    if not len(a.filters) or not len(b.filters):
        return 0.0
    if (len(b.filters), b.n) < (len(a.filters), a.n):
        a, b = b, a
    total = 0.0
    for bits, ones in zip(a.filters, a.ones):
        common = np.bitwise_count(b.filters & bits).sum(axis=1, dtype=np.int64)
        most = np.minimum(ones, b.ones)
        chance = ones * b.ones / FILTER_BITS
        none = chance + MARGIN * (most - chance)
        total += ones * float(np.clip((common - none) / np.maximum(most - none, 1e-9), 0, 1).max())
    return total / float(a.ones.sum())


def rarity(docs: DataFrame) -> list[int]:
    """Counts of the entropy levels over all windows of all texts: 1001 numbers."""

    def run(batches):
        counts = np.zeros(LEVELS + 1, np.int64)
        for batch in batches:
            for piece in slices(batch, "text"):
                counts += level_counts(piece.column(0))
        yield pa.RecordBatch.from_pydict({"level": np.flatnonzero(counts), "n": counts[counts > 0]})

    rows = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(run, "level long, n long")
    out = [0] * (LEVELS + 1)
    for row in rows.groupBy("level").agg(F.sum("n").alias("n")).collect():
        out[row.level] = row.n
    return out


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ids: list, texts: list[str], own: list[Digest], rank: np.ndarray) -> dict[str, list]:
    """The result columns of all but the last of some documents that follow each other."""
    other = [edited(a, b) for a, b in zip(texts, texts[1:])]
    changed = digests(pa.array(other, pa.large_string()), rank)
    return {
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in other],
        "fingerprint": [d.text() for d in own[:-1]], "edited_fingerprint": [d.text() for d in changed],
        "near_edited": [likeness(a, b) for a, b in zip(own, changed)], "near_next": [likeness(a, b) for a, b in zip(own, own[1:])],
    }


def fingerprints(docs: DataFrame, counts: list[int] | None = None) -> DataFrame:
    """The digest of every text and of its edited text, and how alike it is to that and to the next document's, by descending doc_id."""
    spark = docs.sparkSession
    rank = ranks(np.array(counts or rarity(docs), np.int64))
    names = [c.split()[0] for c in _OUT_SCHEMA.split(", ")]
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "near_edited": pa.float64(), "near_next": pa.float64(), "part": pa.int32(), "end": pa.string(), "text": pa.string()}
    schema = pa.schema([(c, kinds.get(c, pa.string())) for c in [*names, "part", "end", "text"]])

    def run(batches):
        part = TaskContext.get().partitionId()
        ids: list = []
        texts: list[str] = []
        own: list[Digest] = []
        loose = lambda end, k: {"doc_id": ids[k], "part": part, "end": end, "text": texts[k]}
        seen = False
        for batch in batches:
            for piece in slices(batch, "text", PIECE):
                ids += piece.column(0).to_pylist()
                texts += piece.column(1).to_pylist()
                own += digests(piece.column(1), rank)
                if not seen:
                    yield pa.RecordBatch.from_pylist([loose("first", 0)], schema)
                    seen = True
                if len(ids) > 1:
                    done = _compared(ids, texts, own, rank)
                    n = len(ids) - 1
                    yield pa.RecordBatch.from_pydict(done | {c: [None] * n for c in ("part", "end", "text")}, schema)
                    ids, texts, own = ids[-1:], texts[-1:], own[-1:]
        if ids:
            yield pa.RecordBatch.from_pylist([loose("last", 0)], schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = F.col("doc_id").desc_nulls_last()
    placed = rows.repartitionByRange(shuffle_width(spark), order).sortWithinPartitions(order, F.xxhash64("text"))
    folder = fresh_folder(spark, "fingerprints")
    placed.mapInArrow(run, f"{_OUT_SCHEMA}, part int, end string, text string").write.option("compression", "zstd").parquet(folder)
    written = spark.read.parquet(folder)

    # the last document of each part is followed by the first of the next part that has any, the very last by the very first
    parts = sorted(r.part for r in written.filter("end = 'first'").select("part").collect())  # one number per part
    after = dict(zip(parts, [*parts[1:], *parts[:1]]))
    following = F.create_map(*[F.lit(x) for pair in after.items() for x in pair]) if after else F.create_map(F.lit(0), F.lit(0))
    last = written.filter("end = 'last'").select("doc_id", "text", following[F.col("part")].alias("after"))
    first = written.filter("end = 'first'").select(F.col("part").alias("after"), F.col("text").alias("following"))

    def finish(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                pair = pa.array([batch.column(1)[k].as_py(), batch.column(2)[k].as_py()], pa.string())
                done = _compared([batch.column(0)[k].as_py(), None], pair.to_pylist(), digests(pair, rank), rank)
                yield pa.RecordBatch.from_pydict(done, pa.schema([(c, kinds.get(c, pa.string())) for c in names]))

    ends = last.join(first, "after").select("doc_id", "text", "following").mapInArrow(finish, _OUT_SCHEMA)
    return written.filter("end is null").select(*names).union(ends)
