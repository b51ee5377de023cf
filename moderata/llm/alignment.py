"""Cross-tokenizer alignment of token ids by inverted pair bitmaps.

Every text, with a blank before it, is encoded by a byte-level BPE (A) and by a
sentence-piece BPE with byte fallback (B). Where an A and a B token end at one byte, the two are
linked, and such places cut both sequences into groups.

Documents are numbered inside blocks: a block is a run of one task's documents
of about ``BLOCK_BYTES``. Each block is inverted into postings, one row per id
pair: compressed document bitmaps over the block's numbers, in multiplicity planes
(plane k holds the documents that have the pair a number of times whose bit k is one). A plane
is a sorted list of 16-bit numbers or a bitmap, whichever is smaller. The planes OR-merged and popcounted
give the pair's documents in the block, planes popcounted and weighed by 2^k its links; both
are summed over the blocks, so no pair's postings ever lie in one task.

The postings then return the scores: each row gets its pair's corpus-wide count,
and whether no other pair of its B id has a higher one, and is sent to its block,
where the planes add them to the block's documents. Pairs with more than a
``HOT``-th of all rows are looked up by broadcast, the others by shuffle.

Defined cases: texts that are null or empty, or whose joined A or B token bytes
differ from blank + text, have no tokens: zeros, and '' for the groups. Special
tokens' strings inside texts are plain text. Repeated rows count each. Null doc_ids
are kept. A text longer than a block is a block of its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import fresh_folder, hot_join, shuffle_width, slices, strings

#: Bytes of text inverted together, and documents at most (their numbers take 16 bits).
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 1 << 16
#: Bytes of text encoded at a time.
_SLICE = 1 << 20


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class _Pair:
    """Both tokenizers, the byte length of each id, and the bytes of B's ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = bpe.Bpe(path_a)
        self.a.special = {}  # their strings are plain text here
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        pieces = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            pieces.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode())
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(pieces), np.uint8)
        sizes = (self.a.size, len(pieces))
        # decimal ids with the sign that follows: of the same side, the other side, the next group, or none
        self.text = [[f"{k}{sign}" for k in range(max(sizes))] for sign in (",", "|", ";", "")]

    def encode_b(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = self.b.encode(texts, num_threads=1)
        at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
        return np.fromiter((i for x in ids for i in x), np.int64, int(at[-1])), at

    def raw_b(self, ids: np.ndarray) -> np.ndarray:
        counts = self.lengths[ids]
        total = np.concatenate([[0], np.cumsum(counts)])
        return self.bytes[np.repeat(self.starts[ids] - total[:-1], counts) + np.arange(total[-1])]


@lru_cache(maxsize=1)
def load(path_a: str, path_b: str) -> _Pair:
    """Both tokenizers, once a worker."""
    return _Pair(path_a, path_b)


def _kept(ids: np.ndarray, at: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the good texts, and their offsets."""
    counts = np.diff(at)
    return ids[np.repeat(good, counts)], np.concatenate([[0], np.cumsum(np.where(good, counts, 0))])


def aligned(pair: _Pair, column: pa.Array):
    """For the texts: (n_a, n_b, n_groups, groups' digest) each, and the links (text, A id, B id)."""
    n = len(column)
    spaced = pc.binary_join_element_wise(pa.array([" "] * n), pc.fill_null(column, ""), "")
    some = np.array(pc.greater(pc.fill_null(pc.binary_length(column), 0), 0))
    data, offsets = strings(spaced)
    ids_a, at_a = pair.a.encode(spaced)
    ids_a = ids_a.astype(np.int64)
    ids_b, at_b = pair.encode_b(pc.fill_null(column, "").to_pylist())
    size = np.diff(offsets)
    good = some.copy()
    ends_a, ends_b = (np.concatenate([[0], np.cumsum(x)]) for x in (pair.a.lengths[ids_a], pair.lengths[ids_b]))
    good &= (np.diff(ends_a[at_a]) == size) & (np.diff(ends_b[at_b]) == size)
    owner = np.repeat(np.arange(n), size)
    for ids, at, raw in ((ids_a, at_a, lambda x: np.frombuffer(pair.a.raw(x), np.uint8)), (ids_b, at_b, pair.raw_b)):
        held, _ = _kept(ids, at, good)
        inside = good[owner]
        wrong = np.flatnonzero(raw(held) != data[inside])
        if len(wrong):
            good[np.unique(owner[inside][wrong])] = False
    ids_a, at_a = _kept(ids_a, at_a, good)
    ids_b, at_b = _kept(ids_b, at_b, good)
    ends_a, ends_b = np.cumsum(pair.a.lengths[ids_a]), np.cumsum(pair.lengths[ids_b])
    shared = np.intersect1d(ends_a, ends_b, assume_unique=True)  # every text's end is one
    last_a, last_b = np.searchsorted(ends_a, shared), np.searchsorted(ends_b, shared)
    text_of = np.searchsorted(at_a, last_a, "right") - 1
    digests = _digests(pair, ids_a, ids_b, last_a, last_b, at_a, at_b, good)
    counts = (np.diff(at_a), np.diff(at_b), np.bincount(text_of, minlength=n))
    return counts, digests, (text_of, ids_a[last_a], ids_b[last_b])


def _digests(pair: _Pair, ids_a, ids_b, last_a, last_b, at_a, at_b, good) -> list[str]:
    """SHA-256 of each text's groups: tokens in the order group, side, place, each with the sign after it."""
    sign_a, sign_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    sign_a[last_a], sign_b[last_b] = 1, 2
    sign_b[at_b[1:][good] - 1] = 3
    group_a, group_b = np.searchsorted(last_a, np.arange(len(ids_a))), np.searchsorted(last_b, np.arange(len(ids_b)))
    place = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
    ids, signs = np.concatenate([ids_a, ids_b])[place].tolist(), np.concatenate([sign_a, sign_b])[place].tolist()
    text = pair.text
    words = [text[s][i] for s, i in zip(signs, ids)]
    at = (at_a + at_b).tolist()
    return [hashlib.sha256("".join(words[at[k] : at[k + 1]]).encode()).hexdigest() if ok else "" for k, ok in enumerate(good.tolist())]


# -- postings ---------------------------------------------------------------


def planes(keys: np.ndarray, docs: np.ndarray, n_docs: int):
    """Links (pair key, document number) of a block inverted: keys, planes of each, and each plane's bytes."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    fresh = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])]))
    times = np.diff(np.append(fresh, len(keys)))
    keys, docs = keys[fresh], docs[fresh]
    names, first = np.unique(keys, return_index=True)
    row = np.repeat(np.arange(len(names)), np.diff(np.append(first, len(keys))))
    depth = np.frexp(np.maximum.reduceat(times, first).astype(np.float64))[1].astype(np.int64)  # planes of each pair
    at = np.concatenate([[0], np.cumsum(depth)])
    cells, members = [], []
    for plane in range(int(depth.max())):
        hit = np.flatnonzero(times >> plane & 1)
        cells.append(at[row[hit]] + plane)
        members.append(docs[hit])
    cells, members = np.concatenate(cells), np.concatenate(members)
    order = np.argsort(cells, kind="stable")
    cells, members = cells[order], members[order].astype("<u2")
    count = np.bincount(cells, minlength=at[-1])
    width = -(-n_docs // 8)
    begin = np.concatenate([[0], np.cumsum(count)])
    dense = np.flatnonzero(2 * count >= width)
    if not len(dense):
        return names, at, 2 * begin, members.tobytes(), count
    parts, length, done = [], 2 * count, 0
    for cell in dense.tolist():
        parts.append(members[done : begin[cell]].tobytes())
        bits = np.zeros(n_docs, np.uint8)
        bits[members[begin[cell] : begin[cell + 1]]] = 1
        parts.append(np.packbits(bits, bitorder="little").tobytes())
        length[cell], done = width, begin[cell + 1]
    parts.append(members[done:].tobytes())
    return names, at, np.concatenate([[0], np.cumsum(length)]), b"".join(parts), count


def plane_members(raw: bytes, n_docs: int) -> np.ndarray:
    """The document numbers of a plane: its bytes are a bitmap where a list would not be shorter."""
    if len(raw) == -(-n_docs // 8):
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8), count=n_docs, bitorder="little"))
    return np.frombuffer(raw, "<u2").astype(np.int64)


def _merged_count(at: np.ndarray, ends: np.ndarray, raw: bytes, count: np.ndarray, n_docs: int) -> np.ndarray:
    """The documents of each pair: its planes OR-merged, popcounted."""
    out = count[at[:-1]].copy()  # one plane needs no merge
    for k in np.flatnonzero(np.diff(at) > 1).tolist():
        merged = np.zeros(n_docs, bool)
        for cell in range(at[k], at[k + 1]):
            merged[plane_members(raw[ends[cell] : ends[cell + 1]], n_docs)] = True
        out[k] = np.count_nonzero(merged)
    return out


_ROWS = pa.schema(
    [("block", pa.int64()), ("n_docs", pa.int32()), ("pair", pa.int64()), ("planes", pa.list_(pa.binary())), ("docs", pa.int64()), ("links", pa.int64())]
    + [("doc_id", pa.int64()), ("number", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string())]
)
_SQL = "block long, n_docs int, pair long, planes array<binary>, docs long, links long, doc_id long, number int, n_a long, n_b long, n_groups long, groups_sha256 string"


def _batch(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _ROWS], schema=_ROWS)


def _inverted(path_a: str, path_b: str):
    """Documents (doc_id, text) to their own rows (block, number, counts, digest) and the blocks' posting rows (block, pair, planes)."""

    def postings(block, n_docs, links):
        owner, a, b = (np.concatenate(x) for x in zip(*links))
        if not len(owner):
            return
        names, at, ends, raw, count = planes(a << 32 | b, owner, n_docs)
        docs = _merged_count(at, ends, raw, count, n_docs)
        weighed = count << (np.arange(len(count)) - np.repeat(at[:-1], np.diff(at)))
        total = np.add.reduceat(weighed, at[:-1])
        for from_ in range(0, len(names), 1 << 14):
            to = min(len(names), from_ + (1 << 14))
            low, high = at[from_], at[to]
            cells = pa.Array.from_buffers(pa.binary(), int(high - low), [None, pa.py_buffer((ends[low : high + 1] - ends[low]).astype(np.int32)), pa.py_buffer(raw[ends[low] : ends[high]])])
            lists = pa.ListArray.from_arrays(pa.array(at[from_ : to + 1] - low, pa.int32()), cells)
            same = lambda v, t: pa.array(np.full(to - from_, v), t)
            yield _batch(to - from_, block=same(block, pa.int64()), n_docs=same(n_docs, pa.int32()), pair=pa.array(names[from_:to]), planes=lists, docs=pa.array(docs[from_:to]), links=pa.array(total[from_:to]))

    def run(batches):
        pair = load(path_a, path_b)
        block, number, held, links = TaskContext.get().partitionId() << 32, 0, 0, []
        for batch in batches:
            for piece in slices(batch, "text", _SLICE):
                if number and (held >= BLOCK_BYTES or number + piece.num_rows > BLOCK_DOCS):
                    yield from postings(block, number, links)
                    block, number, held, links = block + 1, 0, 0, []
                (n_a, n_b, n_groups), digests, (owner, a, b) = aligned(pair, piece.column(1))
                n = piece.num_rows
                links.append((owner + number, a, b))
                yield _batch(
                    n, block=pa.array(np.full(n, block)), number=pa.array(number + np.arange(n), pa.int32()), doc_id=piece.column(0).cast(pa.int64()),
                    n_a=pa.array(n_a, pa.int64()), n_b=pa.array(n_b, pa.int64()), n_groups=pa.array(n_groups, pa.int64()), groups_sha256=pa.array(digests),
                )
                number += n
                held += piece.column(1).nbytes
        if links:
            yield from postings(block, number, links)

    return run


def _returned(batches):
    """Scored posting rows (block, n_docs, planes, count, best) sorted by block to each document's sums."""
    schema = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64())])
    now, sums = None, np.zeros((3, 0), np.int64)

    def done():
        at = np.flatnonzero(sums[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), now), pa.int64()), pa.array(at, pa.int32()), *(pa.array(x[at]) for x in sums)], schema=schema)

    for batch in batches:
        block = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block)) if len(block) else []
        from_ = 0
        for to in ends:
            if block[from_] != now:
                if now is not None:
                    yield done()
                now, sums = int(block[from_]), np.zeros((3, batch.column(1)[from_].as_py()), np.int64)
            _add(sums, batch.slice(from_, to - from_))
            from_ = int(to)
    if now is not None:
        yield done()


def _add(sums: np.ndarray, rows: pa.RecordBatch) -> None:
    """Adds links, best links and pair counts of the rows' planes to their documents."""
    n_docs = sums.shape[1]
    lists = rows.column(2)
    depth = np.diff(lists.offsets.to_numpy())
    data, at = strings(lists.flatten())
    row = np.repeat(np.arange(len(depth)), depth)
    plane = np.arange(len(row)) - np.repeat(np.cumsum(depth) - depth, depth)
    length = np.diff(at)
    count, best = rows.column(3).to_numpy()[row], rows.column(4).to_numpy(zero_copy_only=False)[row].astype(np.int64)
    listed = length != -(-n_docs // 8)
    inside = np.repeat(listed, length)
    docs = np.ascontiguousarray(data[inside]).view("<u2").astype(np.int64)
    cell = np.repeat(np.flatnonzero(listed), length[listed] // 2)
    weight = np.int64(1) << plane[cell]
    sums[0] += np.bincount(docs, weights=weight, minlength=n_docs).astype(np.int64)
    sums[1] += np.bincount(docs, weights=weight * best[cell], minlength=n_docs).astype(np.int64)
    np.add.at(sums[2], docs, weight * count[cell])
    for k in np.flatnonzero(~listed).tolist():
        docs = plane_members(data[at[k] : at[k + 1]].tobytes(), n_docs)
        for row_, value in enumerate((1, best[k], count[k])):
            sums[row_, docs] += int(value) << int(plane[k])


def _stored(docs: DataFrame, paths: tuple[str, str]) -> tuple[DataFrame, DataFrame]:
    """(documents' rows, posting rows), written once to the shared folder."""
    folder = fresh_folder(docs.sparkSession, "alignment")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(_inverted(*paths), _SQL)
    rows.write.parquet(folder)
    stored = docs.sparkSession.read.schema(_SQL).parquet(folder)
    own = stored.filter("number is not null").select("block", "number", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256")
    return own, stored.filter("pair is not null").select("block", "n_docs", "pair", "planes", "docs", "links")


def _counts(postings: DataFrame) -> DataFrame:
    """pair, n_docs, n_links, n_rows, best of every id pair."""
    pairs = postings.groupBy("pair").agg(F.sum("docs").alias("n_docs"), F.sum("links").alias("n_links"), F.count("*").alias("n_rows"))
    named = pairs.withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    highest = named.groupBy("b").agg(F.max("n_links").alias("highest"))
    return named.join(highest, "b").select("pair", "n_docs", "n_links", "n_rows", (F.col("n_links") == F.col("highest")).alias("best"))


def pair_counts(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """a, b, n_docs, n_links, best: every linked id pair, the documents that hold it, its links, and whether its B id has none with more."""
    counts = _counts(_stored(docs, paths or default_paths())[1])
    return counts.select(F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n_docs", "n_links", "best")


def scored(docs: DataFrame, paths: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row."""
    spark = docs.sparkSession
    own, postings = _stored(docs, paths or default_paths())
    folder = fresh_folder(spark, "alignment-pairs")
    _counts(postings).select("pair", F.col("n_links").alias("count"), "n_rows", "best").write.parquet(folder)
    found = hot_join(postings.select("block", "n_docs", "planes", "pair"), spark.read.parquet(folder), "pair", "n_rows")
    dealt = found.select("block", "n_docs", "planes", "count", "best").repartition(shuffle_width(spark), "block").sortWithinPartitions("block")
    sums = dealt.mapInArrow(_returned, "block long, number int, n_links long, n_best long, count_sum long")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return own.join(sums, ["block", "number"], "left").select("doc_id", "n_a", "n_b", "n_groups", zero("n_links"), zero("n_best"), zero("count_sum"), "groups_sha256")
