"""Repeated byte strings of ``LENGTH`` bytes found by merging shard Burrows-Wheeler transforms.

Which windows may repeat (Spark): of the 32-byte strings inside a window, the
one with the smallest hash (leftmost of equals) is the window's anchor, so equal windows have their
anchors at equal offsets. Windows of one anchor whose offsets fall into the same ``STEP``
make a run; its key is a hash of the ``LENGTH - STEP + 1`` bytes that all its windows hold, so
equal windows are in runs of one key. Keys are counted with partial sums, and runs
whose key occurs once are done. The bytes that a run's windows cover are its
segment; equal segments become one with a weight, and segments of
one key meet in one task.

Which windows do repeat (in a task): segments are dealt into shards. A
segment's bytes are read in symbols of ``SYMBOL`` bytes, each place followed by the place ``SYMBOL``
bytes on, so a window is ``LENGTH / SYMBOL`` symbols. Each shard's suffixes are sorted once and its
BWT (the symbol before each suffix) taken. The BWTs are then merged by
interleave refinement: starting with the shards one after another, each
round sends every place of the interleave, in order, to the bucket of its BWT
symbol, which sorts it by one symbol more; where two neighbours part for the first time, the
round gives their common prefix. After LENGTH / SYMBOL rounds the runs of
places without a boundary are the repeated intervals. No suffix is sorted again.
Neighbouring windows of an interval are compared byte by byte before they count.

A key with more than ``CROWD`` different segments (a common passage with
different surroundings) doesn't go to one task: its windows are
counted by 128-bit digests instead, which is as exact.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing;
matches never cross documents; a string that starts twice in one document is
repeated; repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, cut, fresh_folder, hot_join, mix, row_key, shuffle_width, slices, span_hashes, split_by_bitmap, strings

LENGTH, SYMBOL = 400, 100
#: Bytes of an anchor; offsets of windows that share a run.
ANCHOR, STEP = 32, 128
#: Different segments of a key that one task merges.
CROWD = 1024
#: Bytes of a shard, and of the shards merged together.
SHARD, MERGED = 1 << 18, 1 << 20
#: Window starts worked on at a time; places in a piece take 20 bits.
_PIECE = 1 << 19


# -- runs of windows --------------------------------------------------------


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Text, first window, number of windows, key and segment hash of all runs of texts that lie end to end."""
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if len(data) < LENGTH:
        return none
    parts = []
    for from_ in range(0, len(data) - LENGTH + 1, _PIECE):
        parts.append(_piece_runs(data[from_ : from_ + _PIECE + LENGTH - 1], offsets - from_))
        parts[-1][1][:] += from_
    text, first, n, key, segment = (np.concatenate(x) for x in zip(*parts))
    return text, first - offsets[text], n, key, segment


def _piece_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    starts = np.arange(len(data) - ANCHOR + 1)
    least = span_hashes(data, starts, starts + ANCHOR) >> np.uint64(20) << np.uint64(20) | starts.astype(np.uint64)
    width, wide = LENGTH - ANCHOR + 1, 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    windows = len(data) - LENGTH + 1
    anchor = (np.minimum(least[:windows], least[width - wide : width - wide + windows]) & np.uint64((1 << 20) - 1)).astype(np.int64)
    place = np.arange(windows)
    text = np.searchsorted(offsets, place, "right") - 1
    level = (anchor - place) // STEP
    inside = place + LENGTH <= offsets[np.minimum(text + 1, len(offsets) - 1)]
    place, text, anchor, level = place[inside], text[inside], anchor[inside], level[inside]
    if not len(place):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    new = np.ones(len(place), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (level[1:] != level[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(place)))
    first, common = place[at], anchor[at] - STEP * level[at]
    with np.errstate(over="ignore"):
        salt = (level[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        key = mix(span_hashes(data, common, common + LENGTH - STEP + 1) + salt)
        segment = mix(span_hashes(data, first, first + n + LENGTH - 1) + salt)
    return text[at], first, n, key.view(np.int64), segment.view(np.int64)


_RUN = pa.struct([("first", pa.int32()), ("n", pa.int32()), ("key", pa.int64()), ("segment", pa.int64())])


def _scan(batches):
    """Rows (row key, text) to rows (row key, runs)."""
    for batch in batches:
        for piece in slices(batch, "text", _PIECE):
            text, first, n, key, segment = window_runs(*strings(piece.column(1)))
            at = pa.array(np.searchsorted(text, np.arange(piece.num_rows + 1)), pa.int32())
            fields = [pa.array(x, f.type) for x, f in zip((first, n, key, segment), _RUN)]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(fields, fields=list(_RUN)))], ["rk", "runs"])


# -- shard transforms and their merge ---------------------------------------


def _stable_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order that sorts rows of 31-bit symbols by the first column, then the next, equal rows by place; a sort takes as many columns as fit 63 bits."""
    n = len(columns[0])
    low, width = max(n - 1, 1).bit_length(), max(int(max(c.max(initial=0) for c in columns)).bit_length(), 1)
    at_once = max((63 - low) // width, 1)
    order = None
    for stop in range(len(columns), 0, -at_once):
        key = np.zeros(n, np.int64)
        for column in columns[max(stop - at_once, 0) : stop]:
            key = key << width | column
        now = np.sort((key if order is None else key[order]) << low | np.arange(n)) & (1 << low) - 1
        order = now if order is None else order[now]
    return order


def _by_symbol(symbols: np.ndarray) -> np.ndarray:
    """The order that sorts 31-bit symbols, equal ones by place (sorted by the low 16 bits, then by the others)."""
    order = np.argsort(symbols.astype(np.uint16), kind="stable")
    if symbols.max(initial=0) >> 16:
        order = order[np.argsort((symbols >> 16).astype(np.uint16)[order], kind="stable")]
    return order


def _by_shard(interleave: np.ndarray) -> np.ndarray:
    """Where the first shard's places stand in the interleave, then the next one's."""
    return np.argsort(interleave.astype(np.uint8) if interleave.max(initial=0) < 256 else interleave, kind="stable")


def _numbered(hashes: np.ndarray) -> np.ndarray:
    """A number from 1 on for each hash. Two hashes with one number are as two symbols with one hash."""
    low = np.uint64(max(len(hashes) - 1, 1).bit_length())
    packed = np.sort(hashes >> low << low | np.arange(len(hashes), dtype=np.uint64))
    high = packed >> low
    out = np.empty(len(hashes), np.int32)
    out[(packed & (np.uint64(1) << low) - np.uint64(1)).astype(np.int64)] = np.cumsum(np.concatenate([[True], high[1:] != high[:-1]]), dtype=np.int32)
    return out


class Shard:
    """The suffixes of a shard's segments in order, and the symbol before each (its BWT).

    Places come first, then one end per string (a string: the places of a
    segment that follow each other by ``SYMBOL`` bytes). Symbol 0 is the end.
    """

    def __init__(self, symbols: np.ndarray, place: np.ndarray, last: np.ndarray):
        """symbols: of each place, segments end to end; place: its byte place in its segment; last: the segment's last."""
        n, depth = len(symbols), LENGTH // SYMBOL + -(-STEP // SYMBOL)
        ends = np.flatnonzero(place + SYMBOL > last)
        columns = []
        left = last - place
        for k in range(depth):
            column = np.zeros(n + len(ends), symbols.dtype)
            column[: max(n - k * SYMBOL, 0)] = symbols[k * SYMBOL :]
            column[:n][left < k * SYMBOL] = 0
            columns.append(column)
        self.order = _stable_order(columns)
        before = np.zeros(n + len(ends), symbols.dtype)
        before[SYMBOL:n] = symbols[: max(n - SYMBOL, 0)]
        before[:n][place < SYMBOL] = 0
        before[n:] = symbols[ends]
        self.bwt = before[self.order]


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards' suffixes (shard of each place), and the symbols each place has in common with the one before.

    Common prefixes of ``rounds`` symbols or more are given as ``rounds``.
    """
    sizes = [len(s.bwt) for s in shards]
    interleave = np.repeat(np.arange(len(shards), dtype=np.int16), sizes)
    n_ends = [int(np.count_nonzero(s.bwt == 0)) for s in shards]
    block = np.zeros(len(interleave), np.int32)
    common = np.full(len(interleave), rounds, np.int8)
    symbol, bwt = np.empty(len(interleave), shards[0].bwt.dtype), np.concatenate([s.bwt for s in shards])
    for done in range(rounds):
        symbol[_by_shard(interleave)] = bwt
        order = _by_symbol(symbol)
        interleave, block = interleave[order], block[order]
        # string ends are alike; they keep the order of their shards
        interleave[: sum(n_ends)] = np.repeat(np.arange(len(shards), dtype=np.int16), n_ends)
        block[: sum(n_ends)] = 0
        sent = symbol[order]
        new = np.ones(len(block), bool)
        new[1:] = (sent[1:] != sent[:-1]) | (block[1:] != block[:-1])
        common[new & (common == rounds)] = done
        block = np.cumsum(new, dtype=np.int32)
    return interleave, common


def repeated_windows(segments: list[bytes], weights: list[int]) -> list[np.ndarray]:
    """For each segment, which of its windows start somewhere else too (a segment of weight 2 stands for two)."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    begin = np.cumsum(sizes) - sizes
    n_places = sizes - SYMBOL + 1
    owner = np.repeat(np.arange(len(segments), dtype=np.int32), n_places)
    first = np.cumsum(n_places) - n_places
    place = (np.arange(len(owner)) - np.repeat(first, n_places)).astype(np.int32)
    at = np.repeat(begin, n_places) + place
    symbols = _numbered(span_hashes(data, at, at + SYMBOL))
    shard_of = np.cumsum(sizes) // SHARD
    cuts = np.append(np.flatnonzero(np.diff(shard_of, prepend=-1)), len(segments))
    bounds = np.append(first, len(owner))[cuts]
    last = np.repeat((n_places - 1).astype(np.int32), n_places)
    shards = [Shard(symbols[a:b], place[a:b], last[a:b]) for a, b in zip(bounds, bounds[1:])]
    interleave, common = merge(shards, LENGTH // SYMBOL)
    # -1: a string's end
    inside = [np.where(shard.order < b - a, shard.order + a, -1) for shard, a, b in zip(shards, bounds, bounds[1:])]
    node = np.empty(len(interleave), np.int64)
    node[_by_shard(interleave)] = np.concatenate(inside)
    # repeated intervals: maximal runs of places with LENGTH bytes in common
    block = np.cumsum(common < LENGTH // SYMBOL)
    window = (node >= 0) & (place[node] <= (sizes - LENGTH)[owner[node]])
    node, block = node[window], block[window]
    weight = np.array(weights, np.int64)[owner[node]]
    starts = np.flatnonzero(np.diff(block, prepend=-1))
    total = np.repeat(np.add.reduceat(weight, starts), np.diff(np.append(starts, len(node)))) if len(node) else weight
    hit = total >= 2
    windows = sizes - LENGTH + 1
    from_ = np.cumsum(windows) - windows
    out = np.zeros(windows.sum(), bool)
    node, block, weight = node[hit], block[hit], weight[hit]
    for wrong in _unequal(data, at[node], block):
        some = np.flatnonzero(block == wrong)  # two symbols with one hash: told apart by their bytes
        bytes_ = [data[a : a + LENGTH].tobytes() for a in at[node[some]].tolist()]
        sums: dict[bytes, int] = {}
        for b, w in zip(bytes_, weight[some].tolist()):
            sums[b] = sums.get(b, 0) + w
        weight[some[[sums[b] < 2 for b in bytes_]]] = 0
    node = node[weight > 0]
    out[from_[owner[node]] + place[node]] = True
    return np.split(out, from_[1:])


def _unequal(data: np.ndarray, at: np.ndarray, block: np.ndarray) -> list[int]:
    """Blocks whose windows aren't all the same bytes."""
    views = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    out = set()
    for from_ in range(1, len(at), 1 << 14):
        to = min(len(at), from_ + (1 << 14))
        same = np.flatnonzero(block[from_:to] == block[from_ - 1 : to - 1]) + from_
        differ = (views[at[same]] != views[at[same - 1]]).any(axis=1)
        out.update(block[same[differ]].tolist())
    return sorted(out)


_MASK = pa.schema([("segment", pa.int64()), ("weight", pa.int64()), ("mask", pa.binary())])


def _merged(batches):
    """Segments sorted by key to the masks of those with repeated windows; whole keys of about ``MERGED`` bytes are merged at a time."""

    def masks(held):
        found = repeated_windows([h[1] for h in held], [h[2] for h in held])
        rows = [(h[0], h[2], np.packbits(f, bitorder="little").tobytes()) for h, f in zip(held, found) if f.any()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_MASK)], schema=_MASK)

    held, size, now = [], 0, None
    for batch in batches:
        for key, segment, weight, piece in zip(*(batch.column(c).to_pylist() for c in range(4))):
            if size >= MERGED and key != now:
                yield masks(held)
                held, size = [], 0
            held.append((segment, piece, weight))
            size += len(piece)
            now = key
    if held:
        yield masks(held)


def _windows(batches):
    """Segments to the digests of their windows: (digest, segment, weight, window)."""
    for batch in batches:
        for segment, weight, piece in zip(*(batch.column(c).to_pylist() for c in range(1, 4))):
            n = len(piece) - LENGTH + 1
            digests = [hashlib.blake2b(piece[k : k + LENGTH], digest_size=16).digest() for k in range(n)]
            columns = [pa.array(digests, pa.binary()), *(pa.array(np.full(n, x)) for x in (segment, weight)), pa.array(np.arange(n))]
            yield pa.RecordBatch.from_arrays(columns, ["digest", "segment", "weight", "window"])


def _bit_masks(batches):
    """Rows (segment, weight, windows) to masks."""
    for batch in batches:
        rows = []
        for windows in batch.column(2).to_pylist():
            bits = np.zeros(max(windows) + 1, bool)
            bits[windows] = True
            rows.append(np.packbits(bits, bitorder="little").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], schema=_MASK)


# -- the whole job ----------------------------------------------------------


def _segments(batches):
    """Rows (text, [(first, n, key, segment, weight)]) to segments (key, segment, weight, bytes)."""
    for batch in batches:
        for text, runs in zip(batch.column(0), batch.column(1)):
            raw, runs = text.as_buffer(), runs.as_py()
            pieces = [raw[r["first"] : r["first"] + r["n"] + LENGTH - 1].to_pybytes() for r in runs]
            columns = [pa.array([r[c] for r in runs], pa.int64()) for c in ("key", "segment", "weight")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], ["key", "segment", "weight", "bytes"])


def _masks(rows: DataFrame, likely: DataFrame) -> DataFrame:
    """segment, weight, mask (bit k: its k-th window is repeated) of all segments with repeated windows."""
    width = shuffle_width(rows.sparkSession)
    placed = likely.withColumn("place", F.xxhash64("rk", "first"))
    segments = cut(placed.groupBy("key", "segment").agg(F.count("*").alias("weight"), F.min("place").alias("place")))
    keys = cut(segments.groupBy("key").agg(F.sum("weight").alias("total"), F.count("*").alias("members")).filter("total > 1").select("key", "members", (F.col("members") > CROWD).alias("crowded")))
    wanted = cut(hot_join(segments, keys, "key", "members"))
    some, _ = split_by_bitmap(placed, "place", bitmap(wanted, "place"))
    owned = some.select("rk", "first", "n", "place").dropDuplicates(["place"]).join(wanted, "place")
    lists = owned.groupBy("rk").agg(F.collect_list(F.struct("first", "n", "key", "segment", "weight")).alias("runs"))
    texts, _ = split_by_bitmap(rows, "rk", bitmap(lists.select("rk"), "rk"))
    pieces = texts.dropDuplicates(["rk"]).join(lists, "rk").select("text", "runs").mapInArrow(_segments, "key long, segment long, weight long, bytes binary")
    folder = fresh_folder(rows.sparkSession, "repeats-segments")
    pieces.write.option("compression", "zstd").parquet(folder)
    pieces = rows.sparkSession.read.parquet(folder)
    crowded = wanted.filter("crowded").select(F.col("segment").alias("in_crowd"))
    few = pieces.join(crowded, F.col("segment") == F.col("in_crowd"), "left_anti")
    many = pieces.join(crowded, F.col("segment") == F.col("in_crowd"), "left_semi")
    mask = "segment long, weight long, mask binary"
    merged = few.repartition(width, "key").sortWithinPartitions("key").mapInArrow(_merged, mask)
    windows = many.mapInArrow(_windows, "digest binary, segment long, weight long, window long")
    again = cut(windows).withColumn("digest_", F.col("digest"))
    counted = cut(again.groupBy("digest").agg(F.sum("weight").alias("total"), F.count("*").alias("n")).filter("total > 1").select("digest", "n", F.lit(True).alias("twice")))
    found = hot_join(again.select("digest", "segment", "weight", F.col("window").cast("int")), counted, "digest", "n")
    listed = found.groupBy("segment", "weight").agg(F.collect_list("window").alias("windows"))
    return merged.union(listed.mapInArrow(_bit_masks, mask))


def _kept(kind: str):
    """Rows (doc_id, text, [(first, mask)]) to doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the kept bytes."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 4 << 20):
                data, offsets = strings(piece.column(1))
                columns: list[list] = [[], [], [], [], []]
                for k, spots in enumerate(piece.column(2).to_pylist()):
                    raw = data[offsets[k] : offsets[k + 1]]
                    edge = np.zeros(len(raw) + 8, np.int32)  # a mask's last byte may reach 7 places too far, with zeros
                    for spot in spots or []:
                        starts, from_ = np.unpackbits(np.frombuffer(spot["mask"], np.uint8), bitorder="little"), spot["first"]
                        edge[from_ : from_ + len(starts)] += starts
                        edge[from_ + LENGTH : from_ + LENGTH + len(starts)] -= starts
                    gone = np.cumsum(edge[: len(raw)]) > 0
                    kept = raw[~gone].tobytes()
                    spans = np.count_nonzero(gone[1:] & ~gone[:-1]) + bool(len(gone) and gone[0])
                    for column, value in zip(columns, (len(raw), int(gone.sum()), int(spans), hashlib.sha256(kept).hexdigest(), kept)):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay) of every row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", row_key(F.col("doc_id"), text).alias("rk"), text.alias("text"))
    rows = base.filter(F.octet_length("text") >= LENGTH).select("rk", "text")
    folder = fresh_folder(spark, "repeats-runs")
    rows.mapInArrow(_scan, "rk binary, runs array<struct<first: int, n: int, key: long, segment: long>>").write.parquet(folder)
    runs = spark.read.parquet(folder).select("rk", F.inline("runs"))
    shared = cut(runs.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    likely, _ = split_by_bitmap(runs, "key", bitmap(shared, "key"))
    masks = cut(_masks(rows, likely))
    spots = hot_join(likely.select("rk", "first", "segment"), masks, "segment", "weight").select("rk", "first", "mask").distinct()
    given = cut(spots.groupBy("rk").agg(F.collect_list(F.struct("first", "mask")).alias("spots")))
    touched, rest = split_by_bitmap(base, "rk", bitmap(given.select("rk"), "rk"))
    run, schema = _kept(kind)
    changed = touched.join(given, "rk", "left").select("doc_id", "text", "spots").mapInArrow(run, schema)
    zero = F.lit(0).cast("long")
    same = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2("text", 256).alias("kept_sha256"), F.col("text").cast("binary").alias("kept"))
    return changed.union(same)
