"""Token-id files coded by a static range asymmetric numeral system (rANS).

Documents are dealt by ranges of their id and sorted, encoded, and written as
files. A file has one frequency table over all its ids, shared by its blocks;
each block holds whole documents, is coded by ``LANES`` interleaved coders of
its own, and can be decoded alone. The index at the file's end is the list of
checkpoints: each block's place, its first id's position in the file and the
checksums of its bytes and ids. Reading deals out blocks, not files.

File: blocks, index (zlib), length of the index (u64), magic. A block: number
of documents (u32), number of ids (u64), number of words (u64), documents' ids
(i64, with a null mask of bytes) and lengths (i64), states (u64 a lane), words
(u32).

Defined cases: null text has only the end id; null ids come first; equal ids
are ordered by text hash; an empty table makes no files and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.files import open_fs, write_bytes
from . import bpe
from .common import cut, fresh_folder, shuffle_width, slices

MAGIC = b"RANSIDS1"
LANES, SCALE = 1024, 20
LOW = 1 << 31
END_ID = 2
BLOCK_IDS, FILE_IDS = 1 << 18, 1 << 23


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of 2^SCALE, at least 1 for each id that occurs."""
    whole = 1 << SCALE
    present = counts > 0
    free = whole - int(present.sum())
    share = np.floor(counts * (free / max(1, counts.sum()))).astype(np.int64)
    share[present] += 1
    share[int(np.argmax(counts))] += whole - int(share.sum())
    return share


class Table:
    """Frequencies, their running sums, and the id of each slot."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.first = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.slots: np.ndarray | None = None

    def ids(self) -> np.ndarray:
        if self.slots is None:
            self.slots = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self.slots


def encode(ids: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray]:
    """Final states and words of one block; ids are dealt to the lanes in turn, coded from the last to the first."""
    steps = -(-len(ids) // LANES)
    padded = np.full(steps * LANES, ids[0], np.int64)
    padded[: len(ids)] = ids
    freq, first = table.freq[padded].reshape(steps, LANES), table.first[padded].reshape(steps, LANES)
    state = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    word, low = np.uint64(32), np.uint64(0xFFFFFFFF)
    limit = freq << np.uint64(31 - SCALE + 32)
    for t in range(steps - 1, -1, -1):
        over = state >= limit[t]
        if over.any():
            words.append((state[over] & low).astype(np.uint32))
            state = np.where(over, state >> word, state)
        else:
            words.append(np.zeros(0, np.uint32))
        times, rest = np.divmod(state, freq[t])
        state = (times << np.uint64(SCALE)) + rest + first[t]
    words.reverse()
    return state, np.concatenate(words)


def decode(state: np.ndarray, words: np.ndarray, n: int, table: Table) -> np.ndarray:
    steps = -(-n // LANES)
    out = np.empty((steps, LANES), np.uint32)
    slots, freq, first = table.ids(), table.freq, table.first
    mask, scale, low, word = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(LOW), np.uint64(32)
    at = 0
    words = words.astype(np.uint64)
    for t in range(steps):
        slot = state & mask
        ids = slots[slot]
        out[t] = ids
        state = freq[ids] * (state >> scale) + slot - first[ids]
        under = np.flatnonzero(state < low)
        if len(under):
            state[under] = (state[under] << word) | words[at : at + len(under)]
            at += len(under)
    return out.reshape(-1)[:n]


def _file(doc_ids: list, lengths: list[int], ids: np.ndarray) -> tuple[bytes, int]:
    """A whole file, and its number of blocks."""
    table = Table(frequencies(np.bincount(ids)))
    ends = np.cumsum(lengths)
    out, index, place, doc, done = [], [], 0, 0, 0
    while doc < len(lengths):
        stop = max(doc + 1, int(np.searchsorted(ends, done + BLOCK_IDS, "right")))
        part = ids[done : ends[stop - 1]]
        state, words = encode(part, table)
        known = doc_ids[doc:stop]
        block = b"".join(
            [
                struct.pack("<IQQ", stop - doc, len(part), len(words)),
                bytes(x is None for x in known), np.array([x or 0 for x in known], "<i8").tobytes(), np.array(lengths[doc:stop], "<i8").tobytes(),
                state.astype("<u8").tobytes(), words.astype("<u4").tobytes(),
            ]
        )
        index.append([place, len(block), done, zlib.crc32(block), zlib.crc32(part.astype("<u4").tobytes())])
        out.append(block)
        place, doc, done = place + len(block), stop, int(ends[stop - 1])
    used = np.flatnonzero(table.freq)
    tail = zlib.compress(json.dumps({"lanes": LANES, "scale": SCALE, "blocks": index, "ids": used.tolist(), "freq": table.freq[used].tolist()}).encode(), 6)
    return b"".join([*out, tail, struct.pack("<Q", len(tail)), MAGIC]), len(index)


def write_ids(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the files of ``docs`` (doc_id, text) in ascending doc_id order; one row per file: place, part, seq, n_docs, n_ids, n_blocks.

    A task holds at most ``FILE_IDS`` ids and one document. A retried task writes the same files again under the same names.
    """
    path = path or bpe.default_path()

    def run(batches):
        part = TaskContext.get().partitionId()
        coder = bpe.load(path)
        seq, names, lengths, parts, n = 0, [], [], [], 0

        def flush():
            data, blocks = _file(names, lengths, np.concatenate(parts))
            place = f"{folder}/part-{part:06d}-{seq:06d}.rans"
            write_bytes(place, data)
            return pa.RecordBatch.from_pydict({"place": [place], "part": [part], "seq": [seq], "n_docs": [len(names)], "n_ids": [n], "n_blocks": [blocks]})

        for batch in batches:
            for piece in slices(batch, "text"):
                ids, at = coder.encode(piece.column(1))
                counts = np.diff(at)
                ended = np.empty(len(ids) + len(counts), np.uint32)
                last = at[1:] + np.arange(len(counts))
                inner = np.ones(len(ended), bool)
                inner[last] = False
                ended[inner] = ids
                ended[last] = end_id
                names += piece.column(0).to_pylist()
                lengths += (counts + 1).tolist()
                parts.append(ended)
                n += len(ended)
                if n >= FILE_IDS:
                    yield flush()
                    seq, names, lengths, parts, n = seq + 1, [], [], [], 0
        if names:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(shuffle_width(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return cut(ordered.mapInArrow(run, "place string, part long, seq long, n_docs long, n_ids long, n_blocks long"))


class _Reader:
    def __init__(self, place: str):
        fs, inner = open_fs(place)
        self.file = fs.open_input_file(inner)
        size = self.file.size()
        length, magic = struct.unpack("<Q8s", self.file.read_at(16, size - 16))
        if magic != MAGIC:
            raise ValueError(f"{place} isn't a token-id file, or was cut off")
        spec = json.loads(zlib.decompress(self.file.read_at(length, size - 16 - length)))
        if (spec["lanes"], spec["scale"]) != (LANES, SCALE):
            raise ValueError(f"{place} was written with other settings")
        self.blocks = spec["blocks"]
        freq = np.zeros(max(spec["ids"]) + 1, np.int64)
        freq[spec["ids"]] = spec["freq"]
        self.table, self.place = Table(freq), place

    def block(self, k: int):
        """Documents' ids, lengths, all ids, and the position of the first in the file; checksums are compared."""
        place, length, start, crc, ids_crc = self.blocks[k]
        raw = self.file.read_at(length, place)
        if zlib.crc32(raw) != crc:
            raise ValueError(f"{self.place}: block {k} is damaged")
        docs, n, words = struct.unpack_from("<IQQ", raw)
        at = 20
        null = raw[at : at + docs]
        names = np.frombuffer(raw, "<i8", docs, at + docs).tolist()
        lengths = np.frombuffer(raw, "<i8", docs, at + 9 * docs)
        at += 17 * docs
        state = np.frombuffer(raw, "<u8", LANES, at).copy()
        ids = decode(state, np.frombuffer(raw, "<u4", words, at + 8 * LANES), n, self.table)
        if zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
            raise ValueError(f"{self.place}: block {k} decodes to other ids")
        return [None if z else x for x, z in zip(names, null)], lengths, ids, start


def read_ids(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids of every document of the files that ``write_ids`` lists."""
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("file_start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))  # one row per file of FILE_IDS ids
    blocks = placed.select("place", "file_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_blocks") - 1)).alias("block"))

    def run(batches):
        reader = None
        for batch in batches:
            for place, file_start, block in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if reader is None or reader.place != place:
                    reader = _Reader(place)
                names, lengths, ids, start = reader.block(block)
                ends = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
                offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
                columns = [
                    pa.array(names, pa.int64()), pa.array(file_start + start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                    pa.array(crc, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    width = shuffle_width(files.sparkSession)
    return blocks.repartition(width, "place", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids array<int>")


def round_trip(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes ``docs`` and reads the files back."""
    return read_ids(write_ids(docs, fresh_folder(spark, "rans"), path))
