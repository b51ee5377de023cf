"""BPE encoding with content-defined chunk reuse, and decoding.

Texts are cut where a rolling hash says so, so equal passages give equal
chunks wherever they stand. Chunk hashes are counted over all texts; a chunk
that occurs more than once is encoded once, by the text that owns it, and its
ids are joined back to every text that uses it. All other chunks are encoded in
place. Ids next to a cut may be wrong, as pre-tokens and merges reach across
it. So around each cut a window is encoded anew, from a sure pre-token start in
the left chunk on; where the window's pre-tokens agree with the right chunk's,
that chunk's ids go on. Without agreement the window grows, at last to the
whole text. Every decoded text is compared with its source; a text that
differs (two chunks of one hash) is encoded whole.

Texts without a shared chunk are encoded where they are read; only the others
move. Their work is keyed by (text hash, smallest doc_id), so equal texts are
encoded once and a text that a third of all rows share is not one task's.

Defined cases: null is the empty text (no ids); texts with a special token's
string are encoded whole by the library; repeated rows each get a row; null
ids are allowed; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import bitmap, cut, mix, slices, span_hashes, split_by_bitmap, strings

#: Smallest and largest chunk in bytes; bits of the rolling hash that must be zero at a cut.
LEAST, MOST, BITS = 256, 8192, 10
#: Bytes from a cut to the pre-token starts between which a window is encoded anew.
MARGINS = (16, 96)
_GEAR = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """A 32-bit hash of the 32 bytes up to each place: their table values, shifted by their distance, added."""
    h = _GEAR[data]
    for shift in (1, 2, 4, 8, 16):
        if len(h) > shift:
            more = h.copy()
            more[shift:] += h[:-shift] << np.uint32(shift)
            h = more
    return h


def chunk_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and stops of all chunks, and the n+1 offsets of the texts' chunks. An empty text has none."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
    sure = np.ones(len(data), bool)
    sure[:-1] = (data[1:] & 0xC0) != 0x80  # a character ends here
    places = np.flatnonzero((rolling(data) >> np.uint32(32 - BITS) == 0) & sure) + 1
    first = np.searchsorted(places, offsets)
    starts, counts = [], []
    for k in range(n):
        begin, end = int(offsets[k]), int(offsets[k + 1])
        had = len(starts)
        if end > begin:
            last = begin
            starts.append(begin)
            for place in [*places[first[k] : first[k + 1]].tolist(), end]:
                while place - last > MOST and end - last >= MOST + LEAST:
                    last += MOST
                    while not sure[last - 1]:
                        last -= 1
                    starts.append(last)
                if place - last >= LEAST and end - place >= LEAST:
                    starts.append(place)
                    last = place
        counts.append(len(starts) - had)
    begin = np.array(starts, np.int64)
    at = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    stop = np.empty_like(begin)
    stop[:-1] = begin[1:]
    full = offsets[1:][np.diff(offsets) > 0]
    stop[at[1:][np.diff(offsets) > 0] - 1] = full
    return begin, stop, at


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _scan(batches):
    """Per text: the hashes of its chunks."""
    for batch in batches:
        for piece in slices(batch, "text"):
            data, offsets = strings(piece.column(2))
            begin, stop, at = chunk_spans(data, offsets)
            hashes = span_hashes(data, begin, stop).view(np.int64)
            chunks = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), chunks], ["doc_id", "tk", "hashes"])


class _Chunk:
    """Ids of a chunk and, for each margin, a sure pre-token start after its start (head) and before its end (tail)."""

    __slots__ = ("ids", "heads", "tails")

    def __init__(self, ids, heads, tails):
        self.ids, self.heads, self.tails = ids, heads, tails


def _encoded(coder: bpe.Bpe, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[_Chunk]:
    """The chunks encoded each on its own."""
    if not len(begin):
        return []
    texts = _texts(data, begin, stop)
    ids, at, (cuts, counts) = coder.encode_pieces(texts)
    if len(ids) != counts.sum():  # a special token's string in one of them: these texts are encoded whole elsewhere
        counts = np.zeros(len(cuts), np.int64)
    upto = np.concatenate([[0], np.cumsum(counts)])
    bounds = np.concatenate([[0], np.cumsum(stop - begin)])
    first, last = np.searchsorted(cuts, bounds[:-1]), np.searchsorted(cuts, bounds[1:])
    places = []
    for margin in MARGINS:
        head = np.searchsorted(cuts, bounds[:-1] + margin)
        tail = np.searchsorted(cuts, bounds[1:] - margin, "right") - 1
        safe = np.minimum(head, len(cuts) - 1)
        places.append(
            (
                np.where(head < last, cuts[safe] - bounds[:-1], -1), np.where(head < last, upto[safe] - upto[first], 0),
                np.where(tail > first, cuts[tail] - bounds[:-1], -1), np.where(tail > first, upto[tail] - upto[first], 0),
            )
        )
    rows = [[a.tolist() for a in group] for group in places]
    return [
        _Chunk(ids[at[k] : at[k + 1]], [(r[0][k], r[1][k]) for r in rows], [(r[2][k], r[3][k]) for r in rows])
        for k in range(len(begin))
    ]


def _texts(data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(stop - begin)])
    if len(begin) and (begin[1:] == stop[:-1]).all():
        joined = data[begin[0] : stop[-1]]
    else:
        joined = np.concatenate([data[a:b] for a, b in zip(begin, stop)]) if len(begin) else data[:0]
    return pa.Array.from_buffers(pa.large_string(), len(begin), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(joined))])


def _repaired(coder: bpe.Bpe, data: np.ndarray, begin: np.ndarray, stop: np.ndarray, at: np.ndarray, chunks: list[_Chunk]) -> dict[int, tuple]:
    """For each cut, by the chunk to its left: ids to keep of the left chunk, the window's ids, ids to drop of the right one. Without agreement: none."""
    inner = np.ones(len(begin), bool)
    inner[at[1:][np.diff(at) > 0] - 1] = False
    todo, done = np.flatnonzero(inner).tolist(), {}
    ends = np.repeat(np.append(stop, 0)[at[1:] - 1], np.diff(at))  # where each chunk's text ends
    for level in range(len(MARGINS)):
        tried, spans = [], []
        for k in todo:
            tail, keep = chunks[k].tails[level]
            head, drop = chunks[k + 1].heads[level]
            # the start must lie beyond what the cut before may have changed, the end before the next cut's window
            if tail < 0 or head < 0 or tail <= chunks[k].heads[level][0]:
                continue
            reach = min(int(begin[k + 1]) + head + 24, int(ends[k]))
            while reach < ends[k] and data[reach] & 0xC0 == 0x80:
                reach += 1
            tried.append((k, keep, drop))
            spans.append((int(begin[k]) + tail, reach, int(begin[k + 1]) + head))
        if tried:
            from_, to, agree = (np.array(x, np.int64) for x in zip(*spans))
            ids, _, (cuts, counts) = coder.encode_pieces(_texts(data, from_, to))
            if len(ids) != counts.sum():
                break
            upto = np.concatenate([[0], np.cumsum(counts)])
            bounds = np.concatenate([[0], np.cumsum(to - from_)[:-1]])
            here = np.searchsorted(cuts, bounds + agree - from_)
            hit = cuts[np.minimum(here, len(cuts) - 1)] == bounds + agree - from_
            start = np.searchsorted(cuts, bounds)
            for j, (k, keep, drop) in enumerate(tried):
                if hit[j]:
                    done[k] = (keep, ids[upto[start[j]] : upto[here[j]]], drop)
        todo = [k for k in todo if k not in done]
        if not todo:
            break
    return done


def encode_texts(coder: bpe.Bpe, column: pa.Array, shared: list | None = None) -> list[np.ndarray]:
    """The ids of each text of a column. shared: for each text, the chunks known already, by their number."""
    data, offsets = strings(column)
    begin, stop, at = chunk_spans(data, offsets)
    known: dict[int, _Chunk] = {}
    for k, more in enumerate(shared or []):
        for number, chunk in more.items():
            if number < at[k + 1] - at[k]:
                known[int(at[k]) + number] = chunk
    own = np.array([k for k in range(len(begin)) if k not in known], np.int64)
    chunks: list = [known.get(k) for k in range(len(begin))]
    for k, chunk in zip(own.tolist(), _encoded(coder, data, begin[own], stop[own])):
        chunks[k] = chunk
    marked = set(coder._special_texts(column).tolist())
    done = _repaired(coder, data, begin, stop, at, chunks)
    whole, out = [], []
    for k in range(len(offsets) - 1):
        low, high = int(at[k]), int(at[k + 1])
        if k in marked or any(j not in done for j in range(low, high - 1)):
            whole.append(k)
            out.append(None)
            continue
        parts, from_ = [], 0
        for j in range(low, high):
            if j < high - 1:
                keep, window, drop = done[j]
                if keep < from_:  # the window before reaches beyond this one's start
                    whole.append(k)
                    break
                parts += [chunks[j].ids[from_:keep], window]
                from_ = drop
            else:
                parts.append(chunks[j].ids[from_:])
        out.append(np.concatenate(parts) if parts and whole[-1:] != [k] else None if parts else np.zeros(0, np.uint16))
    ends = np.append(offsets, 0)
    for k in range(len(out)):
        if out[k] is not None and len(out[k]) and coder.lengths[out[k]].sum() != ends[k + 1] - ends[k]:
            whole.append(k)
    if whole:
        again, where = coder.encode(column.take(pa.array(whole)))
        for j, k in enumerate(whole):
            out[k] = again[where[j] : where[j + 1]]
    return out


_NUMBERS = [f"{side}{level}_{what}" for level in range(len(MARGINS)) for side in ("head", "tail") for what in ("at", "id")]
_CHUNK = "ids binary, " + ", ".join(f"{n} int" for n in _NUMBERS)


def _row(chunk: _Chunk) -> dict:
    flat = [x for head, tail in zip(chunk.heads, chunk.tails) for x in (*head, *tail)]
    return {"ids": chunk.ids.astype("<u2" if chunk.ids.dtype.itemsize == 2 else "<u4").tobytes(), **dict(zip(_NUMBERS, (int(x) for x in flat)))}


def _from_row(row: dict, kind) -> _Chunk:
    flat = [row[n] for n in _NUMBERS]
    heads = [(flat[4 * k], flat[4 * k + 1]) for k in range(len(MARGINS))]
    tails = [(flat[4 * k + 2], flat[4 * k + 3]) for k in range(len(MARGINS))]
    return _Chunk(np.frombuffer(row["ids"], kind), heads, tails)


def _owners(path: str):
    """Rows (row key, text, [(chunk number, hash)]) to rows (hash, ids and sure starts)."""

    def run(batches):
        coder = bpe.load(path)
        schema = pa.schema([("hash", pa.int64()), ("ids", pa.binary()), *((n, pa.int32()) for n in _NUMBERS)])
        for batch in batches:
            for piece in slices(batch, "text"):
                data, offsets = strings(piece.column(0))
                begin, stop, at = chunk_spans(data, offsets)
                wanted = piece.column(1).to_pylist()
                picked = [(int(at[k]) + w["no"], w["hash"]) for k, more in enumerate(wanted) for w in more]
                spots = np.array([p for p, _ in picked], np.int64)
                rows = [{"hash": h} | _row(c) for (_, h), c in zip(picked, _encoded(coder, data, begin[spots], stop[spots]))]
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _finish(path: str, keyed: str, kind: str, with_ids: bool):
    """Rows (key, text, [chunk number, ids and sure starts] or nothing) to digests of the ids and of the decoded text."""
    schema = f"{keyed} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string{', ids binary' if with_ids else ''}"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        coder = bpe.load(path)
        width = coder.flat.dtype
        for batch in batches:
            if keyed == "tk":  # repeated rows lie side by side, sorted by their row key
                keys = batch.column(0).to_pylist()
                batch = batch.filter(pa.array([k == 0 or keys[k] != keys[k - 1] for k in range(len(keys))], pa.bool_()))
            for piece in slices(batch, "text"):
                shared = [{s["no"]: _from_row(s, width) for s in more or []} for more in piece.column(2).to_pylist()] if piece.num_columns > 2 else None
                columns: list[list] = [[] for _ in names[1:]]
                for k, ids in enumerate(encode_texts(coder, piece.column(1), shared)):
                    text = (piece.column(1)[k].as_py() or "").encode()
                    decoded = coder.decode(ids)
                    if decoded != text:  # two chunks with one hash
                        ids = coder.encode(piece.column(1).slice(k, 1))[0]
                        decoded = coder.decode(ids)
                    raw = ids.astype("<u4").tobytes()
                    for column, value in zip(columns, (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded).hexdigest(), raw)):
                        column.append(value)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([piece.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    return run, schema


def encoded_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_ids: also the ids, as little-endian 32-bit integers."""
    path = path or bpe.default_path()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", text_key(text).alias("tk"), text.alias("text"))
    scanned = cut(rows.mapInArrow(_scan, f"doc_id {kind}, tk binary, hashes array<long>"))
    named = lambda c: F.unhex(F.sha1(F.concat(F.col("tk"), F.coalesce(F.col(c).cast("string"), F.lit("null")).cast("binary"))))
    chunks = scanned.select("tk", "doc_id", F.explode("hashes").alias("hash"))
    shared = cut(chunks.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"))

    # texts without a shared chunk have no copy either: they are encoded where they are read
    part = bitmap(chunks.join(shared, "hash", "left_semi"), "tk")
    touched, alone = split_by_bitmap(rows, "tk", part)
    known, _ = split_by_bitmap(scanned, "tk", part)
    run, schema = _finish(path, "doc_id", kind, with_ids)
    simple = alone.select("doc_id", "text").mapInArrow(run, schema)

    texts = cut(known.groupBy("tk").agg(F.min("doc_id").alias("doc_id"), F.first("hashes").alias("hashes")).select(named("doc_id").alias("rk"), "tk", "hashes"))
    uses = texts.select("rk", F.posexplode("hashes").alias("no", "hash")).join(shared, "hash")
    owned = uses.groupBy("hash").agg(F.min(F.struct("rk", "no")).alias("owner"))
    owned = owned.groupBy(F.col("owner.rk").alias("rk")).agg(F.collect_list(F.struct(F.col("owner.no").alias("no"), "hash")).alias("wanted"))
    base = touched.select(named("doc_id").alias("rk"), "text")
    once = cut(base.join(owned, "rk").select("text", "wanted").mapInArrow(_owners(path), f"hash long, {_CHUNK}")).dropDuplicates(["hash"])
    given = uses.join(once, "hash").groupBy("rk").agg(F.collect_list(F.struct("no", "ids", *_NUMBERS)).alias("shared"))
    work = texts.select("rk", "tk").join(given, "rk", "left")
    run, schema = _finish(path, "tk", "binary", with_ids)
    # rows with equal ids and texts have one row key: they are encoded alike, and one of them is kept
    finished = cut(base.join(work, "rk").select("tk", "text", "shared").mapInArrow(run, schema)).dropDuplicates(["tk"])
    return simple.union(known.select("doc_id", "tk").join(finished, "tk").drop("tk"))
