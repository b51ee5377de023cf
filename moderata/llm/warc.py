"""WARC archives as chunked record tables.

Payloads travel as (record, chunk number) rows of at most ``CHUNK`` bytes, cut
by Spark before Python sees them, and read back as such rows. Each row read
carries the SHA-1 of the record's payload up to and including it, so the last
row of a record holds the whole payload's digest, and no task holds more than a
few chunks whatever a record's size. A record is a gzip member of its own;
files are closed after ``FILE`` bytes.

Of pages with equal payloads (same SHA-1 and length) of at least ``REVISIT``
bytes, that with the largest page_id is a response, the others are revisits
that refer to it and store no payload. Extension fields carry the page's id
and the full payload's length.

Defined cases: a null html is an empty payload; a null url has no target
field; null page_ids rank below all others and, in a group without any other,
are responses all; repeated rows of the responding page are responses all;
html with any characters is stored byte for byte; an empty table makes no
records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import open_fs
from .common import cut, fresh_folder, shuffle_width

REVISIT, CHUNK, FILE = 1000, 1 << 18, 1 << 28
DATE = "2024-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"


def records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All pages with payload, payload_bytes and sha1; and page_id, sha1, kept of those that are revisits."""
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha1", F.sha1("payload"))
    large = rows.filter(F.col("payload_bytes") >= REVISIT)
    # one narrow row per payload that occurs more than once; a payload of a third of all pages is counted in every task first
    copied = large.groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).filter("n > 1 and kept is not null")
    copies = large.select("page_id", "sha1", "payload_bytes").join(copied, ["sha1", "payload_bytes"]).filter("not page_id <=> kept")
    return rows, cut(copies.select("page_id", "sha1", "kept").distinct())


def chunked(rows: DataFrame, revisits: DataFrame) -> DataFrame:
    """The record table: page_id, url, payload_bytes, sha1, refers_to, chunk_no, n_chunks, chunk. The chunks of a record follow each other."""
    names = ["page_id", "url", "payload_bytes", "sha1"]
    again = revisits.withColumnsRenamed({"page_id": "page_id2", "sha1": "sha12", "kept": "refers_to"})
    marked = rows.join(again, F.col("page_id").eqNullSafe(F.col("page_id2")) & (F.col("sha1") == F.col("sha12")), "left").drop("page_id2", "sha12")
    body = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    sized = marked.select(*names, "refers_to", body.alias("body")).withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(CHUNK))).cast("int"))
    cut_up = sized.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    chunk = F.substring("body", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK))
    return cut_up.select(*names, "refers_to", "chunk_no", "n_chunks", chunk.alias("chunk"))


def _header(page_id, url, payload_bytes: int, sha1: str, refers_to) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~")))
    if refers_to is not None:
        fields += [("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(payload_bytes)), ("Content-Type", "text/html; charset=utf-8")]
    fields.append(("Content-Length", str(payload_bytes if refers_to is None else 0)))
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


class _Archive:
    """One file, written under a name of its attempt and moved to its own when closed."""

    def __init__(self, place: str):
        self.fs, self.place = open_fs(place)
        self.fs.create_dir(self.place.rsplit("/", 1)[0], recursive=True)
        self.name, self.size, self.n = f"{self.place}.inprogress-{uuid.uuid4().hex}", 0, 0
        self.out, self.member = self.fs.open_output_stream(self.name), None

    def put(self, data: bytes) -> None:
        self.size += len(data)
        self.out.write(data)

    def begin(self, header: bytes) -> None:
        self.member = zlib.compressobj(4, zlib.DEFLATED, 31)
        self.put(self.member.compress(header))

    def add(self, data: bytes) -> None:
        self.put(self.member.compress(data))

    def end(self) -> None:
        self.put(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.n += 1

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.name, self.place)


def write_archives(table: DataFrame, folder: str) -> DataFrame:
    """Writes a record table; one row per file: place, n_records. A retried task writes the same files under the same names."""

    def run(batches):
        part, seq, archive, done = TaskContext.get().partitionId(), 0, None, []
        for batch in batches:
            for k in range(batch.num_rows):
                page_id, url, size, sha1, refers_to, no, n, chunk = (batch.column(c)[k].as_py() for c in range(8))
                if no == 0:
                    if archive and archive.size >= FILE:
                        archive.close()
                        done.append(archive)
                        archive, seq = None, seq + 1
                    archive = archive or _Archive(f"{folder}/part-{part:06d}-{seq:06d}.warc.gz")
                    archive.begin(_header(page_id, url, size, sha1, refers_to))
                archive.add(chunk)
                if no == n - 1:
                    archive.end()
        if archive:
            archive.close()
            done.append(archive)
        places = [f"{folder}/{a.place.rsplit('/', 1)[1]}" for a in done]
        yield pa.RecordBatch.from_pydict({"place": pa.array(places, pa.string()), "n_records": pa.array([a.n for a in done], pa.int64())})

    return cut(table.mapInArrow(run, "place string, n_records long"))


class _Stream:
    """The uncompressed bytes of an archive, one gzip member after the other."""

    def __init__(self, file):
        self.file, self.buffer, self.member, self.over = file, bytearray(), zlib.decompressobj(31), False

    def _fill(self) -> bool:
        raw = self.member.unused_data if self.member.eof else self.member.unconsumed_tail
        if self.member.eof:
            self.member = zlib.decompressobj(31)
        raw = raw or self.file.read(CHUNK)
        if not raw:
            self.over = True
            return False
        self.buffer += self.member.decompress(raw, CHUNK)
        return True

    def line(self) -> bytes | None:
        while (at := self.buffer.find(b"\n")) < 0:
            if not self._fill():
                return None
        out = bytes(self.buffer[: at + 1])
        del self.buffer[: at + 1]
        return out

    def take(self, n: int) -> bytes:
        """The next bytes, at most n, at least one; fewer only at the end."""
        while len(self.buffer) < n and self._fill():
            pass
        out = bytes(self.buffer[:n])
        del self.buffer[:n]
        return out


def _records(stream: _Stream):
    """(header fields, payload chunk, number, digest so far, last) of each chunk of each record."""
    while True:
        line = stream.line()
        while line is not None and not line.strip():
            line = stream.line()
        if line is None:
            return
        if line.strip() != VERSION.strip():
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.line()) is not None and line.strip():
            key, _, value = line.decode().partition(":")
            fields[key.strip().lower()] = value.strip()
        left, no, digest = int(fields["content-length"]), 0, hashlib.sha1()
        while True:
            chunk = stream.take(min(CHUNK, left)) if left else b""
            if left and not chunk:
                raise ValueError("the archive ends within a record")
            digest.update(chunk)
            left -= len(chunk)
            yield fields, chunk, no, digest.copy(), not left
            no += 1
            if not left:
                break


def _page(name: str | None) -> int | None:
    inside = (name or "").strip("<>").rpartition(":")[2]
    return int(inside) if inside not in ("", "null") else None


_READ = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, chunk_no int, chunk_start long, chunk binary, digest string, last boolean"


def read_archives(files: DataFrame, with_chunks: bool = True) -> DataFrame:
    """The record table read back: a row per chunk with the payload's digest up to it; without chunks only each record's last row.

    A response whose bytes don't give the digest in its header is an error.
    """
    names = [c.split()[0] for c in _READ.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string(), pa.bool_()]
    schema = pa.schema(list(zip(names, kinds)))

    def run(batches):
        for batch in batches:
            for place in batch.column(0).to_pylist():
                fs, inner = open_fs(place)
                with fs.open_input_stream(inner, compression=None) as file:
                    rows, held = [], 0
                    for fields, chunk, no, digest, last in _records(_Stream(file)):
                        revisit = fields["warc-type"] == "revisit"
                        given = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
                        so_far = given if revisit else digest.hexdigest()
                        if last and so_far != given:
                            raise ValueError(f"{place}: {fields['warc-record-id']} is damaged")
                        if not (with_chunks or last):
                            continue
                        url = fields.get("warc-target-uri")
                        rows.append(
                            (
                                _page(fields["warc-record-id"]), None if url is None else unquote(url), fields["warc-type"], _page(fields.get("warc-refers-to")),
                                int(fields["x-payload-length"]), given, no, no * CHUNK, chunk if with_chunks else None, so_far, last,
                            )
                        )
                        held += len(chunk) + 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema=schema)

    width = shuffle_width(files.sparkSession)
    return files.select("place").repartition(width, "place").mapInArrow(run, _READ)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` and reads the archives back: one row per record."""
    rows, revisits = records(pages)
    files = write_archives(chunked(rows, revisits), fresh_folder(spark, "warc"))
    return read_archives(files, with_chunks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: DuckDB text for ``round_trip`` over ``pages`` (page_ids not null).
SQL = """
WITH payloads AS (
  SELECT page_id, url, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), groups AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS last_id FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> last_id THEN last_id END AS refers_to,
       url
FROM groups
"""
