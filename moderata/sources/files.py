"""Filesystem helpers shared by the task-side readers and writers.

Paths come from Spark listings (``file:/...``, ``hdfs://...``, ``s3a://...``);
pyarrow opens them with the matching filesystem inside the task.
"""

from __future__ import annotations

from urllib.parse import urlparse


def open_fs(path: str):
    """(pyarrow filesystem, path inside it) for a Spark-style path or URI."""
    import pyarrow.fs as pafs

    u = urlparse(path)
    if u.scheme in ("", "file"):
        return pafs.LocalFileSystem(), u.path if u.scheme else path
    uri = path.replace("s3a://", "s3://", 1).replace("s3n://", "s3://", 1)
    return pafs.FileSystem.from_uri(uri)


def write_bytes(path: str, data: bytes) -> None:
    """Write a file safely under task retries and speculation.

    Each attempt writes its own temp name and then moves it over the final
    name, so concurrent attempts never interleave bytes and the last complete
    write wins (all attempts write the same content).
    """
    import uuid

    fs, p = open_fs(path)
    parent = p.rsplit("/", 1)[0]
    fs.create_dir(parent, recursive=True)
    tmp = f"{p}.inprogress-{uuid.uuid4().hex}"
    with fs.open_output_stream(tmp) as out:
        out.write(data)
    fs.move(tmp, p)


def exists(path: str) -> bool:
    import pyarrow.fs as pafs

    fs, p = open_fs(path)
    return fs.get_file_info(p).type != pafs.FileType.NotFound
