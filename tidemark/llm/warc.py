"""WARC archives: a writer, and a reader that splits files at any byte.

Each record is a gzip member of its own.  A reading task gets a byte range of
a file, looks for gzip magic, tries a candidate by inflating its first bytes
and asking for a WARC header, and owns the records that start inside its
range, the last of which it may follow beyond the end.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch

MAGIC = b"\x1f\x8b\x08"
SCHEMES = {"s3a": "s3", "s3n": "s3"}  # Hadoop's names of stores and pyarrow's
BROADCAST = 64 << 20  # bytes of the table of repeated payloads up to which it is broadcast
TASKS = 10_000  # of a reading stage, at most; beyond, a task takes several ranges
SMALL = 100  # payloads of fewer bytes are never revisits
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "path string, bytes long, records long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, digest: str) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _name(page_id), "WARC-Date": DATE}
    if url is not None:
        head["WARC-Target-URI"] = quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    head["WARC-Payload-Digest"] = f"sha256:{digest}"
    if refers_to is not None:
        head |= {"WARC-Refers-To": _name(refers_to), "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    head |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def parse(data: bytes) -> tuple | None:
    """(page_id, url, payload bytes, digest, type, refers_to), or None if it is no page record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
    kind = fields.get("WARC-Type")
    block = block[: int(fields.get("Content-Length", 0))]
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "response":
        n, digest = len(payload), hashlib.sha256(payload).hexdigest()
    elif kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        n, digest = int(m[1]) if m else None, fields.get("WARC-Payload-Digest", "").rpartition(":")[2]
    else:
        return None
    return _id(fields.get("WARC-Record-ID", "")), fields.get("WARC-Target-URI"), n, digest, kind, _id(fields.get("WARC-Refers-To", ""))


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path there: local, HDFS, S3, GCS or Azure, by its Hadoop name."""
    scheme, sep, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(SCHEMES.get(scheme, scheme) + sep + rest)


def _writer(root: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        out, path, size, n = None, "", 0, 0

        def row():
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size]), pa.array([n])], names=["path", "bytes", "records"])

        for b in batches:
            for page_id, url, html, refers_to, digest in zip(*(b.column(k) for k in range(5)), strict=True):
                if out is None:  # the name is new for each attempt; only a finished attempt's files reach the manifest
                    path, size, n = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path, compression=None)
                m = member(record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode(), refers_to.as_py(), digest.as_py()))
                out.write(m)
                size, n = size + len(m), n + 1
                if size >= roll:
                    out.close()
                    out = None
                    yield row()
        if out is not None:
            out.close()
            yield row()

    return run


def scan(f, start: int, end: int, step: int = 1 << 20) -> Iterator[bytes]:
    """The inflated members of a seekable file that start in [start, end)."""
    at = start
    buffer, low = b"", start

    def have(pos: int, n: int) -> bytes:
        nonlocal buffer, low
        if pos < low or pos + n > low + len(buffer):
            f.seek(pos)
            buffer, low = f.read(max(n, step)), pos
        return buffer[pos - low : pos - low + n]

    while at < end:
        window = have(at, min(step, end - at + len(MAGIC) - 1))
        hit = window.find(MAGIC)
        if hit < 0:
            if len(window) < len(MAGIC):
                return
            at += len(window) - len(MAGIC) + 1
            continue
        at += hit
        if at >= end:
            return
        z, data, pos = zlib.decompressobj(31), [], at
        try:
            data.append(z.decompress(have(at, 512)))
            pos = at + 512
            if not data[0].startswith(b"WARC/1."):
                raise zlib.error
            while not z.eof:
                chunk = have(pos, 1 << 16)
                if not chunk:
                    raise zlib.error  # cut off
                data.append(z.decompress(chunk))
                pos += len(chunk)
        except zlib.error:
            at += 1
            continue
        yield b"".join(data)
        f_size_read = pos if pos <= low + len(buffer) else low + len(buffer)
        at = f_size_read - len(z.unused_data)


def _reader(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(root)
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for b in batches:
            for path, start, end in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with store.open_input_file(path) as f:
                    records = (r for x in scan(f, start, end) if (r := parse(x)))
                    while rows := list(islice(records, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return run


def write_archives(s: Scratch, pages: DataFrame, roll: int = 256 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) and return the manifest (path, bytes, records).

    Of the pages with equal payloads of at least 100 bytes, that with the
    smallest page_id is written as a response, the others as revisits of it;
    repeated rows of that smallest page_id are all responses.  A null html is
    an empty payload.  A page without page_id is always a response.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    can = (F.octet_length("html") >= SMALL) & F.col("page_id").isNotNull()
    same = p.where(can).select("page_id", "digest")
    first = same.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    first = s.table(first, "first")
    refers = F.when(can & (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to")
    if first.count() * 200 <= BROADCAST:  # a row of the hashed table takes less than 200 bytes
        rows = p.join(F.broadcast(first), "digest", "left").select("page_id", "url", "html", refers, "digest")
    else:  # by page as well, so that a payload of very many pages is no hot key
        revisit = same.join(first, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
        rows = p.join(revisit, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to", "digest")
    return s.table(rows.mapInArrow(_writer(s.path("archives"), roll), MANIFEST), "manifest")


def read_archives(manifest: DataFrame, root: str, split: int = 16 << 20) -> DataFrame:
    """The records of the archives in a manifest, by ranges of ``split`` bytes, a task for each up to ``TASKS``."""
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", start.alias("start"))
    ranges = ranges.select("path", "start", F.least(F.col("start") + split, F.col("bytes")).alias("end"))
    return ranges.repartition(max(1, min(TASKS, ranges.count()))).mapInArrow(_reader(root), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, split: int = 16 << 20, roll: int = 256 << 20) -> DataFrame:
    """Write ``pages`` as archives and read them back; a row for each record."""
    s = Scratch(spark, "warc")
    manifest = write_archives(s, pages, roll)
    out = s.table(read_archives(manifest, s.path("archives"), split), "out")
    s.drop("archives")
    s.close("out")
    return out
