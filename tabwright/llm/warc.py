"""WARC archives: one gzip member per record, written and read sequentially.

Writing: of records with equal payloads of at least ``min_bytes``, the one with the largest page_id is stored as
a response, the others as revisit records that name it and keep only their HTTP head.  Each task streams its
rows into archives of about ``roll_bytes`` in a folder that all executors share; a file appears under its final
name only when complete, so a lost or repeated task leaves no half archive in the manifest.

Reading: a task reads its archive front to back in blocks: incremental zlib decompression finds the member ends,
content-length framing finds the record's end, and the payload's SHA-1 is checked against the header while the
bytes pass.  Memory: one block and one record head, however large the record.  A cut member, a length that
doesn't fit or a wrong digest raises.

Null html: empty payload.  Null url: a record without a target URI.  Null page_id: written and read back as null;
it may refer to another record but is never referred to.  Repeated rows are written one by one.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(uri: str):
    """(file system, path) of a folder or file that all machines see."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _sha1(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record(kind: str, name: str, url: str | None, payload: bytes, digest: bytes, refers_to: str | None = None,
           date: str = "2024-01-01T00:00:00Z") -> bytes:
    """One record as a gzip member of its own."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    body = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|{}^`\"<>"))
    head.append("WARC-Payload-Digest: " + _sha1(digest))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


@dataclass
class Record:
    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload_bytes: int = 0
    payload_sha1: str = ""


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def read_records(stream, on_payload: Callable[[Record, bytes], None] | None = None) -> Iterator[Record]:
    """The records of one archive in order; payload bytes go to ``on_payload`` block by block."""
    raw = stream.read(BLOCK)
    while raw:
        z, buf, rec, left, http, sha = zlib.decompressobj(31), b"", None, -1, True, hashlib.sha1()
        while True:
            if z.eof:
                break
            buf += z.decompress(raw, BLOCK)
            raw = z.unconsumed_tail or (z.unused_data if z.eof else b"")
            while True:                                        # take from buf what is complete
                if rec is None:
                    head, mark, rest = buf.partition(b"\r\n\r\n")
                    if not mark:
                        break
                    if not head.startswith(b"WARC/"):
                        raise ValueError("not a WARC record")
                    rec, buf = Record(_fields(head)), rest
                    left = int(rec.headers["content-length"])
                elif http and left > 0:
                    head, mark, rest = buf.partition(b"\r\n\r\n")
                    if not mark or len(head) + 4 > left:
                        if len(buf) >= left:
                            raise ValueError("the HTTP head does not end within the record")
                        break
                    rec.http, buf, http = _fields(head), rest, False
                    left -= len(head) + 4
                elif left > 0 and buf:
                    part, buf = buf[:left], buf[left:]
                    left -= len(part)
                    rec.payload_bytes += len(part)
                    sha.update(part)
                    if on_payload:
                        on_payload(rec, part)
                else:
                    break
            if not z.eof and not raw:
                raw = stream.read(BLOCK)
                if not raw:
                    raise EOFError("the archive ends inside a record")
        if rec is None or left or buf != b"\r\n\r\n":
            raise ValueError("a record's length does not fit its Content-Length")
        rec.payload_sha1 = sha.hexdigest()
        want = base64.b32decode(rec.headers["warc-payload-digest"].removeprefix("sha1:")).hex()
        if rec.headers["warc-type"] == "response" and want != rec.payload_sha1:
            raise ValueError(f"payload digest of {rec.headers['warc-record-id']} does not match")
        if rec.headers["warc-type"] == "revisit":              # the payload lies in the record referred to
            rec.payload_bytes, rec.payload_sha1 = int(rec.http["content-length"]), want
        yield rec
        raw = raw or stream.read(BLOCK)


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 1000, roll_bytes: int = 64 << 20) -> DataFrame:
    """Write all rows (page_id, url, html) to archives under ``folder``; (path, records, bytes) of each archive."""
    from tabwright.session import cut_lineage
    rows = pages.select(F.col("page_id").cast("long").alias("id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("body"))
    rows = rows.withColumn("sha", F.sha1("body"))
    keep = (rows.where(F.octet_length("body") >= min_bytes).groupBy("sha")
            .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first"))
    # only rows of repeated payloads have a partner; the join deals the others out evenly and splits a hot payload
    rows = rows.join(keep, "sha", "left").select("id", "url", "body", "sha", F.when(
        F.col("id").isNull() | (F.col("id") != F.col("first")), F.col("first")).alias("ref"))

    def write(batches):
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        out, name, done = None, "", []

        def close():
            nonlocal out
            size = out.tell()
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            done.append((f"{folder}/{name}", count, size))
            out = None

        count = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("id", "url", "body", "sha", "ref"))):
                if out is None:
                    name, count = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/.{name}")
                i, url, body, sha, ref = r
                out.write(record("response" if ref is None else "revisit", f"urn:page:{i}", url, body, bytes.fromhex(sha),
                                 None if ref is None else f"urn:page:{ref}"))
                count += 1
                if out.tell() >= roll_bytes:
                    close()
        if out is not None:
            close()
        p, n, s = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.string()), pa.array(n, pa.int64()), pa.array(s, pa.int64())],
                                         ["path", "records", "bytes"])

    return cut_lineage(rows.mapInArrow(write, "path string, records long, bytes long"))


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of every record of the archives."""
    def read(batches):
        number = lambda x: None if x is None or x.endswith(":None>") else int(x.rsplit(":", 1)[1][:-1])
        for b in batches:
            for path in b.column("path").to_pylist():
                fs, p = _open(path)
                got = []
                with fs.open_input_stream(p) as f:
                    for r in read_records(f):
                        h = r.headers
                        got.append((number(h["warc-record-id"]), r.payload_bytes, r.payload_sha1, h["warc-type"],
                                    number(h.get("warc-refers-to")), h.get("warc-target-uri")))
                        if len(got) == 5000:
                            yield batch(got)
                            got = []
                yield batch(got)

    def batch(rows):
        cols = list(zip(*rows)) or [()] * 6
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)],
                                          ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    files = manifest.select("path").repartition(max(1, min(manifest.count(), 10_000)))
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write every page to archives in the session's shared folder and read them all back."""
    from tabwright.session import checkpoint_dir
    folder = f"{checkpoint_dir(pages.sparkSession).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, folder, **options)).drop("url")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT d, max(page_id) AS top, count(*) AS c FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN c > 1 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN c > 1 AND page_id <> top THEN top END AS refers_to
FROM p LEFT JOIN g USING (d)
"""
