"""WARC archives, written and read with boundary-chain verification.

Writing: payloads of REVISIT_BYTES or more whose SHA-1 is equal are stored once, in the response of the largest id; the
others become revisit records that refer to it. Smaller payloads are always stored. A record is an HTTP response message
(a revisit has its head only) with type, id, date, address, digest and length, in a gzip member of its own, so that it can
be read by its offset. Tasks put members together to archives of about ARCHIVE_BYTES before compression, a warcinfo record
first, and Spark's text writer writes each as a file, so any file system that Spark writes to will do; what that writer puts
behind a row is an empty gzip member. Payloads stay in the task that reads them: only ids and digests are shuffled.

Reading: tasks look for the magic anywhere in an archive and note each candidate's offset and the offset of the record
that would follow it. Magic inside a payload makes candidates too. From the start of the file, pointer jumping (each
round doubles the reach) finds the candidates on the chain of records; only these are returned, and only their payloads are
hashed, so nothing inside a payload is mistaken for a record and fake records cost no more than their heads, which are
searched for HEAD_BYTES. The chain must end where the file does, else reading fails and names the file. An archive is in
the memory of one task, decompressed; files above 2 GB are beyond Spark's reader and fail.

Null payloads are empty. Rows that repeat the id and payload of a response are responses too; a null id is written as
such and is a response only where no record with the same payload has an id. Null addresses are empty. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, small, written

REVISIT_BYTES, ARCHIVE_BYTES, HEAD_BYTES = 1000, 16 << 20, 1 << 16
# Fixed values of the format.
MAGIC, LINE, BLANK = b"WARC/1.0\r\n", b"\r\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, url, payload, digest, refers): refers is the id of the response that holds an equal payload, null for responses."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload.cast("binary")).alias("digest"))
    keys = written(rows.where(F.octet_length("payload") >= REVISIT_BYTES).select("id", "digest"), "digests")
    holders = written(keys.groupBy("digest").agg(F.max("id").alias("holder"), F.count("*").alias("n")).where("n > 1 AND holder IS NOT NULL").drop("n"), "holders")
    revisits = keys.join(small(holders), "digest").where(~F.col("id").eqNullSafe(F.col("holder"))).distinct()
    revisits = written(revisits.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), F.col("holder").alias("refers")), "revisits")
    on = F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))
    return rows.join(small(revisits), on, "left").drop("_id", "_digest")


def member(head: list[tuple[str, str]], block: bytes = b"") -> bytes:
    """One record as a gzip member."""
    lines = "".join(f"{name}: {value}\r\n" for name, value in head) + f"Content-Length: {len(block)}\r\n\r\n"
    own = zlib.compressobj(level=6, wbits=31)
    return own.compress(MAGIC + lines.encode() + block + BLANK) + own.flush()


def labelled(digest: str) -> str:
    """A hexadecimal SHA-1 as archives state it."""
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def hexadecimal(digest: bytes) -> str:
    kind, _, value = digest.partition(b":")
    return base64.b32decode(value).hex() if kind == b"sha1" and len(value) == 32 else value.decode(errors="replace")


def archives(batches: Iterator[pa.RecordBatch], date: str, archive_bytes: int) -> Iterator[pa.RecordBatch]:
    """Batches of (id, url, payload, digest, refers) as rows of one archive each."""
    first = member([("WARC-Type", "warcinfo"), ("WARC-Date", date), ("WARC-Record-ID", "<urn:archive:info>"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")
    held, size = [], 0
    urn = lambda x: "<urn:page:none>" if x is None else f"<urn:page:{x}>"

    def done() -> pa.RecordBatch:
        return pa.record_batch([pa.array([first + b"".join(held)], pa.binary())], names=["archive"])

    for batch in batches:
        columns = [batch.column(i) for i in range(5)]
        for own, url, payload, digest, refers in zip(*columns, strict=True):
            own, url, payload, digest, refers = own.as_py(), url.as_py() or "", payload.as_py().encode(), digest.as_py(), refers.as_py()
            url = url.replace("\r", "%0D").replace("\n", "%0A")
            again = refers is not None
            head = [("WARC-Type", "revisit" if again else "response"), ("WARC-Record-ID", urn(own)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", labelled(digest))]
            head += [("WARC-Refers-To", urn(refers)), ("WARC-Profile", PROFILE)] * again
            http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
            held.append(member([*head, ("Content-Type", "application/http; msgtype=response")], http + (b"" if again else payload)))
            size += len(http) + len(payload) * (not again)
            if size >= archive_bytes:
                yield done()
                held, size = [], 0
    if held:
        yield done()


def write(records: DataFrame, path: str, date: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Writes records (see plan_records) as archives of one gzip member a record under path, dated now or as told."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = records.select("id", "url", "payload", "digest", "refers").mapInArrow(lambda b: archives(b, date, archive_bytes), "archive binary")
    nothing = zlib.compressobj(wbits=31).flush().decode("latin-1")
    writer = rows.select(F.col("archive").cast("string").alias("value")).write.option("lineSep", nothing).option("encoding", "ISO-8859-1")
    writer.option("compression", "none").option("maxRecordsPerFile", 1).text(path)


FIELD = re.compile(rb"([A-Za-z-]+): ([^\r\n]*)\r\n")
LENGTH = re.compile(rb"(?i)\r\nContent-Length: *([0-9]+) *\r\n")
RECORD = "file string, size bigint, offset bigint, next bigint, page string, type string, refers string, bytes bigint, digest string"
NAMES = [x.split()[0] for x in RECORD.split(", ")]


def candidates(data: bytes) -> tuple[np.ndarray, list[tuple[int, dict[bytes, bytes]]]]:
    """Rows (offset, offset after it) wherever a record might begin, and for each where its block begins and its fields."""
    at, found, heads = data.find(MAGIC), [], []
    while at >= 0:
        end = data.find(BLANK, at, at + HEAD_BYTES)
        fields = dict(FIELD.findall(data, at + len(MAGIC), end + 2)) if end >= 0 else {}
        length = fields.get(b"Content-Length", b"")
        if length.isdigit() and end + 8 + int(length) <= len(data):
            found.append((at, end + 8 + int(length)))
            heads.append((end + 4, fields))
        at = data.find(MAGIC, at + 1)
    return np.array(found, np.int64).reshape(-1, 2), heads


def reachable(offset: np.ndarray, after: np.ndarray, size: int) -> tuple[np.ndarray, bool]:
    """Which candidates lie on the chain from offset 0, by pointer jumping, and whether it ends at size."""
    order = np.argsort(offset)
    offset, after = offset[order], after[order]
    n = len(offset)
    at = np.searchsorted(offset, after)
    jump = np.where((at < n) & (offset[np.minimum(at, n - 1)] == after), at, n)  # n: the chain ends here
    on = np.append(offset == 0, False)
    jump = np.append(jump, n)
    while True:
        more = on.copy()
        more[jump[on]] = True
        more[n] = False
        if (more == on).all():
            break
        on, jump = more, jump[jump]
    ends = after[on[:n]].max(initial=0) == size
    out = np.zeros(n, bool)
    out[order] = on[:n]
    return out, bool(ends)


def described(data: memoryview, fields: dict[bytes, bytes]) -> tuple:
    """(id, type, id referred to, bytes and SHA-1 of the payload) of a record with this block."""
    of = lambda name: fields.get(name, b"").decode(errors="replace").removeprefix("<urn:page:").removesuffix(">")
    kind, body = of(b"WARC-Type"), data
    if fields.get(b"Content-Type", b"").startswith(b"application/http"):
        head = bytes(data[:HEAD_BYTES])
        end = head.find(BLANK)
        body = data[end + 4 :] if end >= 0 else data
        said = LENGTH.search(head, 0, end + 4) if end >= 0 else None
    else:
        said = None
    if kind == "revisit":
        found = (int(said[1]) if said else 0, hexadecimal(fields.get(b"WARC-Payload-Digest", b"")))
    else:
        found = (len(body), hashlib.sha1(body).hexdigest())
    return of(b"WARC-Record-ID"), kind, of(b"WARC-Refers-To") or None, *found


def plain(data: bytes) -> bytes:
    """A file's bytes, decompressed if it is gzipped, in one member or many."""
    if data[:2] != b"\x1f\x8b":
        return data
    out: list[bytes] = []
    at, view, step = 0, memoryview(data), 1 << 16
    while at < len(data):
        own = zlib.decompressobj(wbits=31)
        while not own.eof:
            if at >= len(data):
                raise ValueError("a gzip member breaks off")
            out.append(own.decompress(view[at : at + step]))
            at += min(step, len(data) - at) - len(own.unused_data)  # what follows the member is the next one's
    return b"".join(out)


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = plain(content.as_buffer().to_pybytes())
            found, heads = candidates(data)
            on, whole = reachable(found[:, 0], found[:, 1], len(data))
            if not whole:
                raise ValueError(f"the chain of records breaks off in {path}")
            view, rows = memoryview(data), []
            for k in np.flatnonzero(on).tolist():
                (at, after), (start, fields) = found[k].tolist(), heads[k]
                if fields.get(b"WARC-Type") != b"warcinfo":
                    rows.append((path, len(data), at, after, *described(view[start : after - 4], fields)))
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=NAMES)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives under path: file, size, offset, next, page, type, refers, bytes and digest of the payload. Offsets are of decompressed bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_records, RECORD)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    path = shared_path(spark, "warc")
    write(plan_records(pages), path)
    number = lambda c: F.col(c).try_cast("long")
    return read(spark, path).select(number("page").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), number("refers").alias("refers_to"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS digest FROM p),
h AS (SELECT page_id, n, digest, max(page_id) OVER (PARTITION BY digest, n) AS holder FROM d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> holder THEN holder END AS refers_to
FROM h
"""
