import base64
import gzip
import hashlib
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerlens.llm import warc

INNER = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def test_pointer_jumping():
    offset, after = np.array([0, 10, 40, 12, 70, 41]), np.array([10, 40, 70, 40, 100, 70])
    on, whole = warc.reachable(offset, after, 100)
    assert on.tolist() == [True, True, True, False, True, False] and whole
    assert not warc.reachable(offset, after, 101)[1]
    n = 1000
    chain = np.arange(n) * 3
    on, whole = warc.reachable(chain, chain + 3, 3 * n)
    assert on.all() and whole
    assert not warc.reachable(np.array([5]), np.array([9]), 9)[1]


def test_round_trip(spark, tmp_path):
    big = "é" * 600
    rows = [(1, "http://a", big), (2, None, big), (7, "u\r\nX: y", big), (7, "u\r\nX: y", big), (3, "s", "small"), (4, "s", "small"), (5, "n", None), (6, "e", ""), (None, "q", big), (None, "q", "z" * 1500), (8, "m", INNER * 30), (9, "m2", INNER), (10, "crlf", "\r\n\r\n" + INNER + "\r\n\r\n"), (11, "long", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as id", "'x' as digest")
    path = f"file://{tmp_path}/w"
    warc.write(warc.plan_records(pages.coalesce(2)), path, "2024-05-06T07:08:09Z", archive_bytes=2_000)
    got = warc.read(spark, path).collect()
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        refers = "7" if html == big and i != 7 else None
        want.append((str(i) if i is not None else "none", "revisit" if refers else "response", refers or "", len(raw), hashlib.sha1(raw).hexdigest()))
    assert sorted((r.page, r.type, r.refers or "", r.bytes, r.digest) for r in got) == sorted(want)
    files = [f.read_bytes() for f in (tmp_path / "w").glob("*.txt")]
    assert len(files) > 2 and any(gzip.decompress(f).count(b"WARC/1.0\r\n") > 32 for f in files)
    records = [r for f in files for r in members(f)]
    assert len(records) == len(rows) + len(files)  # one member a record, a warcinfo record in each archive
    for record in records:
        head, block = record.split(b"\r\n\r\n", 1)
        lines = head.split(b"\r\n")
        fields = dict(line.split(b": ", 1) for line in lines[1:])
        assert lines[0] == b"WARC/1.0" and {b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length"} <= fields.keys()
        assert fields[b"WARC-Date"] == b"2024-05-06T07:08:09Z" and block.endswith(b"\r\n\r\n") and len(block) == int(fields[b"Content-Length"]) + 4
        if fields[b"WARC-Type"] == b"response":
            http, payload = block[:-4].split(b"\r\n\r\n", 1)
            assert http.startswith(b"HTTP/1.1 200") and base64.b32encode(hashlib.sha1(payload).digest()) == fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
        elif fields[b"WARC-Type"] == b"revisit":
            assert fields[b"WARC-Refers-To"] == b"<urn:page:7>"


def members(data):
    """The gzip members of a file that hold anything, each by itself."""
    out = []
    while data:
        one = zlib.decompressobj(wbits=31)
        out.append(one.decompress(data))
        data = one.unused_data
    return [x for x in out if x]


def test_fake_records_cost_their_heads_only():
    """A page of nothing but heads of records that claim the rest of the file: no body is hashed, and the chain holds."""
    fake = b"".join(b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % (40_000 * 63 - i * 63) for i in range(40_000))
    spam = b"WARC/1.0\r\n" * 20_000
    blocks = [fake, spam, b"x"]
    data = b"".join(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:%d>\r\nContent-Length: %d\r\n\r\n%b\r\n\r\n" % (i, len(b), b) for i, b in enumerate(blocks))
    began = time.process_time()
    batch = pa.record_batch([pa.array(["f"]), pa.array([data], pa.binary())], names=["path", "content"])
    got = [r for b in warc._records(iter([batch])) for r in b.to_pylist()]
    assert [(r["page"], r["digest"]) for r in got] == [(str(i), hashlib.sha1(b).hexdigest()) for i, b in enumerate(blocks)]
    assert time.process_time() - began < 20


def test_broken_file_fails(spark, tmp_path):
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    (tmp_path / "good.warc").write_bytes(record * 3)
    assert warc.read(spark, f"file://{tmp_path}/good.warc").count() == 3
    (tmp_path / "members.warc.gz").write_bytes(gzip.compress(record) * 3)
    assert warc.read(spark, f"file://{tmp_path}/members.warc.gz").count() == 3
    for name, data in (("cut.warc", record * 2 + record[:-3]), ("noise.warc", b"junk" + record)):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(Exception, match="breaks off"):
            warc.read(spark, f"file://{tmp_path}/{name}").collect()


def test_empty(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(warc.plan_records(pages), f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0
