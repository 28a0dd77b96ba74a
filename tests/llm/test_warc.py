"""Round trips of archives."""

import base64
import gzip
import hashlib

import pytest

from studyloom.llm import warc
from studyloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def b32(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark):
    pages = [(1, "http://a/x", "<p>é</p>"), (2, "http://a/y\r\nEvil: 1", "<p>é</p>"), (3, None, None), (4, "u", ""), (5, "u", "\r\n\r\n"), (5, "u", "\r\n\r\n"), (None, "n", "<p>é</p>"), (7, "b", "z" * 300_000),
             (-9, "neg", "only"), (None, None, "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as payload", "2 as first")
    archives = warc.write_archives(df.repartition(3), archive_bytes=200)
    records = warc.read_archives(archives)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.digest_ok) for r in records.collect()), key=str)
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in pages:
        f = first.get(h or "")
        kind = ("revisit", f) if f is not None and i != f else ("response", None)
        want.append((i, len((h or "").encode()), b32(h), *kind, True))
    assert got == sorted(want, key=str)
    assert warc.revisit_faults(records).count() == 0
    urls = {r.page_id: r.url for r in records.collect()}
    assert urls[2] == "http://a/y%0D%0AEvil: 1" and urls[3] is None
    assert warc.read_archives(warc.write_archives(df.where("false"))).collect() == []


def test_heavy_payload(spark):
    df = spark.range(5000).selectExpr("id as page_id", "'u' || id as url", "if(id % 3 = 0, 'same', 'p' || (id div 2)) as html")
    got = warc.read_archives(warc.write_archives(df)).collect()
    rows = {r.page_id: r for r in got}
    assert len(got) == 5000 and all(r.refers_to == 0 for i, r in rows.items() if i and i % 3 == 0)
    assert rows[4].record_type == "response" and rows[5].refers_to == 4


def test_members_and_damage():
    data = gzip.compress(b"one") + gzip.compress(b"two" * 100_000)
    assert [len(m) for m in warc.members(data, 7)] == [3, 300_000]
    with pytest.raises(ValueError):
        list(warc.members(data[:-3]))
    record = gzip.decompress(warc._record(1, "u", b"body", 1, "d"))
    assert warc.parse_record(record)["digest_ok"] and not warc.parse_record(record.replace(b"body", b"b0dy"))["digest_ok"]
    with pytest.raises(ValueError):
        warc.parse_record(record[:-5])


def test_files(spark, tmp_path):
    (tmp_path / "x.warc.gz").write_bytes(warc._record(1, "u", b"a", 1, "d") + warc._record(2, "u", b"a", 1, "d"))
    got = sorted(warc.read_files(spark, f"{tmp_path}/*.warc.gz").select("page_id", "record_type").collect())
    assert [tuple(r) for r in got] == [(1, "response"), (2, "revisit")]


def foreign(kind, block, *head):
    lines = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: <urn:uuid:0>", *head, b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_foreign_records():
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    info = warc.parse_record(foreign(b"warcinfo", b"software: x\r\n", b"Content-Type: application/warc-fields"))
    assert (info["record_type"], info["digest_ok"], info["payload"], info["payload_digest"], info["page_id"]) == ("warcinfo", None, b"software: x\r\n", sha(b"software: x\r\n"), None)
    http = [b"Content-Type: application/http; msgtype=response", b"WARC-Target-URI: http://a/", b"X-Long: one", b"  two"]
    bare = warc.parse_record(foreign(b"response", b"HTTP/1.1 200 OK\r\nServer: s\r\n\r\nbody", *http))
    assert (bare["payload"], bare["payload_bytes"], bare["digest_ok"], bare["payload_digest"], bare["url"]) == (b"body", 4, None, sha(b"body"), "http://a/")
    for stated, ok in ((f"sha1:{sha(b'body')}", True), (f"sha1:{hashlib.sha1(b'body').hexdigest()}", True), (f"sha256:{hashlib.sha256(b'body').hexdigest()}", True), (f"sha1:{sha(b'other')}", False), ("blake3:00", None)):
        got = warc.parse_record(foreign(b"response", b"HTTP/1.1 200 OK\r\n\r\nbody", *http, f"WARC-Payload-Digest: {stated}".encode()))
        assert got["digest_ok"] is ok, stated
        assert got["payload_digest"] == (sha(b"other") if ok is False else sha(b"body"))
    short = warc.parse_record(foreign(b"response", b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody", *http))
    chunked = warc.parse_record(foreign(b"response", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nbody\r\n0\r\n\r\n", *http))
    assert short["digest_ok"] is False and chunked["digest_ok"] is None
    again = warc.parse_record(foreign(b"revisit", b"", b"WARC-Refers-To: <urn:uuid:1>", b"WARC-Payload-Digest: sha1:ABC"))
    assert (again["payload"], again["payload_bytes"], again["payload_digest"], again["refers_to"]) == (None, None, "ABC", None)
    asked = warc.parse_record(foreign(b"request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", b"Content-Type: application/http; msgtype=request"))
    assert asked["payload"] == b"" and asked["record_type"] == "request"
    with pytest.raises(ValueError):
        warc.parse_record(b"WARC/1.0\r\nWARC-Type: metadata\r\n\r\n\r\n\r\n")


def test_damaged_archives(spark):
    good, broken = warc._record(1, "u", b"a", 1, "d"), gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n")
    info = gzip.compress(foreign(b"warcinfo", b"x: y"))
    bad = bytearray(good)
    bad[20:24] = b"\xff\xff\xff\xff"
    rows = [(bytearray(info + good + broken + good),), (bytearray(good + good[:-4]),), (bad + good,), (None,), (bytearray(),)]
    df = spark.createDataFrame(rows, "content binary")
    got = warc.read_archives(df, strict=False).groupBy("record_type").count().collect()
    assert dict(map(tuple, got)) == {"warcinfo": 1, "response": 3, "damaged": 3}
    with pytest.raises(Exception, match="Content-Length|inside|decompress"):
        warc.read_archives(df).collect()


def test_query(spark, duck):
    got = {r.page_id: r for r in QUERIES["op9_warc"](spark, SF).collect()}
    pages = duck.execute("select page_id, html from pages").fetchall()
    assert len(got) == len(pages) and all(got[i].payload_digest == b32(h) and got[i].digest_ok for i, h in pages)
