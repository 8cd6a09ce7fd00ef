import base64
import gzip
import hashlib
import random
import time

import duckdb
import pandas as pd

from sonarmill.llm import warc
from sonarmill.session import fresh_path


def record(k, payload, kind="response"):
    http = b"HTTP/1.1 200 OK\r\n\r\n"
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{k}>\r\nWARC-Payload-Digest: sha1:{warc.digest_of(payload)}\r\nContent-Type: application/http\r\nContent-Length: {len(http + payload)}\r\n\r\n"
    return head.encode() + http + payload + b"\r\n\r\n"


def kinds(data):
    return [("gap", i.start, i.end) if isinstance(i, warc.Gap) else i.headers["warc-record-id"] for i in warc.salvage(data)]


def test_salvage_of_plain_archives():
    parts = [record(k, b"payload %d " % k * 20) for k in range(5)]
    parts[3] = record(3, b"holds WARC/1.0\r\nnot a record\r\n\r\n")
    whole = b"".join(parts)
    names = [f"<urn:page:{k}>" for k in range(5)]
    assert kinds(whole) == names
    hurt = bytearray(whole)
    hurt[len(parts[0]) + len(parts[1]) - 20] ^= 1  # payload of 1
    gap = ("gap", len(parts[0]), len(parts[0] + parts[1]))
    assert kinds(bytes(hurt)) == [names[0], gap, *names[2:]]
    long = whole.replace(b"Content-Length: ", b"Content-Length: 9", 1)
    assert kinds(long) == [("gap", 0, len(parts[0]) + 1), *names[1:]]
    assert kinds(b"junk" + whole[: -30]) == [("gap", 0, 4), *names[:4], ("gap", 4 + len(whole) - len(parts[4]), 4 + len(whole) - 30)]
    assert kinds(b"") == []


def test_salvage_of_gzip_members():
    members = [gzip.compress(record(k, b"x%d" % k * 300)) for k in range(4)]
    names = [f"<urn:page:{k}>" for k in range(4)]
    assert kinds(b"".join(members)) == names
    broken = bytearray(members[1])
    broken[len(broken) // 2] ^= 0xFF
    got = kinds(members[0] + bytes(broken) + members[2] + members[3])
    assert got[0] == names[0] and got[-2:] == names[2:]
    assert ("gap", len(members[0]), len(members[0]) + len(broken)) in got


def test_round_trip_with_revisits_and_odd_rows(spark):
    rows = [(1, "http://a/\r\nX: y", "same", "z"), (2, None, "same", "z"), (3, "u", None, "z"), (4, "u", "", "z"), (5, "u", "é\r\n\r\nWARC/1.1\r\nfake", "z"), (None, "u", "same", "z"), (9, "u", "alone " * 30_000, "z"), (9, "u", "alone " * 30_000, "z"), (None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha1 string")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, records_per_archive=2)
    back = warc.read_archives(spark, path).collect()
    assert all(r["kind"] == "record" for r in back)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back), key=str)

    def want(i, html):
        body = (html or "").encode()
        newest = {"same": 2, "": 4, None: 4}.get(html, i)
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        return (i, len(body), digest, "response" if i == newest else "revisit", None if i == newest else newest)

    assert got == sorted((want(i, h) for i, _, h, _ in rows), key=str)
    assert {bytes(r["payload"]) for r in back if r["record_type"] == "response"} == {(h or "").encode() for _, _, h, _ in rows}
    empty = fresh_path(spark, "warc-test")
    warc.write_archives(pages.limit(0), empty)
    assert warc.read_archives(spark, empty).count() == 0


def test_salvage_searches_all_members_and_keeps_what_precedes_damage():
    members = [gzip.compress(record(k, b"x%d" % k * 300)) for k in range(5)]
    names = [f"<urn:page:{k}>" for k in range(5)]
    hurt = [bytearray(m) for m in members]
    hurt[0][0] ^= 1
    hurt[1][3 * len(members[1]) // 4] ^= 0xFF
    got = kinds(b"".join(map(bytes, hurt)))
    assert got[-3:] == names[2:] and got[0][0] == "gap"
    rng = random.Random(1)
    many = b"".join(record(k, bytes(rng.randrange(256) for _ in range(300))) for k in range(40))
    packed = bytearray(gzip.compress(many))
    packed[len(packed) * 9 // 10] ^= 0xFF
    whole = [k for k in kinds(bytes(packed)) if isinstance(k, str)]
    assert len(whole) >= 33 and whole == [f"<urn:page:{k}>" for k in range(len(whole))]


def test_reading_many_members_is_linear():
    def seconds(n):
        data = b"".join([gzip.compress(record(1, b"abc")) + warc.EMPTY] * n)
        start = time.perf_counter()
        assert sum(1 for _ in warc.salvage(data)) == n
        return time.perf_counter() - start

    seconds(100)
    assert seconds(20_000) < 20 * max(seconds(2_000), 0.02)


def test_archives_are_gzip_with_a_member_a_record(spark):
    path = fresh_path(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(k, "u", f"page {k} é") for k in range(7)], "page_id long, url string, html string").coalesce(1), path)
    files = spark.read.format("binaryFile").load(path).collect()
    data = bytes(files[0]["content"])
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 7
    hurt = bytearray(data)
    hurt[len(data) // 2] ^= 0xFF
    assert sum(isinstance(i, warc.Record) for i in warc.salvage(bytes(hurt))) == 6


def test_minimum_size_of_revisits(spark):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages, path, min_revisit_bytes=3)
    got = {r["page_id"]: r["record_type"] for r in warc.read_archives(spark, path).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    want = con.execute(warc.OP5_SQL).df().sort_values("page_id").reset_index(drop=True)
    got = warc.op5_warc(spark, small).toPandas().sort_values("page_id").reset_index(drop=True)[want.columns]
    pd.testing.assert_frame_equal(got.astype(object).where(got.notna(), None), want.astype(object).where(want.notna(), None), check_dtype=False)
