import collections
import gzip
import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from cohortia.llm import queries, warc
from tests.llm import helpers as H
from tests.oracle import compare, connect

SCHEMA = "page_id long, url string, html string"


def brute(rows):
    pay = [(i, (h or "").encode()) for i, _, h in rows]
    top = {}
    for i, b in pay:
        if i is not None:
            top[b] = max(top.get(b, i), i)
    many = collections.Counter(b for _, b in pay)
    out = collections.Counter()
    for i, b in pay:
        again = len(b) >= 1000 and many[b] > 1 and b in top and i != top[b]
        out[i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None] += 1
    return out


def pages():
    rng = random.Random(4)
    big, edge = H.prose(rng, 900), "x" * 999
    return [(1, "http://a/ b\r\nX: y", big), (9, "http://a/é", big), (4, None, big), (None, "http://n", big), (9, "http://a/é", big), (2, "", None), (3, "u", ""), (5, "u", edge), (6, "u", edge),
            (7, "u", edge + "y"), (8, "u", edge + "y"), (10, "u", "é\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 80), (11, "u", H.prose(rng, 60_000)),
            (None, None, "q" * 1500), (None, None, "q" * 1500), (-3, "u", "m" * 2000), (-4, "u", "m" * 2000)]


def result(spark, df, folder, **options):
    warc.write(warc.page_records(df), folder, **options)
    got = warc.read(spark, folder).filter(F.col("record_type").isin("response", "revisit"))
    return got.select(warc.page_of(F.col("record_id")).alias("p"), "payload_bytes", F.coalesce("payload_sha1", "payload_digest"), "record_type", warc.page_of(F.col("refers_to")).alias("r"))


def test_query_equals_sql(spark, sf_dir):
    key = "op11_warc_source"
    ok, message = compare(spark, connect(sf_dir), key, queries.QUERIES[key], queries.ORACLES[key], sf_dir)
    assert ok, message


def test_awkward_pages_come_back(spark, tmp_path):
    df = H.clashing(spark.createDataFrame(pages(), SCHEMA).repartition(3))
    for n, options in enumerate(({}, {"file_bytes": "2000", "partition_bytes": "3000"})):
        got = result(spark, df, str(tmp_path / f"w{n}"), **{k: v for k, v in options.items() if k == "file_bytes"})
        assert collections.Counter(tuple(r) for r in got.collect()) == brute(pages())
    assert warc.read(spark, str(tmp_path / "w1"), partition_bytes="3000").rdd.getNumPartitions() > 3
    texts = {r.record_id: r.payload.decode() for r in warc.read(spark, str(tmp_path / "w0"), ["record_id", "payload", "record_type"]).filter("record_type = 'response'").collect()}
    assert texts["<urn:page:11>"] == pages()[12][2] and texts["<urn:page:2>"] == ""


def test_empty_table(spark, tmp_path):
    got = result(spark, spark.createDataFrame([], SCHEMA), str(tmp_path / "w"))
    assert got.collect() == []


def test_fields_of_a_record(spark, tmp_path):
    warc.write(warc.page_records(spark.createDataFrame(pages()[:2], SCHEMA)), str(tmp_path / "w"))
    rows = {r.record_id: r for r in warc.read(spark, str(tmp_path / "w")).collect()}
    one, nine = rows["<urn:page:1>"], rows["<urn:page:9>"]
    assert one.record_type == "revisit" and one.refers_to == "<urn:page:9>" and one.payload is None and one.http_status == 200
    assert one.target_uri == "http://a/%20b%0D%0AX:%20y" and nine.target_uri == "http://a/%C3%A9" and nine.date == warc.DATE
    assert nine.fields["content-type"] == warc.HTTP_RESPONSE and one.payload_digest == nine.payload_sha1


def test_predicates_are_pushed_down_and_payloads_skipped(spark, tmp_path):
    """Archives whose unwanted payloads are damaged are read without a complaint by those who ask for something else."""
    folder = tmp_path / "w"
    rows = [(i, f"http://h{i % 2}/", H.prose(random.Random(i), 3000)) for i in range(20)]
    warc.write(warc.page_records(spark.createDataFrame(rows, SCHEMA).coalesce(1)), str(folder))
    path = next(folder.glob("*.warc.gz"))
    raw, at, hit = bytearray(path.read_bytes()), 0, 0
    while at < len(raw):
        packed = struct.unpack("<I", raw[at + 16:at + 20])[0]
        if warc.zlib.decompress(bytes(raw[at:at + packed]), 31).find(b"http://h1/") > 0:
            raw[at + packed - 60:at + packed - 40] = b"\xff" * 20
            hit += 1
        at += packed
    assert hit == 10
    path.write_bytes(raw)
    some = warc.read(spark, str(folder), ["record_id", "target_uri", "payload_sha1"])
    wanted = some.filter("target_uri = 'http://h0/'")
    assert wanted.count() == 10
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing is left for Spark to filter
    assert some.filter("target_uri like 'http://h0%' and record_id in ('<urn:page:2>', '<urn:page:4>', '<urn:page:3>')").count() == 2
    heads = warc.read(spark, str(folder), ["record_type", "target_uri", "http_status"])
    assert heads.filter("record_type = 'response' and http_status = 200").count() == 20
    with pytest.raises(Exception, match="at byte"):
        some.filter("target_uri = 'http://h1/'").collect()


def foreign(spark, path, data):
    path.write_bytes(data)
    return warc.read(spark, str(path))


def test_foreign_archives(spark, tmp_path):
    """Plain, packed as a whole, packed record by record without lengths; folded lines, other digests, chunked bodies."""
    body = b"HTTP/1.1 404 Not Found\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nabc\r\n4;x=y\r\ndefg\r\n0\r\n\r\n"
    first = b"WARC/1.0\r\nWARC-Type: response\r\nwarc-target-uri: http://x/\r\n  long\r\nWARC-Payload-Digest: md5:zz\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(body), body)
    second = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    third = b"WARC/1.0\nWARC-Type: metadata\nContent-Length: 0\n\n\r\n\r\n"
    parts = [first, second, third]
    for n, data in enumerate([b"".join(parts), gzip.compress(b"".join(parts)), b"".join(gzip.compress(p) for p in parts)]):
        df = foreign(spark, tmp_path / f"{n}.warc", data)
        got = df.orderBy("content_length").collect()
        assert [r.record_type for r in got] == ["metadata", "resource", "response"]
        assert got[1].payload == b"hello" and got[2].payload == b"abcdefg" and got[2].http_status == 404
        assert got[2].target_uri == "http://x/ long" and got[2].payload_digest == "md5:zz" and got[0].payload_bytes == 0
        assert df.filter("record_type = 'resource'").select("payload_sha1").first()[0] == hashlib.sha1(b"hello").hexdigest()
        assert df.filter("payload_digest is null and not record_type = 'metadata'").count() == 1 and df.filter("content_length > 3 and content_length < 9").count() == 1
    for bad in (first[:-30], first[:60], gzip.compress(first)[:-20], b"nonsense\r\n\r\n", first.replace(b"md5:zz", b"sha1:" + b"A" * 32)):
        with pytest.raises(Exception, match="at byte"):
            foreign(spark, tmp_path / "bad.warc", bad).collect()


def test_only_what_a_manifest_lists_is_read(spark, tmp_path):
    folder = tmp_path / "w"
    warc.write(warc.page_records(spark.createDataFrame(pages()[5:7], SCHEMA)), str(folder))
    n = warc.read(spark, str(folder)).count()
    (folder / "part-9-lost-attempt.warc.gz").write_bytes(b"half")
    assert warc.read(spark, str(folder)).count() == n
    warc.write(warc.page_records(spark.createDataFrame(pages()[7:8], SCHEMA)), str(folder))
    assert warc.read(spark, str(folder)).filter("record_type = 'response'").count() == 3
