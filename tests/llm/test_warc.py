import base64
import gzip
import hashlib
import os
import random

import pytest

from credlens.llm import warc as W

PAGES = [(1, "http://a.example/x y\n", b"<html>\r\n\r\nWARC/1.1\r\n</html>"), (2, None, b""), (3, "", None), (4, "http://b/", b"same"),
         (5, "http://c/", b"same"), (5, "http://c/", b"same"), (None, "http://d/", b"same"), (None, "http://d/", b"only\n\n\n"),
         (9, "http://e/", bytes(range(256)) * 3000), (10, "http://é/", "é ".encode())]


def digest(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def convert(spark, pages, base, **options):
    df = spark.createDataFrame([(a, b, None if c is None else bytearray(c), "x", 1) for a, b, c in pages],
                               "key long, url string, payload binary, record_type string, date int")
    W.write_arc(df, f"{base}/arc")
    W.convert(spark, f"{base}/arc", f"{base}/warc", **options)
    return W.read_warc(spark, f"{base}/warc")


def test_round_trip(spark, tmp_dir):
    rows = convert(spark, PAGES, tmp_dir).collect()
    assert sorted((r.key, r.payload_bytes, r.payload_digest) for r in rows if r.key) == \
        sorted((k, len(p or b""), digest(p or b"")) for k, _, p in PAGES if k)
    same = [r for r in rows if r.payload_digest == digest(b"same")]
    assert len(same) == 4 and sum(r.record_type == "response" for r in same) == 1
    first = next(r for r in same if r.record_type == "response")
    assert first.key == 4 and {r.refers_to for r in same if r is not first} == {4}
    assert {r.refers_to_id for r in same if r is not first} == {first.record_id}
    assert [(r.key, r.record_type, r.refers_to) for r in rows if r.key in (2, 3)] in (
        [(2, "response", None), (3, "revisit", 2)], [(3, "revisit", 2), (2, "response", None)])
    payloads = {r.payload_digest: bytes(r.payload) for r in rows if r.record_type == "response"}
    assert all(digest(p) == k for k, p in payloads.items())
    assert all(r.date.endswith("Z") and r.record_id.startswith("<urn:uuid:") for r in rows)


def test_short_payloads_and_empty_table(spark, tmp_dir):
    rows = convert(spark, PAGES, tmp_dir, min_bytes=1).collect()
    assert {r.record_type for r in rows if r.payload_bytes == 0} == {"response"}
    assert convert(spark, [], tmp_dir + "/none").collect() == []


def test_foreign_archives(spark, tmp_dir):
    """Both header versions, records compressed one by one, other record types."""
    v1 = [b"filedesc://x.arc 0.0.0.0 19970101 text/plain 76\n1 0 Org\nURL IP-address Archive-date Content-type Archive-length\n",
          b"\nhttp://h/ 1.2.3.4 199701020304 text/html 46\nHTTP/1.0 200 OK\nX\r\n\r\n", b"\ndns:h 1.2.3.4 19970102030405 text/dns 4\n1234\n"]
    body = b"HTTP/1.0 200 OK\r\nX-Archive-Key: 7\r\n\r\nhello"
    v1[0] = v1[0].replace(b" 76\n", b" %d\n" % len(v1[0].split(b"\n", 1)[1]))
    v1[1] = b"\nhttp://h/ 1.2.3.4 199701020304 text/html %d\n" % len(body) + body
    block = b"2 0 Org\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    v2 = [b"filedesc://y.arc 0.0.0.0 19970101000000 text/plain 200 - - 0 y.arc %d\n" % len(block) + block,
          b"\nhttp://i/ 1.2.3.4 19970102030405 text/html 200 abc - 0 y.arc %d\n" % len(body) + body + b"\n"]
    os.makedirs(f"{tmp_dir}/arc")
    for name, records in (("x", v1), ("y", v2)):
        with open(f"{tmp_dir}/arc/{name}.arc.gz", "wb") as f:
            f.write(b"".join(gzip.compress(r) for r in records))
    got = {r.uri: r for r in W.read_arc(spark, f"{tmp_dir}/arc").collect()}
    assert set(got) == {"http://h/", "http://i/", "dns:h"}
    assert got["http://h/"].date == "1997-01-02T03:04:00Z" and bytes(got["http://h/"].payload) == b"hello"
    assert bytes(got["dns:h"].payload) == b"1234" and got["http://i/"].payload_digest == digest(b"hello")
    W.convert(spark, f"{tmp_dir}/arc", f"{tmp_dir}/warc")
    kinds = sorted(r.record_type for r in W.read_warc(spark, f"{tmp_dir}/warc").collect())
    assert kinds == ["resource", "response", "revisit"]


def test_archives_are_compressed_at_the_light_level(spark, tmp_dir):
    """Not the default level, which costs three times the time: a little larger, the same lines."""
    rnd = random.Random(5)
    words = ["".join(rnd.choices("abcdefghij", k=rnd.randint(2, 9))) for _ in range(300)]
    pages = [(i, f"http://a/{i}", " ".join(rnd.choices(words, k=500)).encode()) for i in range(150)]
    df = spark.createDataFrame([(k, u, bytearray(p)) for k, u, p in pages], "key long, url string, payload binary")
    W.write_arc(df.coalesce(1), f"{tmp_dir}/light")
    lines = spark.read.option("lineSep", "\n").text(f"{tmp_dir}/light")
    lines.coalesce(1).write.option("lineSep", "\n").option("compression", "gzip").text(f"{tmp_dir}/default")
    packed = {}
    for name in ("light", "default"):
        [file] = [f for f in os.listdir(f"{tmp_dir}/{name}") if f.endswith(".gz")]
        with open(f"{tmp_dir}/{name}/{file}", "rb") as f:
            packed[name] = f.read()
    assert gzip.decompress(packed["light"]) == gzip.decompress(packed["default"])
    assert len(packed["default"]) < len(packed["light"]) < 1.15 * len(packed["default"])
    got = W.read_arc(spark, f"{tmp_dir}/light").collect()
    assert sorted((r.key, bytes(r.payload)) for r in got) == [(k, p) for k, _, p in pages]


@pytest.mark.parametrize("bad", [b"x 1 2 3 4\n", b"filedesc://a 0 1 t 5\n3 0 O\n"])
def test_broken_archives_raise(bad):
    with pytest.raises(ValueError):
        list(W.arc_records(bad.split(b"\n")))
