"""Legacy ARC archives to WARC archives, and reading both.

Archives are read as lines: Spark's text reader decompresses a ``.gz`` file of
any size as a stream, and a small parser puts the byte stream together again
by the lengths that the record headers declare, one record at a time.  A file
is read by one task (gzip cannot be split), whose memory holds one record.
Archives are written by the text writer, whose line separator is just what
the format puts between records.

ARC, version 1 headers: ``URL IP date type length``; version 2 headers:
``URL IP date type status checksum location offset filename length``.  The
first record (``filedesc://``) names the version.  The converter gives every
record a WARC type, a ``urn:uuid`` identifier made from what identifies the
record, an ISO date, and SHA-1 digests of block and payload.  Of records with
equal payloads the one with the smallest key is a response and the others
revisit it.

Defined results: null payloads are empty; null URLs become
``urn:x-record:<key>``; characters an ARC header cannot hold are percent-
encoded; a null key comes after all others; repeated rows are records of
their own, of which one is the response; an empty table gives an archive
without records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_groups, scratch

V1_FIELDS = ("url", "ip", "date", "type", "length")
V2_FIELDS = ("url", "ip", "date", "type", "status", "checksum", "location", "offset", "filename", "length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The HTTP header that carries a row's key through the archives.
KEY_HEADER = b"X-Archive-Key"
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20
#: The deflate level of archives: compressing is most of the work, and on HTML
#: level 4 takes a third of the time of the default (6) for 4 % more bytes.
GZIP_LEVEL = "FOUR"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


class Lines:
    """A byte stream given as lines without their line feed."""

    def __init__(self, lines: Iterable[bytes]):
        self._lines, self._back = iter(lines), None

    def line(self) -> bytes | None:
        """The next line, or None at the end."""
        if self._back is not None:
            out, self._back = self._back, None
            return out
        return next(self._lines, None)

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes; what follows them in their last line stays."""
        parts, got = [], 0
        while got <= n:
            line = self.line()
            if line is None:
                break
            parts.append(line)
            got += len(line) + 1
        data = b"\n".join(parts)
        if len(data) < n:
            raise ValueError(f"archive ends in a record: {len(data)} of {n} bytes")
        if data[n:].strip(b"\r\n"):
            raise ValueError("declared length ends inside a line")
        return data[:n]


def arc_records(lines: Iterable[bytes]) -> Iterator[dict]:
    """Records of one ARC file, by the header version its first record names."""
    src, fields = Lines(lines), None
    while (line := src.line()) is not None:
        if not line.strip(b"\r"):
            continue
        parts = line.rstrip(b"\r").decode("utf-8").split(" ")
        if fields is None:
            if not parts[0].startswith("filedesc://"):
                raise ValueError("an ARC file begins with filedesc://")
            block = src.take(int(parts[-1]))
            version = block.split(b" ", 1)[0].decode()
            if version not in ("1", "2"):
                raise ValueError(f"ARC version {version!r}")
            fields = V1_FIELDS if version == "1" else V2_FIELDS
            yield {"url": parts[0], "ip": parts[1], "date": parts[2], "type": parts[3],
                   "version": int(version), "block": block}
            continue
        if len(parts) != len(fields):
            raise ValueError(f"{len(parts)} header fields, {len(fields)} expected")
        head = dict(zip(fields, parts, strict=True))
        yield {**head, "version": 1 if fields is V1_FIELDS else 2, "block": src.take(int(head["length"]))}


def warc_records(lines: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of one WARC file."""
    src = Lines(lines)
    while (line := src.line()) is not None:
        if not line.strip(b"\r"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := src.line()) is not None and line != b"\r":
            name, _, value = line.rstrip(b"\r").decode("utf-8").partition(":")
            head[name.strip().lower()] = value.strip()
        yield head, src.take(int(head["content-length"]))


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header with its empty line, payload."""
    end = block.find(b"\r\n\r\n")
    return (block[:end + 4], block[end + 4:]) if block.startswith(b"HTTP/") and end >= 0 else (b"", block)


def http_field(http: bytes, name: bytes) -> str | None:
    m = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", http)
    return m[1].decode() if m else None


def iso_date(date14: str) -> str:
    """14-digit ARC time (shorter ones are filled up) as a WARC date."""
    d = (date14 + "00000101000000"[len(date14):]) if len(date14) < 14 else date14[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_uuid(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def header_url(url: str | None, key: object) -> str:
    """A URL that fits into a header line."""
    if not url:
        return f"urn:x-record:{key}"
    return re.sub(r"[\x00-\x20\x7f\x85  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _batches(rows: Iterable[dict], schema: pa.Schema, size_of) -> Iterator[pa.RecordBatch]:
    """Arrow batches of bounded rows and bytes."""
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += size_of(r)
        if len(out) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(0, b.num_rows, BATCH_ROWS):
            yield from b.slice(k, BATCH_ROWS).to_pylist()


LINE = pa.schema([("value", pa.binary())])


def _write(records: DataFrame, path: str, sep: str) -> None:
    records.select(F.col("value").cast("string")).write.option("lineSep", sep) \
        .option("compression", "gzip").option("zlib.compress.level", GZIP_LEVEL).text(path)


def write_arc(pages: DataFrame, path: str) -> None:
    """Legacy archives with one HTTP record per row of ``pages`` (key, url,
    payload binary), one file per task, of version 1 and version 2 in turn."""
    def rows(batches):
        part = TaskContext.get().partitionId()
        v2 = part % 2 == 1
        fields = " ".join(("URL", "IP-address", "Archive-date", "Content-type") +
                          (("Result-code", "Checksum", "Location", "Offset", "Filename") if v2 else ()) +
                          ("Archive-length",))
        block = f"{2 if v2 else 1} 0 Archive\n{fields}\n"
        name = f"part-{part:05d}.arc"
        extra = f" 200 - - 0 {name}" if v2 else ""
        yield {"value": f"filedesc://{name} 0.0.0.0 20000101000000 text/plain{extra} {len(block)}\n{block}".encode()}
        offset = 0
        for r in _rows(batches):
            body = r["payload"] or b""
            key = "" if r["key"] is None else str(r["key"])
            http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + KEY_HEADER +
                    f": {key}\r\nContent-Length: {len(body)}\r\n\r\n".encode())
            extra = f" 200 {hashlib.md5(body).hexdigest()} - {offset} {name}" if v2 else ""
            minute = (r["key"] or 0) % (28 * 1440)
            date = f"200002{minute // 1440 + 1:02d}{minute // 60 % 24:02d}{minute % 60:02d}00"
            head = f"{header_url(r['url'], key)} 192.0.2.1 {date} text/html{extra} {len(http) + len(body)}\n"
            value = head.encode() + http + body
            offset += len(value) + 1
            yield {"value": value}

    def run(batches):
        yield from _batches(rows(batches), LINE, lambda r: len(r["value"]))

    source = pages.select(F.col("key").cast("long"), F.col("url").cast("string"), F.col("payload").cast("binary"))
    _write(source.mapInArrow(run, "value binary"), path, "\n")


def archive_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of the archives under ``path``, each file's in order."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[bytes]]]:
    """Runs of lines of one file; a task may hold several files, one after another."""
    import itertools

    def pairs():
        for b in batches:
            for k in range(0, b.num_rows, 4096):
                s = b.slice(k, 4096)
                yield from zip(s.column(0).to_pylist(), s.column(1).to_pylist(), strict=True)
    for file, run in itertools.groupby(pairs(), key=lambda x: x[0]):
        yield file, (v for _, v in run)


INDEX = pa.schema([("file", pa.int64()), ("ordinal", pa.int64()), ("key", pa.int64()), ("record_id", pa.string()),
                   ("uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()),
                   ("payload_bytes", pa.int64())])
RECORD = INDEX.append(pa.field("ip", pa.string())).append(pa.field("type", pa.string())) \
    .append(pa.field("http", pa.binary())).append(pa.field("payload", pa.binary()))
SQL = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {SQL[f.type]}" for f in schema)


def read_arc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of legacy archives (not their ``filedesc``), converted:
    identifier, ISO date, payload digest and length, HTTP header and payload.
    (file, ordinal) is a record's place.  Without payloads: the index of it."""
    schema = RECORD if with_payload else INDEX

    def rows(batches):
        for file, lines in _by_file(batches):
            for ordinal, r in enumerate(arc_records(lines)):
                if r["url"].startswith("filedesc://"):
                    continue
                http, payload = split_http(r["block"])
                digest, key = sha1_base32(payload), http_field(http, KEY_HEADER)
                date = iso_date(r["date"])
                yield {"file": file, "ordinal": ordinal, "key": int(key) if key else None, "uri": r["url"],
                       "date": date, "payload_digest": digest, "payload_bytes": len(payload),
                       "record_id": record_uuid(r["url"], date, digest, key, ordinal), "ip": r["ip"],
                       "type": r["type"], "http": http, "payload": payload if with_payload else None}

    def run(batches):
        yield from _batches(rows(batches), schema, lambda r: len(r["payload"] or b"") + 400)

    return archive_lines(spark, path).mapInArrow(run, _ddl(schema))


def assign_types(index: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Per record of ``index`` (a stored table): record_type, and for revisits
    the response they refer to."""
    place = F.struct(F.col("key").isNull().alias("no_key"), "key", "file", "ordinal", "record_id", "uri", "date")
    same = ["payload_digest", "payload_bytes"]
    long = index.filter(F.col("payload_bytes") >= min_bytes)
    groups = long.groupBy(*same).agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    base = scratch(index.sparkSession, "warc_groups")
    groups.write.parquet(base)
    found = join_groups(long.select("file", "ordinal", *same), index.sparkSession.read.parquet(base), same, "n")
    others = (F.col("file") != F.col("first.file")) | (F.col("ordinal") != F.col("first.ordinal"))
    return found.filter(others).select(
        "file", "ordinal", F.col("first.key").alias("refers_to"), F.col("first.record_id").alias("refers_to_id"),
        F.col("first.uri").alias("refers_to_uri"), F.col("first.date").alias("refers_to_date"))


def warc_record(r: dict) -> bytes:
    """One record, without the two line ends that follow it."""
    http, payload = r["http"] or b"", r["payload"] or b""
    revisit = r["refers_to_id"] is not None
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response" if http else "resource"
    head = [("WARC-Type", kind), ("WARC-Record-ID", r["record_id"]), ("WARC-Date", r["date"]),
            ("WARC-Target-URI", r["uri"]), ("WARC-IP-Address", r["ip"]),
            ("WARC-Block-Digest", "sha1:" + sha1_base32(block)),
            ("WARC-Payload-Digest", "sha1:" + r["payload_digest"])]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", r["refers_to_id"]),
                 ("WARC-Refers-To-Target-URI", r["refers_to_uri"]), ("WARC-Refers-To-Date", r["refers_to_date"]),
                 ("X-Payload-Length", r["payload_bytes"]),
                 ("X-Refers-To-Key", "" if r["refers_to"] is None else r["refers_to"])]
    head += [("Content-Type", "application/http; msgtype=response" if http else r["type"]),
             ("Content-Length", len(block))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in head), "\r\n"]).encode() + block


def write_warc(records: DataFrame, path: str) -> None:
    """Archives of the converted ``records`` (with the columns of ``assign_types``),
    one file per task, each begun by a warcinfo record."""
    def rows(batches):
        body = b"software: credlens\r\nformat: WARC File Format 1.1\r\n"
        head = (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {record_uuid('warcinfo', path, TaskContext.get().partitionId())}\r\n"
                f"WARC-Date: 2000-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\n"
                f"Content-Length: {len(body)}\r\n\r\n")
        yield {"value": head.encode() + body}
        for r in _rows(batches):
            yield {"value": warc_record(r)}

    def run(batches):
        yield from _batches(rows(batches), LINE, lambda r: len(r["value"]))

    _write(records.mapInArrow(run, "value binary"), path, "\r\n\r\n")


READ = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()),
                  ("date", pa.string()), ("key", pa.int64()), ("payload_digest", pa.string()),
                  ("payload_bytes", pa.int64()), ("refers_to", pa.int64()), ("refers_to_id", pa.string()),
                  ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """The records of WARC archives but warcinfo.  Digests are checked against
    what was read; of a revisit, length and digest are those it declares."""
    def rows(batches):
        for _, lines in _by_file(batches):
            for head, block in warc_records(lines):
                kind = head["warc-type"]
                if kind == "warcinfo":
                    continue
                if head["warc-block-digest"] != "sha1:" + sha1_base32(block):
                    raise ValueError(f"block digest of {head['warc-record-id']}")
                http, payload = split_http(block)
                declared = head["warc-payload-digest"].removeprefix("sha1:")
                if kind != "revisit" and declared != sha1_base32(payload):
                    raise ValueError(f"payload digest of {head['warc-record-id']}")
                key, to = http_field(http, KEY_HEADER), head.get("x-refers-to-key")
                n = len(payload)
                if kind == "revisit":
                    said = head.get("x-payload-length") or http_field(http, b"Content-Length")
                    n = int(said) if said else None
                yield {"record_type": kind, "record_id": head["warc-record-id"], "uri": head["warc-target-uri"],
                       "date": head["warc-date"], "key": int(key) if key else None, "payload_digest": declared,
                       "payload_bytes": n, "refers_to": int(to) if to else None,
                       "refers_to_id": head.get("warc-refers-to"), "payload": payload if with_payload else None}

    def run(batches):
        yield from _batches(rows(batches), READ, lambda r: len(r["payload"] or b"") + 400)

    return archive_lines(spark, path).mapInArrow(run, _ddl(READ))


def convert(spark: SparkSession, arc_path: str, warc_path: str, min_bytes: int = 0) -> None:
    """Legacy archives to WARC archives.  The index of all records (no
    payloads) decides the types; payloads move once, to meet their type."""
    base = scratch(spark, "warc_index")
    read_arc(spark, arc_path, with_payload=False).write.parquet(base)
    types = assign_types(spark.read.parquet(base), min_bytes)
    write_warc(read_arc(spark, arc_path).join(types, ["file", "ordinal"], "left"), warc_path)
