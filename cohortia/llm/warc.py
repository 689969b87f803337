"""WARC archives as a Spark data source, read and written in Python.

``spark.dataSource.register(Warc)``, then ``df.write.format("warc")`` and ``spark.read.format("warc")``; `write` and
`read` do both steps.

Reading. Partitions are planned from the file listing: runs of files of about ``partition_bytes`` (an archive is
one unit; the writer begins a new one at ``file_bytes``). Predicates on the record type and on any other
column that a record's named fields give are pushed down: a task inflates and parses the named
fields of a record first, tests the predicates on them, and goes on to the next record if they fail. The
block is inflated, hashed or copied only for records that pass, and only if a column of the schema asked for
needs it. A record that is not needed costs a seek: compressed records written here
carry their packed length in the gzip header (the ``sl`` extra field); foreign ones without it are inflated
without being kept, plain archives are skipped by Content-Length.

Writing. One gzip member for each record, HTTP responses with their payload digest, repeats as ``revisit`` records
with the HTTP header only. A task writes files under names of its own attempt; the commit writes a manifest of those
of the attempts that succeeded, and a reader of a folder with manifests reads only what they list, so lost
executors and repeated attempts leave nothing half-written in use.

Defined results: a NULL payload is empty; a NULL URL leaves out the field; control signs, spaces and letters beyond
ASCII in a URL are percent-encoded; without a date a record bears `DATE`. Damaged or cut archives raise an error that
names file and offset, as does a payload that contradicts its digest (option ``verify``).
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull,
    LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cohortia.llm.tokenfiles import _place
from cohortia.session import cut

#: Columns that named fields give, without a look at the block.
FROM_FIELDS = "record_type string, record_id string, date string, target_uri string, refers_to string, payload_digest string, content_length long, fields map<string,string>"
#: Columns that need the block: payload_bytes is what the HTTP header says for a revisit, which has no payload.
FROM_BLOCK = "http_status int, payload_bytes long, payload_sha1 string, payload binary"
SCHEMA = f"{FROM_FIELDS}, {FROM_BLOCK}"
_NEEDS_BLOCK = {x.split()[0] for x in FROM_BLOCK.split(", ")}
_NEEDS_PAYLOAD = _NEEDS_BLOCK - {"http_status"}
DATE = "1970-01-01T00:00:00Z"
FILE_BYTES = 256 << 20
PARTITION_BYTES = 64 << 20
BATCH_BYTES = 8 << 20
_CHUNK = 1 << 16
_HEAD = 1024  # inflated before the predicates on the fields are tested

# Fixed values of the format.
VERSION = b"WARC/1.1"
HTTP_RESPONSE = "application/http; msgtype=response"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STANDARD = {"warc-type": "record_type", "warc-record-id": "record_id", "warc-date": "date", "warc-target-uri": "target_uri", "warc-refers-to": "refers_to"}


class Damaged(ValueError):
    """An archive that breaks the format, with file and offset."""


# --- reading -------------------------------------------------------------------------------------------------------


class Source:
    """A file read forward in portions, with seeks over what is skipped."""

    def __init__(self, path: str, chunk: int = 1 << 20):
        fs, where = _place(path)
        self.file, self.path, self.chunk = fs.open_input_file(where), path, chunk
        self.size = self.file.size()
        self.at, self._begin, self._held = 0, 0, b""

    def peek(self, n: int) -> bytes:
        """Up to ``n`` bytes from here on, without going on."""
        off = self.at - self._begin
        if not 0 <= off <= len(self._held) - min(n, self.size - self.at):
            self.file.seek(self.at)
            self._begin, self._held, off = self.at, self.file.read(max(n, self.chunk)), 0
        return self._held[off:off + n]

    def take(self, n: int) -> bytes:
        out = self.peek(n)
        self.at += len(out)
        return out

    def damaged(self, what: str, at: int | None = None) -> Damaged:
        return Damaged(f"{self.path} at byte {self.at if at is None else at}: {what}")


class Plain:
    """Bytes of an uncompressed archive."""

    def __init__(self, source: Source):
        self.source = source

    def more(self) -> bool:
        return self.source.at < self.source.size

    def read(self, n: int) -> bytes:
        return self.source.take(n)

    def skip(self, n: int, last: bool) -> None:
        self.source.at += n


class Member:
    """Bytes of one gzip member; ``packed`` and ``full`` are its lengths where its header tells them."""

    def __init__(self, source: Source):
        self.source, self.start = source, source.at
        head = source.peek(12)
        if head[:3] != b"\x1f\x8b\x08":
            raise source.damaged("not a gzip member")
        self.packed = self.full = None
        if head[3] & 4 and len(head) == 12:
            extra = source.peek(12 + struct.unpack("<H", head[10:12])[0])[12:]
            while len(extra) >= 4:
                size = struct.unpack("<H", extra[2:4])[0]
                if extra[:2] == b"sl" and size == 8:
                    self.packed, self.full = struct.unpack("<II", extra[4:12])
                extra = extra[4 + size:]
        self.inflate = zlib.decompressobj(31)
        self.ready = b""

    def more(self) -> bool:
        if not self.ready:
            self.ready = self._step(_HEAD)
        return bool(self.ready)

    def _step(self, n: int) -> bytes:
        out = b""
        while not out and not self.inflate.eof:
            raw = self.inflate.unconsumed_tail
            if not raw:
                room = _CHUNK if self.packed is None else min(_CHUNK, self.start + self.packed - self.source.at)
                raw = self.source.take(room) if room > 0 else b""
                if not raw:
                    raise self.source.damaged("a compressed record ends early", self.start)
            try:
                out = self.inflate.decompress(raw, n)
            except zlib.error as e:
                raise self.source.damaged(str(e), self.start) from e
        if self.inflate.eof and self.inflate.unused_data:
            self.source.at -= len(self.inflate.unused_data)
            self.inflate = _Ended
        return out

    def read(self, n: int) -> bytes:
        out = self.ready or self._step(n)
        self.ready = out[n:]
        return out[:n]

    def skip(self, n: int, last: bool) -> None:
        """``last``: nothing of use follows in the member."""
        if last and self.packed is not None:
            self.ready, self.inflate, self.source.at = b"", _Ended, self.start + self.packed
            return
        while n > 0:
            got = len(self.read(min(n, _CHUNK)))
            if not got:
                raise self.source.damaged("a record ends early", self.start)
            n -= got


class _Ended:
    eof, unused_data, unconsumed_tail = True, b"", b""


def parse_fields(head: bytes) -> dict[str, str]:
    """Named fields by lower-case name; folded lines are joined, values of a repeated name too."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n"):
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = f"{out[name]}, {value.strip()}" if name in out else value.strip()
    return out


def digest_hex(value: str | None) -> str | None:
    """A labelled digest as bare hex where it is SHA-1 in base 32 or hex; others as they stand."""
    label, _, text = (value or "").partition(":")
    if label.lower() != "sha1":
        return value
    try:
        return base64.b32decode(text.upper()).hex() if len(text) == 32 else bytes.fromhex(text).hex()
    except ValueError:
        return value


class Record:
    """Named fields of a record; its block is there until the next one is asked for."""

    def __init__(self, stream: Plain | Member, fields: dict[str, str], size: int, start: int, whole: bool):
        self.stream, self.fields, self.left, self.start, self.whole = stream, fields, size, start, whole
        self.content_length = size

    def header(self) -> dict[str, object]:
        row = {column: self.fields.get(name) for name, column in STANDARD.items()}
        row["payload_digest"] = digest_hex(self.fields.get("warc-payload-digest"))
        return row | {"content_length": self.content_length, "fields": self.fields}

    def chunks(self) -> Iterator[bytes]:
        while self.left:
            part = self.stream.read(min(self.left, _CHUNK))
            if not part:
                raise self.stream.source.damaged("a record ends early", self.start)
            self.left -= len(part)
            yield part

    def finish(self) -> None:
        self.stream.skip(self.left, self.whole)
        self.left = 0


def records(path: str) -> Iterator[Record]:
    """Records of one archive in order, compressed record by record, as a whole, or not."""
    source = Source(path)
    packed = source.peek(2) == b"\x1f\x8b"
    while source.at < source.size:
        start = source.at
        stream = Member(source) if packed else Plain(source)
        while stream.more():
            head, n = b"", 0
            while b"\r\n\r\n" not in head and b"\n\n" not in head:
                part = stream.read(2048)
                if not part:
                    break
                head = (head + part).lstrip(b"\r\n") if not n else head + part
                n += len(part)
            if not head:
                break
            if not head.startswith(b"WARC/"):
                raise source.damaged("a record does not begin with WARC/", start)
            end = min(i + len(mark) for mark in (b"\r\n\r\n", b"\n\n") if (i := head.find(mark)) >= 0) if b"\n\n" in head or b"\r\n\r\n" in head else -1
            fields = parse_fields(head[:end].split(b"\n", 1)[1]) if end > 0 else {}
            if not fields.get("content-length", "").isdigit():
                raise source.damaged("a record without an end of its fields or a Content-Length", start)
            size = int(fields["content-length"])
            if packed:
                stream.ready = head[end:] + stream.ready
            else:
                source.at -= len(head) - end
            whole = packed and stream.full == end + size + 4
            record = Record(stream, fields, size, start, whole)
            yield record
            record.finish()
            if not packed and source.at > source.size:
                raise source.damaged("a record ends early", start)


@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


def _value(row: dict[str, object], path: tuple[str, ...]) -> object:
    if len(path) == 1:
        return row[path[0]]
    return (row["fields"] or {}).get(path[1])


_COMPARE: dict[type, Callable[[object, object], bool]] = {
    EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y,
    LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y, StringStartsWith: lambda x, y: x.startswith(y),
    StringEndsWith: lambda x, y: x.endswith(y), StringContains: lambda x, y: y in x}


def holds(test: Filter, row: dict[str, object]) -> bool | None:
    """What a pushed predicate says of a record's fields; None is unknown."""
    if isinstance(test, Not):
        inner = holds(test.child, row)
        return None if inner is None else not inner
    value = _value(row, test.attribute)
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if isinstance(test, EqualNullSafe):
        return value == test.value
    if value is None or getattr(test, "value", None) is None:
        return None
    return _COMPARE[type(test)](value, test.value)


def _pushable(test: Filter) -> bool:
    if isinstance(test, Not):
        return _pushable(test.child)
    columns = {x.split()[0] for x in FROM_FIELDS.split(", ")} - {"fields"}
    return type(test) in (*_COMPARE, IsNull, IsNotNull, EqualNullSafe) and len(test.attribute) == 1 and test.attribute[0] in columns \
        and not (isinstance(test, In) and None in test.value)


class Reader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict[str, str]):
        self.schema, self.path = schema, options["path"]
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.verify = options.get("verify", "true").lower() == "true"
        self.tests: list[Filter] = []
        unknown = set(schema.names) - {x.split()[0] for x in SCHEMA.split(", ")}
        if unknown:
            raise ValueError(f"no such columns of an archive: {sorted(unknown)}")

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for test in filters:
            if _pushable(test):
                self.tests.append(test)
            else:
                yield test

    def partitions(self) -> Sequence[InputPartition]:
        out, run, size = [], [], 0
        for path, n in listing(self.path):
            if run and size + n > self.partition_bytes:
                out.append(Files(tuple(run)))
                run, size = [], 0
            run.append(path)
            size += n
        return [*out, Files(tuple(run))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        names = self.schema.names
        types = to_arrow_schema(self.schema)
        block, payload = bool(_NEEDS_BLOCK & set(names)), bool(_NEEDS_PAYLOAD & set(names))
        rows: list[dict[str, object]] = []
        held = 0
        for path in partition.paths:
            for record in records(path):
                row = record.header()
                if not all(holds(t, row) for t in self.tests):
                    continue
                if block:
                    row |= self._block(record, payload, "payload" in names)
                rows.append({c: row.get(c) for c in names})
                held += 500 + len(row.get("payload") or b"")
                if held > BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=types)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=types)

    def _block(self, record: Record, payload: bool, keep: bool) -> dict[str, object]:
        chunks, http, status = record.chunks(), {}, None
        first = b""
        if record.fields.get("content-type", "").lower().startswith("application/http"):
            for part in chunks:
                first += part
                if b"\r\n\r\n" in first:
                    break
            head, _, first = first.partition(b"\r\n\r\n")
            http = parse_fields(head.partition(b"\r\n")[2])
            words = head.split(None, 2)
            status = int(words[1]) if len(words) > 1 and words[0].startswith(b"HTTP/") and words[1].isdigit() else None
        out: dict[str, object] = {"http_status": status}
        if not payload:
            return out
        told = record.fields.get("warc-payload-digest")
        if record.fields.get("warc-type") == "revisit":
            length = http.get("content-length", "")
            return out | {"payload_bytes": int(length) if length.isdigit() else None}
        parts = _unchunked(first, chunks) if "chunked" in http.get("transfer-encoding", "").lower() else _chained(first, chunks)
        sha1, size, kept = hashlib.sha1(), 0, []
        for part in parts:
            sha1.update(part)
            size += len(part)
            if keep:
                kept.append(part)
        digest = sha1.hexdigest()
        if self.verify and len(digest_hex(told) or "") == 40 and digest_hex(told) != digest:
            raise record.stream.source.damaged("the payload contradicts its digest", record.start)
        return out | {"payload_bytes": size, "payload_sha1": digest, "payload": b"".join(kept) if keep else None}


def _chained(first: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    if first:
        yield first
    yield from chunks


def _unchunked(first: bytes, chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The body of a message sent in chunks, each with its length in hex before it."""
    raw = first + b"".join(chunks)
    at = 0
    while (end := raw.find(b"\r\n", at)) >= 0:
        try:
            size = int(raw[at:end].split(b";")[0], 16)
        except ValueError:
            yield raw[at:]  # not in chunks after all
            return
        if not size:
            return
        yield raw[end + 2:end + 2 + size]
        at = end + 2 + size + 2
    yield raw[at:]


def listing(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a file or folder: those its manifests list, or all where it has none."""
    fs, where = _place(path)
    info = fs.get_file_info(where)
    if info.type == pyarrow.fs.FileType.File:
        return [(path, info.size)]
    found = fs.get_file_info(pyarrow.fs.FileSelector(where, allow_not_found=True))
    manifests = sorted(f.path for f in found if f.base_name.startswith("_manifest-"))
    root = path.rstrip("/")
    if manifests:
        out = []
        for m in manifests:
            with fs.open_input_stream(m) as f:
                out += [(f"{root}/{name}", size) for name, size in json.loads(f.read())]
        return sorted(out)
    return sorted((f"{root}/{f.base_name}", f.size) for f in found if f.base_name.endswith((".warc", ".warc.gz")) and not f.base_name.startswith(("_", ".")))


# --- writing -------------------------------------------------------------------------------------------------------


def clean_uri(url: str) -> str:
    return urllib.parse.quote(url, safe="".join(chr(c) for c in range(0x21, 0x7F)))


def packed_record(fields: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    """One gzip member whose header tells its packed and full length."""
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]).encode() + b"\r\n"
    raw = head + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(raw) + deflate.flush()
    size = 24 + len(body) + 8
    told = size < 1 << 32 and len(raw) < 1 << 32
    extra = b"sl" + struct.pack("<HII", 8, size, len(raw)) if told else b""
    gzip = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", len(extra)) + extra
    return gzip + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _line(value: str) -> str:
    return " ".join(value.split())


def http_record(row: dict, level: int) -> bytes:
    """A response with its payload, or a revisit with the HTTP header only."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "response"
    digest = row.get("payload_digest") or hashlib.sha1(payload).hexdigest()
    fields = [("WARC-Type", _line(kind)), ("WARC-Record-ID", _line(row.get("record_id") or f"<{uuid.uuid4().urn}>")), ("WARC-Date", _line(row.get("date") or DATE))]
    if row.get("target_uri") is not None:
        fields.append(("WARC-Target-URI", clean_uri(row["target_uri"])))
    if row.get("refers_to") is not None:
        fields.append(("WARC-Refers-To", _line(row["refers_to"])))
    if kind == "revisit":
        fields.append(("WARC-Profile", SAME_PAYLOAD))
    fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()), ("Content-Type", HTTP_RESPONSE)]
    fields += [(_line(k), _line(v)) for k, v in (row.get("fields") or [])]
    length = row["payload_bytes"] if row.get("payload_bytes") is not None else len(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return packed_record(fields, head if kind == "revisit" else head + payload, level)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int]]


class Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")
        self.file_bytes, self.level = int(options.get("file_bytes", FILE_BYTES)), int(options.get("level", 4))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, where = _place(self.path)
        fs.create_dir(where, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        done: list[tuple[str, int]] = []
        sink, size = None, 0
        for batch in iterator:
            for i in range(batch.num_rows):
                if sink is None:
                    name = f"part-{part:06d}-{len(done):04d}-{attempt}.warc.gz"
                    sink, size = fs.open_output_stream(f"{where}/{name}", compression=None, buffer_size=1 << 20), 0
                    size += sink.write(packed_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<{uuid.uuid4().urn}>"), ("WARC-Date", DATE),
                                                      ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", self.level))
                size += sink.write(http_record({c: batch.column(j)[i].as_py() for j, c in enumerate(batch.schema.names)}, self.level))
                if size >= self.file_bytes:
                    sink.close()
                    done.append((name, size))
                    sink = None
        if sink is not None:
            sink.close()
            done.append((name, size))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = _place(self.path)
        fs.create_dir(where, recursive=True)
        with fs.open_output_stream(f"{where}/_manifest-{self.job}.json") as f:
            f.write(json.dumps([x for m in messages if m for x in m.files]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = _place(self.path)
        for name, _ in [x for m in messages if m for x in m.files]:
            fs.delete_file(f"{where}/{name}")


class Warc(DataSource):
    """Options: path, partition_bytes, verify (reading); path, file_bytes, level (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        if overwrite:
            raise ValueError("archives are only added to a folder; use mode('append')")
        return Writer(dict(self.options))


def read(spark: SparkSession, path: str, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Records of the archives below ``path``; only ``columns`` are worked out, predicates on named fields are pushed down."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    types = dict(x.split(" ", 1) for x in SCHEMA.split(", "))
    schema = ", ".join(f"{c} {types[c]}" for c in columns or types)
    return spark.read.format("warc").schema(schema).options(**options).load(path)


def write(df: DataFrame, path: str, **options: str) -> str:
    """Add a record for each row (record_type, record_id, date, target_uri, refers_to, payload, payload_digest, payload_bytes, fields, as far as there)."""
    df.sparkSession.dataSource.register(Warc)
    df.write.format("warc").mode("append").options(**options).save(path)
    return path


# --- records of pages ----------------------------------------------------------------------------------------------

#: Parts that rows of one payload are dealt to when they meet their first record.
SALTS = 16


def page_urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), page_id.cast("string"), F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page id in a record id made by `page_records`; NULL for others."""
    return F.regexp_extract(urn, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def page_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 1000) -> DataFrame:
    """A record for each page: of equal payloads of at least ``least`` bytes that of the largest id is a response, the others revisit it.

    Rows that repeat the id and payload of the response are responses too. A NULL id never is what others refer to; where all
    ids of a payload are NULL each of its rows is a response. Payloads are equal if SHA-1, length and a further 64-bit digest are.
    """
    body = F.encode(F.coalesce(pages[html_col], F.lit("")), "UTF-8")
    base = (pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("target_uri"), body.alias("payload"))
            .withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long"), "xx": F.xxhash64("payload")}))
    keys = ["payload_digest", "payload_bytes", "xx"]
    first = (base.filter(F.col("payload_bytes") >= least).groupBy(*keys).agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
             .filter("n > 1 and first is not null").select(*keys, "first"))
    first = cut(first)  # of known size: sent to all tasks if small
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = base.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    own = F.coalesce(page_urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("payload_digest"), F.lit(">")))
    return salted.join(first, [*keys, "salt"], "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), own.alias("record_id"), "target_uri",
        F.when(again, page_urn(F.col("first"))).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"), "payload_digest", "payload_bytes")
