"""WARC files as a PySpark Python data source, for reading and writing.

Reading plans partitions from files and, for files of gzip members, from ranges of
them. Predicates on the record type and on header columns reach the reader, which
parses a record's WARC header first: a record that fails is skipped by its length in
a plain file, or drained without being kept in a compressed one, and its payload is
neither decoded nor copied. ``payload=false`` leaves out all payloads: of a block
no more than the first HEAD bytes are kept, for the HTTP status.

Writing puts one gzip member a record into each task's file; a manifest that is
written at commit names the files of successful tasks, and readers of the folder use
no others, so lost or repeated tasks leave no duplicate records.

Columns: record_type, record_id, target_uri, date, content_type, content_length,
headers (names in lower case), http_status, payload (the HTTP body of HTTP blocks,
else the block).

Defined cases: missing headers are null; a malformed record is passed over up to
the next record unless ``strict=true`` raises; null urls and payloads are written as such and read as null;
an HTTP status that isn't three digits is null;
control characters in a url survive; an empty table writes a file without records;
duplicated pages become records of their own.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

from .shared import local_files, new_path

SCHEMA = "record_type string, record_id string, target_uri string, date string, content_type string, content_length long, headers map<string,string>, http_status int, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("content_type", pa.string()), ("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http_status", pa.int32()), ("payload", pa.binary())])
_HEADER_OF = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "content_type": "content-type"}
_BLOCK = 1 << 20
_RANGE = 32 << 20
HEAD = 1 << 16
_MAGIC = b"\x1f\x8b\x08"
_NEXT = b"\r\nWARC/"


class WarcError(ValueError):
    pass


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    file: str


def parse_header(head: bytes) -> dict[str, str]:
    """Names in lower case to values; continuation lines are joined."""
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no WARC version line")
    out: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    if "x-target-json" in out:
        out["warc-target-uri"] = json.loads(out["x-target-json"])
    return out


def passes(tests: list[tuple[str, str, object]], header: dict[str, str]) -> bool:
    for column, kind, value in tests:
        have = header.get(_HEADER_OF[column])
        if have is None:
            return False
        if kind == "eq" and have != value or kind == "in" and have not in value or kind == "starts" and not have.startswith(value) or kind == "contains" and value not in have:
            return False
    return True


class _Member:
    """One gzip member of a file, inflated as far as asked."""

    def __init__(self, rest: bytes, more) -> None:
        self.z, self.rest, self.more, self.taken = zlib.decompressobj(31), rest, more, len(rest)

    def read(self, most: int) -> bytes:
        while not self.z.eof:
            if not self.rest:
                self.rest = self.more()
                self.taken += len(self.rest)
                if not self.rest:
                    raise WarcError("the file ends inside a record")
            out = self.z.decompress(self.rest, most)
            self.rest = self.z.unconsumed_tail
            if out:
                return out
        return b""

    def left(self) -> bytes:
        return self.z.unused_data


def _length(header: dict[str, str]) -> int:
    value = header.get("content-length", "0")
    if not (value.isascii() and value.isdigit()):
        raise WarcError(f"no content length: {value!r}")
    return int(value)


def _member_records(m: _Member, tests: list, strict: bool, most: int | None) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of a gzip member, which is read to its end."""
    buf = b""
    while True:
        buf = buf.lstrip(b"\r\n")
        while (cut := buf.find(b"\r\n\r\n")) < 0 and (got := m.read(4096)):
            buf = (buf + got).lstrip(b"\r\n")
        if cut < 0:
            if buf.strip() and strict:
                raise WarcError("a record without a whole header")
            return
        try:
            header = parse_header(buf[:cut])
            left = _length(header)
        except ValueError:
            if strict:
                raise
            buf = buf[1:]
            while (k := buf.find(_NEXT)) < 0 and (got := m.read(_BLOCK)):
                buf = buf[1 - len(_NEXT) :] + got
            if k < 0:
                return
            buf = buf[k:]
            continue
        buf = buf[cut + 4 :]
        keep, parts = passes(tests, header), []
        room = left if most is None else most
        while True:
            part, buf = buf[:left], buf[left:]
            left -= len(part)
            if keep and room > 0:
                parts.append(part[:room])
                room -= len(part)
            if not left:
                break
            if not (buf := m.read(max(4096, min(left, _BLOCK)))):
                raise WarcError("the member ends inside a record")
        if keep:
            yield header, b"".join(parts)


def gzip_records(f, start: int, end: int, tests: list, strict: bool = True, most: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records whose member begins within the range, of their blocks the first ``most`` bytes; unless ``strict``, malformed ones are passed over."""
    f.seek(start)
    rest, at = b"", start
    more = lambda: f.read(_BLOCK)
    if start:
        rest, at = _sync(f, start, end)
        if at >= end:
            return
    while at < end:
        if not rest and not (rest := more()):
            return
        m = _Member(rest, more)
        try:
            yield from _member_records(m, tests, strict, most)
        except (WarcError, zlib.error):
            if strict:
                raise
            f.seek(at + 1)
            rest, at = _sync(f, at + 1, end)
            continue
        rest = m.left()
        at += m.taken - len(rest)


def _sync(f, start: int, end: int) -> tuple[bytes, int]:
    """The first member with a WARC header at or after start: the bytes read from it on, its offset."""
    buf, base = b"", start
    while base < end:
        got = f.read(_BLOCK)
        buf += got
        k = buf.find(_MAGIC)
        while k >= 0:
            if len(buf) - k < 4096 and (extra := f.read(_BLOCK)):
                buf += extra
            try:
                if zlib.decompressobj(31).decompress(buf[k : k + 4096], 5) == b"WARC/":
                    return buf[k:], base + k
            except zlib.error:
                pass
            k = buf.find(_MAGIC, k + 1)
        if not got:
            break
        base += max(0, len(buf) - 2)
        buf = buf[-2:]
    return b"", end


def _sync_plain(f, start: int) -> int:
    """The offset of the first line at or after start that begins a record, or of the file's end."""
    f.seek(start)
    buf, base = b"", start
    while got := f.read(_BLOCK):
        buf += got
        if (k := buf.find(_NEXT)) >= 0:
            return base + k
        keep = min(len(buf), len(_NEXT) - 1)
        base += len(buf) - keep
        buf = buf[len(buf) - keep :]
    return base + len(buf)


def plain_records(f, tests: list, strict: bool = True, most: int | None = None) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed file; unwanted blocks are passed over by seeking. Unless ``strict``, malformed ones are passed over."""
    at, end = 0, f.seek(0, 2)
    while True:
        f.seek(at)
        head = b""
        while (cut := head.find(b"\r\n\r\n")) < 0:
            got = f.read(4096)
            if not got:
                break
            head += got
        lead = len(head) - len(head.lstrip(b"\r\n"))
        if lead:
            at += lead
            continue
        if cut < 0:
            if head.strip() and strict:
                raise WarcError("a record without a whole header")
            return
        try:
            header = parse_header(head[:cut])
            size = _length(header)
        except ValueError:
            if strict:
                raise
            at = _sync_plain(f, at + 1)
            continue
        begun = at
        at += cut + 4
        if at + size > end:
            if strict:
                raise WarcError("the file ends inside a record")
            at = _sync_plain(f, begun + 1)
            continue
        if passes(tests, header):
            f.seek(at)
            yield header, f.read(size if most is None else min(size, most))
        at += size


def split_http(header: dict[str, str], block: bytes) -> tuple[int | None, bytes]:
    """(status, body) of an HTTP block, else (None, block)."""
    if not header.get("content-type", "").startswith("application/http"):
        return None, block
    head, _, body = block.partition(b"\r\n\r\n")
    first = head.split(b"\r\n", 1)[0].split(b" ")
    return (int(first[1]) if len(first) > 1 and first[0].startswith(b"HTTP/") and len(first[1]) == 3 and first[1].isdigit() else None), body


class WarcReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.strict = options.get("strict", "false").lower() == "true"
        self.range = int(options.get("range", _RANGE))
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        kinds = {EqualTo: "eq", In: "in", StringStartsWith: "starts", StringContains: "contains"}
        for f in filters:
            column = f.attribute[0] if len(f.attribute) == 1 else ""
            if column in _HEADER_OF and isinstance(f, IsNotNull):
                self.tests.append((column, "some", None))
            elif column in _HEADER_OF and type(f) in kinds and f.value is not None:
                self.tests.append((column, kinds[type(f)], f.value))
            else:
                yield f

    def partitions(self) -> list[Range]:
        fs, where = local_files(self.path)
        info = fs.get_file_info(where)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(where, recursive=True))
        manifests = [i for i in files if i.base_name.startswith("_manifest-")]
        if manifests:
            named = {n for m in manifests for n in json.loads(fs.open_input_stream(m.path, compression=None).read())}
            files = [i for i in files if i.base_name in named]
        out = []
        for i in sorted(files, key=lambda i: i.path):
            if i.type == pafs.FileType.File and not i.base_name.startswith(("_", ".")):
                step = self.range if i.path.endswith(".gz") else max(1, i.size)
                out += [Range(i.path, s, min(i.size, s + step)) for s in range(0, i.size, step)]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = local_files(self.path)
        rows: list[dict] = []
        held = 0
        with fs.open_input_file(partition.file) as f:
            most = None if self.payload else HEAD
            records = gzip_records(f, partition.start, partition.end, self.tests, self.strict, most) if partition.file.endswith(".gz") else plain_records(f, self.tests, self.strict, most)
            for h, block in records:
                status, body = split_http(h, block)
                row = {c: h.get(n) for c, n in _HEADER_OF.items()}
                row |= {"content_length": int(h["content-length"]) if h.get("content-length", "").isdigit() else None, "headers": list(h.items()), "http_status": status}
                row["payload"] = body if self.payload and "x-null-payload" not in h else None
                rows.append(row)
                held += len(block)
                if held > 4 << 20 or len(rows) >= 4096:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


def record(kind: str, url: str | None, content_type: str, block: bytes, more: dict[str, str], key: str) -> bytes:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, kind + key)}>", "WARC-Date: 2024-01-01T00:00:00Z"]
    if url is not None:
        if url != url.strip() or any(ord(c) < 32 for c in url):
            lines.append(f"X-Target-JSON: {json.dumps(url)}")
        else:
            lines.append(f"WARC-Target-URI: {url}")
    lines += [f"Content-Type: {content_type}", f"Content-Length: {len(block)}", *(f"{k}: {v}" for k, v in more.items())]
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(("WARC/1.1\r\n" + "\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + z.flush()


class WarcWriter(DataSourceArrowWriter):
    """Writes (page_id, url, html) as a request and a response record each."""

    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, where = local_files(self.path)
        fs.create_dir(where, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        with fs.open_output_stream(f"{where}/{name}", compression=None) as f:
            for b in iterator:
                for page, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                    more = {} if page is None else {"X-Page-Id": str(page)}
                    f.write(record("request", url, "application/http; msgtype=request", b"GET / HTTP/1.1\r\n\r\n", more, f"{page}"))
                    body = (html or "").encode("utf-8", "surrogatepass")
                    if html is None:
                        more["X-Null-Payload"] = "1"
                    f.write(record("response", url, "application/http; msgtype=response", b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body) + body, more, f"{page}"))
        return Written(name)

    def commit(self, messages: list[Written | None]) -> None:
        fs, where = local_files(self.path)
        fs.create_dir(where, recursive=True)
        with fs.open_output_stream(f"{where}/_manifest-{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps([m.file for m in messages if m]).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, where = local_files(self.path)
        for m in messages:
            if m:
                fs.delete_file(f"{where}/{m.file}")


class WarcDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make ``format("warc")`` known to the session and let filters reach Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def write_pages(pages: DataFrame, path: str) -> None:
    register(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows.write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, url, html) of the response records."""
    register(spark)
    found = spark.read.format("warc").load(path).where((F.col("record_type") == "response") & F.col("content_type").startswith("application/http"))
    return found.select(F.col("headers")["x-page-id"].cast("long").alias("page_id"), F.col("target_uri").alias("url"), F.decode("payload", "UTF-8").alias("html"))


def pages_through_warc(pages: DataFrame) -> DataFrame:
    """The pages after a way through WARC files in the shared folder."""
    path = new_path(pages.sparkSession, "warc")
    write_pages(pages, path)
    return read_pages(pages.sparkSession, path)


ORACLE = "SELECT page_id, url, html FROM pages"
