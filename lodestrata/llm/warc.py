"""WARC archives as a Spark data source, for reading and writing.

``spark.dataSource.register(Warc)``, then ``spark.read.format("warc").load(path)``.
The reader plans one partition a file (the writer rolls files at ``maxFileBytes``, so
none is unbounded). Filters on record_type, page_id, target_uri, record_id and refers_to
are pushed down and answered from a record's headers, which are parsed first; a payload
is only decoded if its record is wanted. The writer notes each gzip member's length in
its header (the ``sl`` extra field of the WARC standard), so unwanted members of one
record are skipped unread; without it, or where a member holds several records, what is
unwanted is inflated and discarded as a stream. A member of 4 GiB or more has no such
field. Option
``payload=false`` leaves the payload column null: length and digest are still taken from
the bytes. Files are opened through pyarrow.fs, so any store that it knows will do.

A write task writes a file of its own name; only those named in a manifest count, so
tasks can be repeated. Each commit writes a manifest of its own name, under another name
first, so commits at the same time keep each other's files.

``deduplicated``: of records with equal payloads of 100 bytes or more, the one with the
smallest page_id is a response and the others revisit it.

Cases: null html is an empty payload; null page_ids are written without an id and are
never the smallest unless no other exists (then all are responses); rows that repeat the
smallest page_id are responses alike; null urls have no target header, line breaks in
urls are percent-coded; an empty table gives archives without records; payloads of up to
2 GiB, Arrow's bound for one value, are written and read whole; a record whose
Content-Length is missing or no number has no payload, and reading goes on at the next
line that begins with ``WARC/``; an archive cut short gives what it holds; what lies between
gzip members is passed over; a member that cannot be inflated gives a row of the type
``damaged`` with file and place in record_id, and reading goes on at the next member; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage

from lodestrata.llm.common import bounded_batches, shared_dir, written

LEAST = 100
MANIFEST = "_manifest"
URN = "urn:page:"
SCHEMA = "record_type string, record_id string, target_uri string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
#: Bytes read at once, rows' bytes given at once, longest line read at once.
_READ, _OUT, _LINE = 1 << 18, 8 << 20, 1 << 20


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(rf"<{URN}(-?\d+)>", urn or "")
    return int(m[1]) if m else None


# Writing


def record(kind: str, page_id: int | None, uri: str | None, payload: bytes, digest: str, length: int, refers_to: int | None, date: str) -> bytes:
    """One WARC record with an HTTP block; revisits carry the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{page_id}>" if page_id is not None else f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if uri is not None:
        head.append("WARC-Target-URI: " + uri.replace("\r", "%0D").replace("\n", "%0A"))
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def member(data: bytes, level: int) -> bytes:
    """A gzip member that tells its own compressed and plain length."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    if max(size, len(data)) > 0xFFFFFFFF:
        head = b"\x1f\x8b\x08\0\0\0\0\0\0\xff"
    else:
        head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data))
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", 3))
        self.roll = int(options.get("maxfilebytes", 1 << 30))
        self.date = options.get("date", "1970-01-01T00:00:00Z")
        self.overwrite = overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = _store(self.path)
        fs.create_dir(root)
        files: list[str] = []
        out, size, count = None, 0, 0
        for batch in iterator:
            held = bytearray()
            columns = [batch.column(c).to_pylist() for c in ("record_type", "page_id", "target_uri", "payload", "payload_digest", "payload_bytes", "refers_to")]
            for kind, page, uri, payload, digest, length, refers in zip(*columns):
                held += member(record(kind, page, uri, payload or b"", digest, length, refers, self.date), self.level)
                count += 1
            if out is None or size >= self.roll:
                if out is not None:
                    out.close()
                files.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = fs.open_output_stream(f"{root}/{files[-1]}", compression=None), 0
            out.write(bytes(held))
            size += len(held)
        if out is not None:
            out.close()
        return Written(files, count)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _store(self.path)
        fs.create_dir(root)
        old = _manifests(fs, root) if self.overwrite else []
        name = f"{MANIFEST}-{uuid.uuid4().hex}.json"
        with fs.open_output_stream(f"{root}/.{name}") as f:
            f.write(json.dumps({"files": sorted(f for m in messages if m for f in m.files)}).encode())
        fs.move(f"{root}/.{name}", f"{root}/{name}")
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list[Written | None]) -> None:
        """The finished tasks' files go; other files without a manifest are never read."""
        fs, root = _store(self.path)
        for name in (f for m in messages if m for f in m.files):
            if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                fs.delete_file(f"{root}/{name}")


# Reading


@dataclass
class Archive(InputPartition):
    file: str


def _manifests(fs: pafs.FileSystem, root: str) -> list[str]:
    info = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(x.path for x in info if x.type == pafs.FileType.File and x.base_name.startswith(MANIFEST))


def _listed(fs: pafs.FileSystem, root: str) -> list[str]:
    """Names under root: the manifests', or all archives where there is none."""
    names: list[str] = []
    manifests = _manifests(fs, root)
    for path in manifests:
        with fs.open_input_stream(path) as f:
            names += json.loads(f.read())["files"]
    if manifests:
        return sorted(names)
    info = fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted(x.path[len(root) + 1 :] for x in info if x.type == pafs.FileType.File and re.search(r"\.warc(\.gz)?$", x.path))


#: Fixed value: how a gzip member begins.
MAGIC = b"\x1f\x8b\x08"


class Damaged(ValueError):
    """A member that cannot be inflated, by its place in the archive."""


class _Plain:
    """Bytes of an uncompressed archive."""

    def __init__(self, f: io.BufferedReader):
        self.f = f

    def line(self) -> bytes:
        return self.f.readline(_LINE)

    def read(self, n: int) -> bytes:
        return self.f.read(n)

    def skip(self, n: int) -> None:
        self.f.seek(n, 1)


class _Members:
    """Bytes of a gzipped archive of one or more members, with one or more records each."""

    def __init__(self, f: io.BufferedReader):
        self.f, self.raw, self.plain = f, b"", b""
        self.z = None
        self.given = 0  # bytes of this member that were handed out or passed over

    def _next_member(self) -> bool:
        while True:
            if len(self.raw) < 32:
                self.raw += self.f.read(_READ)
            at = self.raw.find(MAGIC)
            if at >= 0:
                break
            tail = self.raw[-2:]  # padding, or the end
            self.raw = self.f.read(_READ)
            if not self.raw:
                return False
            self.raw = tail + self.raw
        self.raw = self.raw[at:]
        if len(self.raw) < 32:
            self.raw += self.f.read(_READ)
        self.start = self.f.tell() - len(self.raw)
        self.size = self.whole = 0
        if self.raw[3] & 4 and self.raw[12:14] == b"sl":
            self.size, self.whole = struct.unpack("<II", self.raw[16:24])
        self.z, self.given = zlib.decompressobj(31), 0
        return True

    def _go_on(self) -> bool:
        """Look for a member after the start of this one; if there is one, leave this one."""
        self.f.seek(self.start + 1)
        tail = b""
        while data := self.f.read(_READ):
            if MAGIC in tail + data:
                self.f.seek(self.start + 1)
                self.raw, self.plain, self.z = b"", b"", None
                return True
            tail = data[-2:]
        return False

    def _more(self, n: int) -> bool:
        """Some n more plain bytes of this member."""
        if self.z is None or self.z.eof:
            return False
        if not self.raw:
            self.raw = self.f.read(_READ)
            if not self.raw:  # the archive ends in this member, cut short unless others follow its start
                if self._go_on():
                    raise Damaged(self.start)
                return False
        try:
            self.plain += self.z.decompress(self.raw, n)
        except zlib.error as e:
            if not self._go_on():
                self.raw, self.plain, self.z = b"", b"", None  # at the end
            raise Damaged(self.start) from e
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def line(self) -> bytes:
        """The next line, of the next member where this one ends; empty at the end of all."""
        while True:
            at = self.plain.find(b"\n")
            if at >= 0 or len(self.plain) >= _LINE or not self._more(4096):
                at = at + 1 if at >= 0 else len(self.plain)
                if at or not self._next_member():
                    break
        out, self.plain = self.plain[:at], self.plain[at:]
        self.given += at
        return out

    def read(self, n: int) -> bytes:
        parts, have = [self.plain], len(self.plain)
        self.plain = b""
        while have < n and self._more(n - have):
            parts.append(self.plain)
            have += len(self.plain)
            self.plain = b""
        data = b"".join(parts)
        self.plain = data[n:]
        self.given += min(n, have)
        return data[:n]

    def skip(self, n: int) -> None:
        if self.size and self.given + n + len(b"\r\n\r\n") >= self.whole:  # the member's last record
            self.f.seek(self.start + self.size)
            self.raw, self.plain, self.z = b"", b"", None
            return
        while n > 0 and (part := self.read(min(n, _READ))):
            n -= len(part)


def _headers(source) -> dict[str, str]:
    head: dict[str, str] = {}
    while line := source.line().rstrip(b"\r\n"):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        head[name.strip().lower()] = value.strip()
    return head


class WarcReader(DataSourceReader):
    KEYS = ("record_type", "record_id", "target_uri", "page_id", "refers_to")

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.payload = options.get("payload", "true").lower() != "false"
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else ""
            if name in self.KEYS and isinstance(f, EqualTo | EqualNullSafe):
                self.tests.append((name, (f.value,)))
            elif name in self.KEYS and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in self.KEYS and isinstance(f, IsNotNull):
                self.tests.append((name, ()))
            else:
                yield f

    def partitions(self) -> list[Archive]:
        fs, root = _store(self.path)
        if fs.get_file_info(root).type == pafs.FileType.File:
            return [Archive(self.path)]
        return [Archive(f"{self.path}/{name}") for name in _listed(fs, root)] or [Archive("")]

    def _wanted(self, row: dict) -> bool:
        return all(row[k] is not None and (not v or row[k] in v) for k, v in self.tests)

    def read(self, partition: Archive) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, path = _store(partition.file)
        rows: list[dict] = []
        held = 0
        with io.BufferedReader(fs.open_input_file(path), _READ) as f:
            source = (_Members if path.endswith(".gz") else _Plain)(f)
            while True:
                try:
                    row = self._record(source)
                except Damaged as e:
                    row = dict.fromkeys(_ARROW.names) | {"record_type": "damaged", "record_id": f"{partition.file}#{e.args[0]}"}
                    row = row if self._wanted(row) else {}
                if row is None:
                    break
                if row:
                    rows.append(row)
                    held += len(row["payload"] or b"") + 512
                if held >= _OUT:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    def _record(self, source) -> dict | None:
        """The next record: a row if it is wanted, else empty; None at the end."""
        while line := source.line():
            if line.startswith(b"WARC/"):
                break
        else:
            return None
        head = _headers(source)
        length = int(x) if re.fullmatch("[0-9]{1,18}", x := head.get("content-length", "")) else 0
        row = {"record_type": head.get("warc-type"), "record_id": head.get("warc-record-id"), "target_uri": head.get("warc-target-uri"), "page_id": _page(head.get("warc-record-id")), "refers_to": _page(head.get("warc-refers-to"))}
        if self._wanted(row):
            return row | self._body(source.read(length), head)
        source.skip(length)
        return {}

    def _body(self, block: bytes, head: dict[str, str]) -> dict:
        """Payload, its length and digest; those of a revisit are as its headers say."""
        payload, http = block, {}
        if "application/http" in head.get("content-type", ""):
            first, _, payload = block.partition(b"\r\n\r\n")
            for line in first.decode("latin-1").split("\r\n")[1:]:
                name, _, value = line.partition(":")
                http[name.strip().lower()] = value.strip()
        if head.get("warc-type") == "revisit":
            size = http.get("content-length")
            return {"payload": None, "payload_bytes": int(size) if size and re.fullmatch("[0-9]{1,18}", size) else None, "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha256:") or None}
        return {"payload": payload if self.payload else None, "payload_bytes": len(payload), "payload_digest": hashlib.sha256(payload).hexdigest()}


class Warc(DataSource):
    """Options: path; reading: payload; writing: level, maxFileBytes, date."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def deduplicated(pages: DataFrame) -> DataFrame:
    """Rows of pages as records to write: SCHEMA's columns.

    The digests that occur more than once are written first, so that Spark knows the
    table's size: if it is small they are broadcast and no payload is shuffled, else both
    sides meet by digest."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", F.col("url").alias("target_uri"), payload.alias("payload"))
    own = own.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    groups = own.where(F.col("payload_bytes") >= LEAST).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    groups = written(groups)
    joined = own.join(groups, "payload_digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), F.lit(None).cast("string").alias("record_id"), "target_uri", F.col("page_id").cast("long").alias("page_id"),
        F.when(revisits, F.col("first")).cast("long").alias("refers_to"), "payload_bytes", "payload_digest", F.when(~revisits, F.col("payload")).alias("payload"))


def archive(pages: DataFrame, path: str | None = None) -> str:
    """Write pages as archives; returns the folder."""
    spark = pages.sparkSession
    bounded_batches(spark)
    spark.dataSource.register(Warc)
    path = path or shared_dir(spark)
    deduplicated(pages).write.format("warc").mode("append").save(path)
    return path


def load(spark, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, read from archives."""
    path = archive(pages)
    return load(pages.sparkSession, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
g AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest HAVING count(*) > 1)
SELECT page_id, payload_bytes, p.payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest
"""
