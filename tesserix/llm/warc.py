"""WARC archives as a Python data source.

Writing: each task writes one gzip file of records, a gzip member each, whose header carries
its length (subfield "sl"), and reports it; only files of the attempts that Spark commits are
listed in the archive's manifests, so lost and repeated tasks leave no records twice.  Every
commit writes a manifest of its own: appending adds to an archive, overwriting ends the others.

Reading: files are planned as partitions, large ones in ranges that start at the next record.
A record's headers are parsed first; filters on what they say (type, page, address, date) are
pushed down, and the rest of an unwanted record is skipped by its length without being decoded.
Archives of other writers are read as well: their records have an id and a date instead of a
page_id, chunked bodies are put together, and what a body is packed with is told; a gzip member may
hold many records, and lines may end in LF alone.  Nothing is passed over in silence: a record that is
cut off, has no length or is no record gives a row that says so in ``error``, and reading goes on at
the next one.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    WriterCommitMessage,
)

from ..plans.session import delete, shared_folder
from .cluster import checkpointed, salted_join

WRITTEN = "page_id long, url string, html string, record_type string, refers_to long, payload_digest string"
READ = (
    "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, "
    "refers_to long, record_id string, date string, content_encoding string, payload binary, error string"
)
#: Columns that a record's headers alone decide.
HEADER_COLUMNS = ("page_id", "record_type", "target_uri", "refers_to", "record_id", "date", "content_encoding")
#: Bytes of a file that make a partition.
SPLIT_BYTES = 64 << 20
#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
_MANIFEST = "_manifest-"
_MAGIC = b"\x1f\x8b\x08"


def _files(path: str) -> tuple[pafs.FileSystem, str]:
    local = re.match(r"file:/*(/.*)|(/.*)", path)
    return (pafs.LocalFileSystem(), local[1] or local[2]) if local else pafs.FileSystem.from_uri(path)


def gzip_member(data: bytes, level: int = 1) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    known = size if size < 1 << 32 and len(data) < 1 << 32 else 0
    head = _MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H2sHII", 12, b"sl", 8, known, len(data) if known else 0)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def warc_record(page_id, url, payload: bytes, record_type: str, refers_to, digest_hex: str, date: str) -> bytes:
    """A record with an HTTP response around the payload; a revisit has the headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if record_type == "response" else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if record_type == "revisit":
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:x-page:{refers_to}>")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Committed(WriterCommitMessage):
    def __init__(self, name: str, records: int, size: int):
        self.name, self.records, self.size = name, records, size


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.date = options["path"], options.get("date", "1970-01-01T00:00:00Z")
        self.level, self.overwrite = int(options.get("level", "1")), overwrite

    def write(self, iterator):
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        records = size = 0
        with files.open_output_stream(f"{folder}/{name}", compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    payload = (row["html"] or "").encode()
                    record = warc_record(row["page_id"], row["url"], payload, row["record_type"], row["refers_to"], row["payload_digest"], self.date)
                    member = gzip_member(record, self.level)
                    out.write(member)
                    records, size = records + 1, size + len(member)
        return _Committed(name, records, size)

    def commit(self, messages):
        files, folder = _files(self.path)
        files.create_dir(folder, recursive=True)
        listed = [{"name": m.name, "records": m.records, "size": m.size} for m in messages if m is not None]
        before = _manifests(files, folder) if self.overwrite else []
        manifest = f"{folder}/{_MANIFEST}{uuid.uuid4().hex}.json"
        with files.open_output_stream(f"{manifest}.part") as out:
            out.write(json.dumps(listed).encode())
        files.move(f"{manifest}.part", manifest)
        for old, names in before:
            files.delete_file(old)
            for x in names:
                files.delete_file(f"{folder}/{x['name']}")

    def abort(self, messages):
        files, folder = _files(self.path)
        for m in messages:
            if m is not None:
                files.delete_file(f"{folder}/{m.name}")


def _manifests(files: pafs.FileSystem, folder: str) -> list[tuple[str, list[dict]]]:
    """Paths of the archive's manifests, and the files that each lists."""
    found = []
    for info in files.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if re.fullmatch(_MANIFEST + r"\w+\.json", info.base_name):
            with files.open_input_stream(info.path) as f:
                found.append((info.path, json.loads(f.read())))
    return found


class _Range(InputPartition):
    def __init__(self, name: str, start: int, end: int):
        super().__init__(None)
        self.name, self.start, self.end = name, start, end


def _number(uri: str | None) -> int | None:
    found = re.search(r"urn:x-page:(-?\d+)", uri or "")
    return int(found[1]) if found else None


class WarcReader(DataSourceReader):
    """``payload`` option: ``bytes`` (returned), ``verify`` (decoded, and length and digest taken
    from it, but not returned) or ``skip`` (never decoded; length and digest from the headers)."""

    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "bytes")
        self.split = int(options.get("split", SPLIT_BYTES))
        self.wanted: list = []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, (EqualTo, In, IsNull, IsNotNull)) and len(f.attribute) == 1 and f.attribute[0] in HEADER_COLUMNS:
                self.wanted.append(f)
            else:
                yield f

    def partitions(self):
        files, folder = _files(self.path)
        manifests = _manifests(files, folder)
        if manifests:
            listed = sorted((x["name"], x["size"]) for _, names in manifests for x in names)
        else:
            found = files.get_file_info(pafs.FileSelector(folder))
            listed = sorted((f.base_name, f.size) for f in found if re.search(r"\.warc(\.gz)?$", f.base_name))
        step = lambda name, size: self.split if name.endswith(".gz") else max(size, 1)
        return [
            _Range(name, start, min(size, start + step(name, size)))
            for name, size in listed
            for start in range(0, size, step(name, size))
        ]

    def _accepts(self, row: dict) -> bool:
        for f in self.wanted:
            value = row[f.attribute[0]]
            if isinstance(f, IsNull):
                ok = value is None
            elif isinstance(f, IsNotNull):
                ok = value is not None
            else:
                ok = value is not None and (value == f.value if isinstance(f, EqualTo) else value in f.value)
            if not ok:
                return False
        return True

    def read(self, partition):
        if partition is None:  # an archive without files
            return
        files, folder = _files(self.path)
        names = [x.split()[0] for x in READ.split(", ")]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.string()] * 3, pa.binary(), pa.string()]
        rows, size = [], 0

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

        with files.open_input_file(f"{folder}/{partition.name}") as f:
            for row in scan(f, partition.start, partition.end, self._accepts, self.payload, partition.name.endswith(".gz")):
                rows.append(row)
                size += 200 + len(row["payload"] or b"")
                if size > 4 << 20:
                    yield batch()
                    rows, size = [], 0
        if rows:
            yield batch()


def scan(f, start: int, end: int, accepts, payload: str, gzipped: bool):
    """Records that start in [start, end) of a file (or, if it is packed, in gzip members that do) and
    whose headers are accepted."""
    at = _next_member(f, start, end) if gzipped and start else start
    while at is not None and at < end:
        stream = _Member(f, at) if gzipped else _Plain(f, at)
        yield from _records(stream, accepts, payload)
        at = stream.following(end)


_NOTHING = dict.fromkeys(x.split()[0] for x in READ.split(", "))


def _records(stream, accepts, payload: str):
    """The records of a stream that are accepted."""
    told = False
    while stream.next_record():
        if stream.passed:
            row = _NOTHING | {"error": f"{stream.passed} bytes that are no record"}
            if accepts(row):
                yield row
            if not stream.ready:
                return
        head = stream.until_blank()
        if head is None:
            row = _NOTHING | {"error": "headers without an end"}
            if accepts(row):
                yield row
            return
        row, http, left = _headers(stream, head)
        if not accepts(row):
            if stream.whole:
                return
            told |= left > stream.pass_over(left)
        elif row["error"]:
            yield row
        elif payload == "skip" or row["record_type"] == "revisit":
            missing = left - stream.pass_over(left)
            told |= missing > 0
            yield row | ({"error": f"cut off: {missing} bytes are missing"} if missing else {})
        else:
            data = stream.take(left)
            told |= len(data) < left
            yield _with_payload(row, data, left - len(data), payload, bool(re.search(r"(?im)^transfer-encoding:[^\r\n]*chunked", http or "")))
        if stream.whole:
            return
    if stream.broken() and not told:
        row = _NOTHING | {"error": "a gzip member that is damaged"}
        if accepts(row):
            yield row


def _headers(stream, head: bytes) -> tuple[dict, str | None, int]:
    """What the record's headers say of it, its HTTP headers, if it has any, and how much is left of it."""
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in re.split(r"\r?\n", head.decode("utf-8", "replace"))[1:])}
    size = warc.get("content-length", "")
    known = re.fullmatch(r"[0-9]{1,18}", size) is not None
    left, http = int(size) if known else 0, None
    if known and warc.get("content-type", "").startswith("application/http"):
        before = stream.taken
        http = stream.until_blank(left)
        left -= stream.taken - before
        http = http and http.decode("utf-8", "replace")
    length = re.search(r"(?im)^content-length:\s*(\d{1,18})\s*$", http or "")
    packed = re.search(r"(?im)^content-encoding:\s*([^\r\n]+)", http or "")
    row = {
        "page_id": _number(warc.get("warc-record-id")),
        "record_type": warc.get("warc-type"),
        "target_uri": warc.get("warc-target-uri"),
        "payload_bytes": (int(length[1]) if length else left) if known else None,
        "payload_digest": _sha1(warc.get("warc-payload-digest", "")),
        "refers_to": _number(warc.get("warc-refers-to")),
        "record_id": warc.get("warc-record-id", "").strip("<>") or None,
        "date": warc.get("warc-date"),
        "content_encoding": packed[1].strip().lower() if packed else None,
        "payload": None,
        "error": None if known else f"no length but {size!r}",
    }
    return row, http, left


def _sha1(digest: str) -> str | None:
    """A labelled digest as hexadecimal SHA-1, in base 32 or 16; None for others."""
    label, _, value = digest.partition(":")
    try:
        return {32: lambda: base64.b32decode(value.upper()).hex(), 40: lambda: bytes.fromhex(value).hex()}[len(value)]() if label.lower() == "sha1" else None
    except (KeyError, ValueError):
        return None


def _unchunked(data: bytes) -> bytes:
    """The body that came in chunks; as it is, if they are damaged."""
    parts, at = [], 0
    while (end := data.find(b"\r\n", at)) >= 0:
        size = re.match(rb"[0-9A-Fa-f]+", data[at:end])
        if not size:
            return data
        n, at = int(size[0], 16), end + 2
        if not n:
            return b"".join(parts)
        if len(data) < at + n:
            return data
        parts.append(data[at : at + n])
        at += n + 2
    return data


def _with_payload(row: dict, data: bytes, missing: int, payload: str, chunked: bool) -> dict:
    """A payload that is cut off comes as far as it goes, without a digest."""
    data = _unchunked(data) if chunked else data
    return row | {
        "payload_bytes": len(data),
        "payload_digest": None if missing else hashlib.sha1(data).hexdigest(),
        "payload": data if payload == "bytes" else None,
        "error": f"cut off: {missing} bytes are missing" if missing else None,
    }


class _Stream:
    """Decoded bytes, as far as they are asked for.  ``taken``: how many were; ``passed``: those before
    the record at hand that belong to none; ``whole``: one record is all there is."""

    def __init__(self):
        self.ready, self.taken, self.passed, self.whole = b"", 0, 0, False

    def more(self) -> bool:
        raise NotImplementedError

    def _drop(self, n: int) -> None:
        self.ready, self.taken = self.ready[n:], self.taken + n

    def next_record(self) -> bool:
        """Go to the next line that begins a record; False at the end."""
        self.passed = 0
        while True:
            blank = len(self.ready) - len(self.ready.lstrip(b"\r\n"))
            self._drop(blank)
            if len(self.ready) >= 5 or not self.more():
                break
        if self.ready.startswith(b"WARC/"):
            return True
        before = self.taken
        while (cut := self.ready.find(b"\nWARC/")) < 0:
            self._drop(max(0, len(self.ready) - 5))
            if not self.more():
                self._drop(len(self.ready))
                break
        else:
            self._drop(cut + 1)
        self.passed = self.taken - before
        return self.passed > 0

    def until_blank(self, limit: int | None = None) -> bytes | None:
        """All up to the next empty line, without it; None, and nothing taken, if there is none among
        the next ``limit`` bytes."""
        seen = 0
        while not (found := _BLANK.search(self.ready, max(0, seen - 3), len(self.ready) if limit is None else limit)):
            seen = len(self.ready)
            if (limit is not None and seen >= limit) or not self.more():
                return None
        head = self.ready[: found.start()]
        self._drop(found.end())
        return head

    def take(self, n: int) -> bytes:
        """``n`` bytes, or fewer at the end."""
        parts, have = [], 0
        while have < n and (self.ready or self.more()):
            parts.append(self.ready[: n - have])
            have += len(parts[-1])
            self._drop(len(parts[-1]))
        return b"".join(parts)

    def pass_over(self, n: int) -> int:
        """How many of ``n`` bytes there were."""
        have = 0
        while have < n and (self.ready or self.more()):
            step = min(n - have, len(self.ready))
            self._drop(step)
            have += step
        return have


_BLANK = re.compile(rb"\r?\n\r?\n")


class _Member(_Stream):
    """A gzip member; of one record, if it tells its length (subfield "sl")."""

    CHUNK = 1 << 16
    #: Packed bytes decoded at a time, which is what damage costs besides what follows it.
    PIECE = 1 << 10

    def __init__(self, f, at: int):
        super().__init__()
        self.f, self.at, self.read_to, self.read = f, at, at, b""
        self.unpack = zlib.decompressobj(31)
        self.size, self.damaged = 0, False
        f.seek(at)
        head = f.read(24)
        if head[:3] == _MAGIC and len(head) == 24 and head[3] & 4 and head[12:14] == b"sl":
            self.size = struct.unpack("<I", head[16:20])[0]
        self.whole = self.size > 0
        f.seek(at)

    def more(self) -> bool:
        while not self.damaged and not self.unpack.eof:
            data = self.unpack.unconsumed_tail
            if not data:
                if not self.read:
                    self.read = self.f.read(self.CHUNK if not self.size else max(0, min(self.CHUNK, self.at + self.size - self.read_to)))
                    self.read_to += len(self.read)
                data, self.read = self.read[: self.PIECE], self.read[self.PIECE :]
            if not data:
                return False
            try:
                out = self.unpack.decompress(data, self.CHUNK)
            except zlib.error:
                self.damaged = True
                return False
            if out:
                self.ready += out
                return True
        return False

    def pass_over(self, n: int) -> int:
        if not self.whole:
            return super().pass_over(n)
        # not decoded: it is there if the member's end is
        self.f.seek(0, 2)
        return n if self.at + self.size <= self.f.tell() else 0

    def broken(self) -> bool:
        return not self.unpack.eof

    def following(self, end: int) -> int | None:
        if self.size:
            return self.at + self.size
        while self.more():
            self.ready = b""
        if not self.unpack.eof:
            return _next_member(self.f, self.at + 1, end)
        # what some writers put between members
        at = self.read_to - len(self.read) - len(self.unpack.unused_data)
        self.f.seek(at)
        return at if self.f.read(3) == _MAGIC else _next_member(self.f, at, end)


class _Plain(_Stream):
    """An uncompressed file from a place on."""

    def __init__(self, f, at: int):
        super().__init__()
        self.f = f
        f.seek(0, 2)
        self.end = f.tell()
        f.seek(at)

    def more(self) -> bool:
        data = self.f.read(1 << 16)
        self.ready += data
        return bool(data)

    def pass_over(self, n: int) -> int:
        if n <= len(self.ready):
            return super().pass_over(n)
        left = n - len(self.ready)
        have = min(left, self.end - self.f.tell())
        self.f.seek(self.f.tell() + have)
        self.taken, self.ready = self.taken + len(self.ready) + have, b""
        return n - left + have

    def broken(self) -> bool:
        return False

    def following(self, end: int) -> None:
        return None


def _next_member(f, start: int, end: int) -> int | None:
    """The first member from ``start`` on that holds a record."""
    at, tail, base = start, b"", start
    f.seek(start)
    while at < end + 3:
        data = tail + f.read(1 << 20)
        if len(data) == len(tail):
            return None
        k = data.find(_MAGIC)
        while k >= 0:
            if base + k >= end:
                return None
            try:
                if zlib.decompressobj(31).decompress(_bytes_at(f, base + k, 4096), 5) == b"WARC/":
                    return base + k
            except zlib.error:
                pass
            k = data.find(_MAGIC, k + 1)
        base, tail = base + len(data) - 2, data[-2:]
        at = base
        f.seek(base + len(tail))
    return None


def _bytes_at(f, at: int, n: int) -> bytes:
    f.seek(at)
    return f.read(n)


class WarcSource(DataSource):
    """``spark.read.format("warc").option("path", ...)`` and the same for writing."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return READ

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read_warc(spark: SparkSession, path: str, payload: str = "bytes") -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", payload).load()


def as_records(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Pages with their record types: of equal payloads of ``least`` bytes or more the one with
    the largest page_id is the response and the others revisit it.

    A null html is an empty payload.  A null page_id revisits if another page has the payload,
    else it is a response; rows that repeat the largest page_id are all responses.  Pages are read
    whole, however long; an empty table has no records.
    """
    pages = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("payload_digest", F.sha1("html"))
    shared = (
        pages.where(F.octet_length("html") >= least)
        .groupBy("payload_digest")
        .agg(F.max("page_id").alias("kept"), F.count("*").alias("copies"))
        .where("copies > 1 AND kept IS NOT NULL")
    )
    revisits = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    # a page that very many addresses have is dealt over several tasks
    return salted_join(pages, shared, ["payload_digest"], F.struct("page_id", "url"), "left", salts=16).select(
        "page_id", "url", "html",
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("kept")).alias("refers_to"),
        "payload_digest",
    )


def write_warc(pages: DataFrame, path: str, mode: str = "append") -> None:
    """Archive pages (``page_id, url, html``) under ``path``, a folder that all machines share."""
    register(pages.sparkSession)
    as_records(pages).write.format("warc").mode(mode).option("path", path).save()


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write an archive of the pages into the cluster's shared folder and read it back.

    Takes ``page_id, url, html``; other columns are ignored.  Returns a row per page: ``page_id,
    payload_bytes, payload_digest`` (hexadecimal SHA-1; both taken from the decoded payload, or
    from a revisit's headers), ``record_type, refers_to, target_uri`` and the other columns that
    headers decide.  Responses are asked for with their payloads and everything else without, by
    filters on the type that the source takes over.  The archive is deleted once it is read.
    """
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    stored = read_warc(spark, path, payload="verify").where("record_type = 'response'")
    revisits = read_warc(spark, path, payload="skip").where("record_type = 'revisit'")
    rows = checkpointed(stored.drop("payload").union(revisits.drop("payload")))
    delete(spark, path)
    return rows
