"""WARC archives as a Spark data source.

Writing: one gzip member per record, headers in a deflate block of their own, and the lengths of the member in a gzip extra
field ("sl"), so that a reader can step over a record without inflating its body.  A task writes under a hidden name; only
the files of tasks that were committed get their final names, so retried and speculative tasks leave nothing behind that is read.

Reading: files are listed on the driver and planned into partitions of about ``partitionBytes``: small files together, large
ones in byte ranges, each from the first record that begins in it to the first of a later range, whether members state their
lengths or not.  Predicates on the record type and on headers are pushed down; a record's headers are inflated first, and where
they fail a predicate, or the asked-for schema has no ``payload``, the body is stepped over undecoded.  With ``verify`` the
digest of each payload that is decoded is recomputed.

Defined results: a null payload is written as an empty one; a null header is left out and read as null; header values lose line
breaks; an empty folder or a table without rows reads as no rows; a damaged record raises an error that names file and offset, and
so does a gzip member that holds more than one record; columns that the format does not know become headers of that name (so
clashing names cannot overwrite the format's own fields).
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path

#: Columns that are header fields of the format.
NAMES = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "warc_date": "WARC-Date",
         "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "content_type": "Content-Type",
         "content_length": "Content-Length"}
SCHEMA = ("warc_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, "
          "content_type string, content_length long, headers map<string,string>, payload binary, file string, offset long")
_MEMBER = struct.Struct("<4sIBBH2sHII")
_GZIP = b"\x1f\x8b\x08"
_MAGIC = _GZIP + b"\x04"
_TEXT = b"WARC/"
_STORED = 65_535
_HEAD_STEP = 4096


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; local paths with or without a scheme, else any scheme that pyarrow knows."""
    if path.startswith("file:") or "://" not in path:
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(path)


# --- records -----------------------------------------------------------------------------------------------------------

def member(headers: dict[str, str], body: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {re.sub('[\r\n]+', ' ', v)}\r\n" for k, v in headers.items())
    head = f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode()
    squeeze = zlib.compressobj(6, zlib.DEFLATED, -15)
    packed = squeeze.compress(head) + squeeze.flush(zlib.Z_FULL_FLUSH) + squeeze.compress(body) + squeeze.compress(b"\r\n\r\n") + squeeze.flush()
    crc, size = zlib.crc32(b"\r\n\r\n", zlib.crc32(body, zlib.crc32(head))), len(head) + len(body) + 4
    whole = _MEMBER.size + len(packed) + 8
    if max(whole, size) >= 1 << 32:  # too long for the extra field: a plain member
        return struct.pack("<4sIBB", b"\x1f\x8b\x08\x00", 0, 0, 255) + packed + struct.pack("<II", crc, size & 0xFFFFFFFF)
    return _MEMBER.pack(_MAGIC, 0, 0, 255, 12, b"sl", 8, whole, size) + packed + struct.pack("<II", crc, size)


def parse_head(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip()] = value.strip()
    return out


class Records:
    """Records of one file from the first that begins at or after ``start`` to the last that begins before ``end``.

    Members that state no length, as other writers make them, are found by inflating what looks like one.
    """

    def __init__(self, handle: pa.NativeFile, size: int, start: int, end: int):
        self.f, self.size = handle, size
        self.at = self._first(start, end) if start else 0
        # where the next range with a record takes over: read up to there, so that nothing lies between two ranges
        self.end = min(end, size) if self.at >= end else self._first(end, size)

    def _read(self, at: int, n: int) -> bytes:
        return self.f.read_at(min(n, max(self.size - at, 0)), at)

    def _length(self, at: int) -> int | None:
        """Length of a member that states it, if one begins here."""
        raw = self._read(at, _MEMBER.size)
        if len(raw) < _MEMBER.size or raw[:4] != _MAGIC:
            return None
        _, _, _, _, extra, name, n, whole, _ = _MEMBER.unpack(raw)
        return whole if (extra, name, n) == (12, b"sl", 8) and at + whole <= self.size else None

    def _member_end(self, at: int) -> int | None:
        """End of the record's member that begins here: as it states, else found by inflating it to its checksum."""
        if whole := self._length(at):
            return at + whole
        inflate, pos, head = zlib.decompressobj(31), at, b""
        try:
            while not inflate.eof:
                raw = inflate.unconsumed_tail
                if not raw:
                    raw = self._read(pos, 1 << 16)
                    pos += len(raw)
                if not raw:
                    return None
                text = inflate.decompress(raw, 1 << 20)
                if len(head) < len(_TEXT):
                    head += text[:len(_TEXT)]
                    if not _TEXT.startswith(head[:len(_TEXT)]):
                        return None
        except zlib.error:
            return None
        return pos - len(inflate.unused_data) if head.startswith(_TEXT) else None

    def _begins(self, at: int) -> bool:
        """Whether a record begins here: members follow each other for longer than a copied archive inside of a record can (an
        uncompressed block of deflate has at most 65,535 bytes), or up to the end of the file."""
        k = at
        while k <= at + _STORED and k < self.size:
            end = self._member_end(k)
            if end is None or end <= k:
                return False
            k = end
        return k == self.size or self._read(k, len(_GZIP)) == _GZIP

    def _first(self, at: int, end: int) -> int:
        """First record that begins in ``at`` .. ``end``, else ``end``."""
        step = 1 << 16
        while at < end:
            raw = self._read(at, step + len(_GZIP) - 1)
            k = raw.find(_GZIP)
            while 0 <= k < min(step, end - at):
                if self._begins(at + k):
                    return at + k
                k = raw.find(_GZIP, k + 1)
            at += step
        return end

    def __iter__(self) -> Iterator[tuple[int, dict[str, str], "Body"]]:
        while self.at < self.end:
            body = Body(self, self.at, self._length(self.at))
            yield self.at, body.headers, body
            self.at = body.next_at()
        if self.at > self.end and self.end < self.size:
            raise ValueError(f"damaged record before offset {self.end}")


class Body:
    """Headers of a record, inflated at once, and its body, inflated when asked for."""

    def __init__(self, records: Records, at: int, whole: int | None):
        self.r, self.start, self.whole = records, at, whole
        self.inflate = zlib.decompressobj(-15 if whole else 31)
        self.pos, self.text = at + (_MEMBER.size if whole else 0), b""
        while b"\r\n\r\n" not in self.text:
            if not self._more(_HEAD_STEP, _HEAD_STEP):
                raise ValueError(f"damaged record at offset {at}")
        head, _, self.text = self.text.partition(b"\r\n\r\n")
        self.headers = parse_head(head)
        self.left = int(self.headers.get("Content-Length", 0))  # bytes of the block not yet taken

    def _more(self, n: int, limit: int = 0) -> bool:
        if self.inflate.eof:
            return False
        raw = self.inflate.unconsumed_tail
        if not raw:
            raw = self.r._read(self.pos, n)
            self.pos += len(raw)
        if not raw:
            return False
        self.text += self.inflate.decompress(raw, limit)
        return True

    def block(self) -> bytes:
        n = int(self.headers["Content-Length"])
        parts, have = [self.text], len(self.text)
        self.text = b""
        while have < n + 4 and self._more(1 << 20):
            parts.append(self.text)
            have += len(self.text)
            self.text = b""
        whole = b"".join(parts)
        if len(whole) < n:
            raise ValueError(f"record at offset {self.start} is cut short")
        self.text, self.left = whole[n:], 0
        return whole[:n]

    def payload(self) -> bytes:
        """The body without the HTTP headers, where there are any."""
        block = self.block()
        if self.headers.get("Content-Type", "").startswith("application/http"):
            return block.partition(b"\r\n\r\n")[2]
        return block

    def next_at(self) -> int:
        if self.whole:
            return self.start + self.whole
        skip, rest = self.left, b""
        while True:
            if len(rest) < 64:
                rest += self.text[skip:skip + 64]
            skip, self.text = max(0, skip - len(self.text)), b""
            if not self._more(1 << 20, 1 << 20):
                break
        if rest.lstrip().startswith(_TEXT):
            raise ValueError(f"the member at offset {self.start} holds more than one record")
        return self.pos - len(self.inflate.unused_data)


# --- data source -------------------------------------------------------------------------------------------------------

@dataclass
class FileRanges(ds.InputPartition):
    """Byte ranges of files: (path, size, start, end)."""

    ranges: list[tuple[str, int, int, int]] = field(default_factory=list)

    def __post_init__(self):
        super().__init__(None)


def plan_ranges(sizes: list[tuple[str, int]], limit: int) -> list[list[tuple[str, int, int, int]]]:
    """Files cut into ranges of at most ``limit`` bytes, and these put together up to ``limit``."""
    out, held, total = [], [], 0
    for path, size in sorted(sizes):
        parts = max(1, -(-size // limit))
        for k in range(parts):
            a, b = size * k // parts, size * (k + 1) // parts
            if held and total + b - a > limit:
                out.append(held)
                held, total = [], 0
            held.append((path, size, a, b))
            total += b - a
    return [*out, held] if held else out


_COMPARE = {ds.EqualTo: lambda x, v: x == v, ds.GreaterThan: lambda x, v: x > v, ds.GreaterThanOrEqual: lambda x, v: x >= v,
            ds.LessThan: lambda x, v: x < v, ds.LessThanOrEqual: lambda x, v: x <= v,
            ds.StringStartsWith: lambda x, v: x.startswith(v), ds.StringEndsWith: lambda x, v: x.endswith(v),
            ds.StringContains: lambda x, v: v in x, ds.In: lambda x, v: x in v}


def _header_value(headers: dict[str, str], column: str):
    got = headers.get(NAMES[column])
    return int(got) if got is not None and column == "content_length" else got


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.limit = int(options.get("partitionbytes", options.get("partitionBytes", 64 << 20)))
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column in NAMES and (type(f) in _COMPARE or isinstance(f, (ds.IsNotNull, ds.IsNull))):
                self.tests.append((column, type(f).__name__, getattr(f, "value", None)))
            else:
                yield f

    def partitions(self):
        system, folder = open_folder(self.path)
        found = system.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True))
        sizes = [(x.path, x.size) for x in found if x.is_file and x.size and not x.base_name.startswith((".", "_"))]
        return [FileRanges(r) for r in plan_ranges(sizes, self.limit)] or [FileRanges([])]

    def _wanted(self, headers: dict[str, str]) -> bool:
        for column, kind, value in self.tests:
            got = _header_value(headers, column)
            if kind == "IsNull":
                ok = got is None
            elif kind == "IsNotNull":
                ok = got is not None
            else:
                ok = got is not None and _COMPARE[getattr(ds, kind)](got, value)
            if not ok:
                return False
        return True

    def read(self, partition):
        system, _ = open_folder(self.path)
        names = [f.name for f in self.schema]
        with_payload = "payload" in names
        for path, size, start, end in partition.ranges:
            with system.open_input_file(path) as handle:
                for at, headers, body in Records(handle, size, start, end):
                    if not self._wanted(headers):
                        continue
                    payload = body.payload() if with_payload else None
                    if self.verify and with_payload and headers.get("WARC-Type") == "response":
                        if headers.get("WARC-Payload-Digest") != f"sha1:{base32_sha1(payload)}":
                            raise ValueError(f"digest of the record at offset {at} of {path} does not fit its payload")
                    own = {"headers": headers, "payload": payload, "file": path, "offset": at}
                    yield tuple(own[n] if n in own else _header_value(headers, n) if n in NAMES else headers.get(n) for n in names)


@dataclass
class Written(ds.WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], [f.name for f in schema]
        self.roll = int(options.get("fileBytes", options.get("filebytes", 512 << 20)))

    def write(self, iterator):
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        files, out, size = [], None, 0
        fields = [n for n in self.names if n not in ("payload", "content_length", "content_type", "headers", "file", "offset")]
        for batch in iterator:
            for row in batch.select([n for n in self.names if n in (*fields, "payload")]).to_pylist():
                if out is None or size > self.roll:
                    if out is not None:
                        out.close()
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    files.append((f"{folder}/.{name}", f"{folder}/{name}"))
                    out, size = system.open_output_stream(files[-1][0], compression=None), 0
                payload = row.get("payload") or b""
                headers = {NAMES.get(n, n): str(row[n]) for n in fields if row[n] is not None}
                headers["Content-Type"] = "application/http; msgtype=response"
                record = member(headers, b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload)
                out.write(record)
                size += len(record)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages):
        system, folder = open_folder(self.path)
        system.create_dir(folder, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        for hidden, final in files:
            system.move(hidden, final)
        with system.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"files": len(files)}).encode())

    def abort(self, messages):
        system, _ = open_folder(self.path)
        for hidden, _ in [f for m in messages if m is not None for f in m.files]:
            if system.get_file_info(hidden).is_file:
                system.delete_file(hidden)


class WarcSource(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), schema)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, schema: str = SCHEMA, **options: str) -> DataFrame:
    """Records of the archives in a folder; a schema without ``payload`` leaves all bodies undecoded."""
    register(spark)
    return spark.read.format("warc").schema(schema).options(path=path, **options).load()


def write_warc(df: DataFrame, path: str, **options: str) -> None:
    """Write ``df`` (columns named as in ``SCHEMA``, others become headers) as archives."""
    register(df.sparkSession)
    df.write.format("warc").mode("append").options(path=path, **options).save()


# --- pages: one response per payload, revisits of it -------------------------------------------------------------------

def page_records(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Records to write.  Of equal payloads of at least ``min_bytes`` that of the largest id is the response, the others revisit it.

    A null id is never the largest; rows that repeat an id and its payload are alike, so all of them are responses or none is.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(uri_col).cast("string").alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    last = rows.where(F.octet_length("payload") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("last"))
    rows = rows.join(last, "sha1", "left")
    original = F.col("last").isNull() | F.col("last").eqNullSafe(F.col("page_id"))
    record = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    return rows.select(
        F.when(original, "response").otherwise("revisit").alias("warc_type"), record(F.col("page_id")).alias("record_id"), "target_uri",
        F.lit("1970-01-01T00:00:00Z").alias("warc_date"), F.when(~original, record(F.col("last"))).alias("refers_to"),
        F.col("sha1").alias("X-Payload-SHA1"), F.col("page_id").cast("string").alias("X-Page-Id"), F.when(original, F.col("payload")).alias("payload"))


def with_digest(records: DataFrame) -> DataFrame:
    """Hex digests as the format writes them: base32 with the name of the algorithm."""
    names = [c for c in records.columns if c != "X-Payload-SHA1"]

    def run(batches):
        for batch in batches:
            hexes = batch.column("X-Payload-SHA1").to_pylist()
            digest = pa.array([f"sha1:{base64.b32encode(bytes.fromhex(h)).decode()}" for h in hexes], pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], digest], names=[*names, "payload_digest"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in records.schema if f.name in names)
    return records.mapInArrow(run, f"{fields}, payload_digest string")


def archive_round_trip(pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write pages as archives, read them back, and return ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(with_digest(page_records(pages, id_col, uri_col, html_col, min_bytes)), path)
    bare = lambda c: F.regexp_replace(c, "^sha1:", "")
    page = F.col("`X-Page-Id`").cast("long").alias("page_id")
    head = "warc_type string, record_id string, payload_digest string, refers_to string, `X-Page-Id` string"
    responses = read_warc(spark, path, f"{head}, payload binary", verify="true").where(F.col("warc_type") == "response")
    responses = materialize(responses.select(page, "record_id", F.octet_length("payload").cast("long").alias("payload_bytes"),
                                             bare(F.col("payload_digest")).alias("payload_digest")), "responses")
    revisits = read_warc(spark, path, head).where(F.col("warc_type") == "revisit").select(
        page, F.col("refers_to").alias("record_id"), bare(F.col("payload_digest")).alias("own_digest"))
    # a page that occurs with several payloads has a response of each, all under one record id
    target = responses.select("record_id", "payload_bytes", "payload_digest", F.col("page_id").alias("refers_to")).dropDuplicates(
        ["record_id", "payload_digest"])
    found = revisits.withColumnRenamed("own_digest", "payload_digest").join(target, ["record_id", "payload_digest"])
    return responses.select("page_id", "payload_bytes", "payload_digest", F.lit("response").alias("record_type"),
                            F.lit(None).cast("long").alias("refers_to")).unionByName(
        found.select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to"))
