"""WARC archives: a Python data source that writes and reads them, and deduplicated records.

The writer makes one gzip member a record, so a record can be read by its offset. A member's
header carries the extra field `sl` of the WARC standard, its lengths packed and unpacked:
the reader unpacks only as much of a member as the record's header takes and, where a filter drops the
record or nobody wants its payload, goes on at the next member. Tasks write hidden files;
the commit gives them their names, so those of lost attempts are never read.

The reader plans one partition per group of files, takes filters on the record type and
on the header columns it was asked for, and reads a record's header first. It also reads
plain archives and such as are one gzip stream.
"""

from __future__ import annotations

import contextlib
import gzip
import io
import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not, StringStartsWith, WriterCommitMessage

from . import common as C

END = "\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"
#: Payloads of fewer bytes are always written whole.
LEAST_BYTES = 100
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
ROWS, BYTES = 2000, 16_000_000
#: Bytes that are read to look for a record's header, at a time.
PEEK = 4096


def _header(name: str, value: Column) -> Column:
    """``name: value`` with its line end; nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"\r\n{name}: "), F.regexp_replace(value.cast("string"), r"[\r\n]+", " ")), F.lit(""))


def with_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to).

    Of equal payloads of `least` bytes or more the smallest page_id is the response. A null
    html is an empty payload; a null page_id is never the smallest unless there is no other;
    repeated rows of the smallest page_id are all responses.
    """
    body = F.coalesce("html", F.lit(""))
    base = pages.select("page_id", "url", body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    # Which rows are revisits is found on ids and digests; payloads meet the answer by id and digest, so no digest is hot.
    keys = base.where(F.col("payload_bytes") >= least).select("page_id", "payload_digest")
    first = keys.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    again = keys.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("first"))).select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "first").distinct()
    out = base.join(again, base["page_id"].eqNullSafe(again["_page"]) & (base["payload_digest"] == again["_digest"]) & (base["payload_bytes"] >= least), "left")
    return out.select(*base.columns, F.when(F.col("first").isNotNull(), "revisit").otherwise("response").alias("record_type"), F.col("first").alias("refers_to"))


def record_id(page: Column, digest: Column) -> Column:
    """The id of the response that revisits refer to."""
    return F.regexp_replace(F.md5(F.concat_ws(" ", page.cast("string"), digest)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def write_warc(records: DataFrame, path: str) -> None:
    """Write the rows of with_revisits() as gzipped WARC/1.0 records, a member each, below path.

    A response that can be referred to has the id that its page and digest name, once a task; all
    others, repeated rows among them, get an id of their own.
    """
    revisit = F.col("record_type") == "revisit"
    payload = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    named = (F.col("record_type") == "response") & F.col("page_id").isNotNull() & (F.col("payload_bytes") >= LEAST_BYTES)
    head = F.concat(
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To", F.when(revisit, record_id(F.col("refers_to"), F.col("payload_digest")))),
        _header("X-Page-Id", F.col("page_id")),
        _header("X-Refers-To-Page", F.col("refers_to")),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
    )
    rows = records.select(
        F.col("record_type"),
        F.when(named, record_id(F.col("page_id"), F.col("payload_digest"))).alias("record_id"),
        head.alias("head"),
        F.concat(http, payload).cast("binary").alias("block"),
    )
    spark = records.sparkSession
    spark.dataSource.register(WarcDataSource)
    rows.write.format("warc").mode("append").option("path", path).save()


def member(record: bytes) -> bytes:
    """A gzip member with the extra field `sl`."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(record) + packer.flush()
    size = 10 + 2 + 12 + len(body) + 8
    lengths = struct.pack("<HccHII", 12, b"s", b"l", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + lengths + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


class Store:
    """Files of the local or of any store that Arrow knows."""

    def __init__(self, path: str):
        if path.startswith("file:") or "://" not in path:
            self.fs, self.top = None, "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path
        else:
            from pyarrow import fs

            self.fs, self.top = fs.FileSystem.from_uri(path)

    def reader(self):
        if self.fs is None:
            return open(self.top, "rb", buffering=1 << 20)
        return io.BufferedReader(self.fs.open_input_file(self.top), 1 << 20)

    def writer(self, name: str):
        if self.fs is None:
            os.makedirs(self.top, exist_ok=True)
            return open(f"{self.top}/{name}", "wb", buffering=1 << 20)
        self.fs.create_dir(self.top, recursive=True)
        return self.fs.open_output_stream(f"{self.top}/{name}")

    def rename(self, name: str, new: str) -> None:
        (os.replace if self.fs is None else self.fs.move)(f"{self.top}/{name}", f"{self.top}/{new}")

    def remove(self, name: str) -> None:
        with contextlib.suppress(FileNotFoundError):
            (os.remove if self.fs is None else self.fs.delete_file)(f"{self.top}/{name}")


@dataclass
class Written(WriterCommitMessage):
    name: str


class WarcWriter(DataSourceArrowWriter):
    """Rows (record_type, record_id, head, block) as one archive a task."""

    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, name, used, out = Store(self.path), f".{uuid.uuid4().hex}.warc.gz", set(), None
        for batch in iterator:
            for r in batch.to_pylist():
                out = out or store.writer(name)
                own = r["record_id"]
                if own is None or own in used:
                    own = f"<urn:uuid:{uuid.uuid4()}>"
                used.add(own) if r["record_id"] else None
                start = f"WARC/1.0\r\nWARC-Type: {r['record_type']}\r\nWARC-Record-ID: {own}{r['head']}\r\nContent-Length: {len(r['block'])}{END}"
                out.write(member(start.encode() + r["block"] + END.encode()))
        if out:
            out.close()
        return Written(name if out else "")

    def commit(self, messages: list) -> None:
        store = Store(self.path)
        for m in messages:
            if m and m.name:
                store.rename(m.name, "part-" + m.name[1:])

    def abort(self, messages: list) -> None:
        store = Store(self.path)
        for m in messages:
            if m and m.name:
                store.remove(m.name)


# ------------------------------------------------------------------- reading


@dataclass
class FileGroup(InputPartition):
    files: tuple[str, ...]


def _skip(f, n: int) -> None:
    """Go on n bytes; these must be there."""
    if n:
        f.seek(n - 1, 1)
        if len(f.read(1)) < 1:
            raise ValueError("a WARC record is cut short")


def _headers(lines: Iterable[bytes]) -> dict[str, str]:
    """Headers by lower-case name."""
    headers: dict[str, str] = {}
    last = ""
    for line in lines:
        if line[:1] in b" \t" and last:  # a folded line
            headers[last] += " " + line.decode("utf-8", "replace").strip()
            continue
        name, _, value = line.decode("utf-8", "replace").partition(":")
        last = name.strip().lower()
        headers[last] = value.strip()
    return headers


def _payload(headers: dict[str, str], block: bytes) -> bytes:
    if len(block) < int(headers.get("content-length", 0)):
        raise ValueError("a WARC record is cut short")
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


Found = Iterator[tuple[dict[str, str], bytes | None]]


def records(f, wanted: Callable[[dict[str, str]], bool], with_payload: bool) -> Found:
    """(headers by lower-case name, payload) of the records of an unpacked stream that wanted(headers) keeps."""
    while True:
        line = f.readline()
        while line in (b"\r\n", b"\n"):
            line = f.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {f.tell() - len(line)}: {line[:40]!r}")
        headers = _headers(_lines(f))
        size = int(headers.get("content-length", 0))
        if not wanted(headers):
            _skip(f, size)
        elif not with_payload:
            _skip(f, size)
            yield headers, None
        else:
            yield headers, _payload(headers, f.read(size))


def _lines(f) -> Iterator[bytes]:
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        yield line


def packed_size(f) -> int | None:
    """The length of the gzip member that begins here, from its field `sl`; None without one. f stays where it is."""
    at = f.tell()
    head = f.read(12)
    size = None
    if len(head) == 12 and head[:3] == b"\x1f\x8b\x08" and head[3] & 4:
        extra = f.read(struct.unpack("<H", head[10:])[0])
        while len(extra) >= 4:
            n = struct.unpack("<H", extra[2:4])[0]
            if extra[:2] == b"sl" and n == 8:
                size = struct.unpack("<I", extra[4:8])[0]
            extra = extra[4 + n :]
    f.seek(at)
    return size


def members(f, size: int, wanted: Callable[[dict[str, str]], bool], with_payload: bool) -> Found:
    """records() of a packed file of `size` bytes whose members are one record each; other blocks than wanted ones are never unpacked."""
    at = f.tell()
    while at < size:
        packed = packed_size(f)
        if packed is None:
            yield from records(gzip.GzipFile(fileobj=f), wanted, with_payload)
            return
        if at + packed > size:
            raise ValueError("a WARC record is cut short")
        unpack, text, left = zlib.decompressobj(31), b"", packed
        while (cut := text.find(b"\r\n\r\n")) < 0 and left:
            part = f.read(min(PEEK, left))
            left -= len(part)
            text += unpack.decompress(part)
        if cut < 0 or not text.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {at}: {text[:40]!r}")
        headers = _headers(text[:cut].split(b"\r\n")[1:])
        if wanted(headers):
            if with_payload:
                text += unpack.decompress(f.read(left)) + unpack.flush()
                if not unpack.eof:
                    raise ValueError("a WARC record is cut short")
                yield headers, _payload(headers, text[cut + 4 : cut + 4 + int(headers.get("content-length", 0))])
            else:
                yield headers, None
        at += packed
        f.seek(at)


def file_records(path: str, wanted: Callable[[dict[str, str]], bool], with_payload: bool) -> Found:
    """records() of a plain or packed archive."""
    with Store(path).reader() as f:
        if path.endswith(".gz"):
            size = f.seek(0, 2)
            f.seek(0)
            yield from members(f, size, wanted, with_payload)
        else:
            yield from records(f, wanted, with_payload)


class WarcReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]):
        self.files = [x for x in options.get("files", "").split("\n") if x]
        self.columns = [f.name for f in schema.fields if f.name not in ("record_type", "payload")]
        self.with_payload = any(f.name == "payload" for f in schema.fields)
        self.per_partition = int(options.get("filesPerPartition", 1))
        self.names = [f.name for f in schema.fields]
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            inner, no = (f.child, True) if isinstance(f, Not) else (f, False)
            known = getattr(inner, "attribute", None)
            name = known[0] if known and len(known) == 1 else None
            if name is None or name == "payload" or name not in self.names:
                yield f
            elif isinstance(inner, EqualTo):
                self.tests.append((name, "not in" if no else "in", (inner.value,)))
            elif isinstance(inner, In):
                self.tests.append((name, "not in" if no else "in", tuple(inner.value)))
            elif isinstance(inner, StringStartsWith) and not no:
                self.tests.append((name, "starts", inner.value))
            elif isinstance(inner, IsNotNull) and not no:
                self.tests.append((name, "there", None))
            else:
                yield f

    def partitions(self) -> list[FileGroup]:
        n = self.per_partition
        return [FileGroup(tuple(self.files[i : i + n])) for i in range(0, len(self.files), n)] or [FileGroup(())]

    def wanted(self, headers: dict[str, str]) -> bool:
        for name, how, value in self.tests:
            own = headers.get("warc-type" if name == "record_type" else name.lower())
            if own is None:
                return False
            if how == "in" and own not in value or how == "not in" and own in value or how == "starts" and not own.startswith(value):
                return False
        return True

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for path in partition.files:
            for headers, payload in file_records(path, self.wanted, self.with_payload):
                rows.append((headers, payload))
                size += len(payload or b"")
                if len(rows) >= ROWS or size >= BYTES:
                    yield self.batch(rows)
                    rows, size = [], 0
        if rows:
            yield self.batch(rows)

    def batch(self, rows: list) -> pa.RecordBatch:
        out = []
        for name in self.names:
            if name == "payload":
                out.append(pa.array([p for _, p in rows], pa.binary()))
            else:
                key = "warc-type" if name == "record_type" else name.lower()
                out.append(pa.array([h.get(key) for h, _ in rows], pa.string()))
        return pa.RecordBatch.from_arrays(out, self.names)


class WarcDataSource(DataSource):
    """format("warc"). To read: options files (one a line), headers (comma-separated, become string columns), payload (true or false), filesPerPartition. To write: path."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        names = ["record_type", *[x.strip() for x in self.options.get("headers", "").split(",") if x.strip()]]
        fields = [T.StructField(n, T.StringType()) for n in names]
        if self.options.get("payload", "true").lower() == "true":
            fields.append(T.StructField("payload", T.BinaryType()))
        return T.StructType(fields)

    def reader(self, schema: T.StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"])


def list_files(spark: SparkSession, path: str) -> list[str]:
    """The data files below path, by Spark's own file system layer; none if it is not there."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(path)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    found, it = [], fs.listFiles(top, True)
    while it.hasNext():
        x = it.next()
        if x.getLen() and x.getPath().getName()[0] not in "._":
            found.append(x.getPath().toString())
    return sorted(found)


def read_warc(spark: SparkSession, path: str, headers: Iterable[str] = (), payload: bool = True) -> DataFrame:
    """record_type, a string column for each header asked for, and the payload if wanted. No files: no rows.

    Sets spark.sql.python.filterPushdown.enabled, which has to hold when the query is planned.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    reader = spark.read.format("warc").option("files", "\n".join(list_files(spark, path)))
    return reader.option("headers", ",".join(headers)).option("payload", str(payload).lower()).load()


def archived(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): pages written as WARC and read back.

    Size and digest of a response are taken from the payload read back, those of a revisit,
    whose block is never decoded, from its header.
    """
    spark = pages.sparkSession
    path = C.new_path(spark, "warc")
    write_warc(with_revisits(pages), path)
    kind = pages.schema["page_id"].dataType
    page = F.col("X-Page-Id").cast(kind).alias("page_id")
    full = read_warc(spark, path, ("X-Page-Id",)).where("record_type = 'response'")
    full = full.select(page, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast(kind).alias("refers_to"))
    again = read_warc(spark, path, ("X-Page-Id", "X-Refers-To-Page", "X-Payload-Length", "WARC-Payload-Digest"), payload=False).where("record_type = 'revisit'")
    again = again.select(
        page,
        F.col("X-Payload-Length").cast("long").alias("payload_bytes"),
        F.regexp_replace("WARC-Payload-Digest", "^sha256:", "").alias("payload_digest"),
        "record_type",
        F.col("X-Refers-To-Page").cast(kind).alias("refers_to"),
    )
    return full.unionByName(again)
