"""WARC archives as a Python data source: ``spark.read.format("warc").load(path)`` and ``df.write.format("warc")``.

Reading plans one partition per part of a file. Archives written here carry a table of contents with record offsets
every few megabytes, so large files are read in several parts; other archives are one part per file. Conditions on
the record type and on headers are pushed down: the header of a record is parsed first, and the payload of a record
that is not wanted is skipped by its length, not read or decoded. Payloads are not decoded either if the schema asks
for no payload column.

Writing keeps every record's parts in one file per task under a name of its own; the commit writes the table of
contents, which lists the files of successful tasks only, so files of lost tasks are never read.

Paths are resolved by pyarrow's file systems (local or mounted folders, and the object stores it knows), on the
executors; use a folder that all of them see.

Defined cases: null payloads are empty, null URIs leave the header out, line breaks in header values become blanks. An
empty table gives an archive without records. Archives of others: ``.warc.gz`` files are read member by member, forward
and as one part each. A record begins with a line ``WARC/``; where none is, or where a length is negative, no number or
reaches beyond the file, reading goes on at the next such line, so a damaged record costs itself only. A gzip member
that breaks off ends its file.
"""

from __future__ import annotations

import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from ..session import materialize, scratch_path
from .common import lookup

SCHEMA = """record_id string, record_type string, target_uri string, refers_to string, payload_digest string,
    content_length long, http_length long, headers map<string, string>, payload binary"""
#: The headers behind the columns.
FIELDS = {
    "record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri",
    "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest",
}
CONTENTS = "contents.json"
PART = 16 << 20
_BREAK = b"\r\n\r\n"
#: Fixed value: the profile of the standard for records that repeat an earlier payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and ":/" in path:  # file:/folder
        scheme, _, rest = path.partition(":")
        path = f"{scheme}://{rest}"
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    path: str
    start: int
    end: int | None


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    starts: list[int]


def parse_headers(block: bytes) -> dict[str, str]:
    """Names in lower case; lines that begin with a blank continue the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in block.split(b"\r\n"):
        if line[:1] in (b" ", b"\t") and name:
            out[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, found, value = line.partition(b":")
        if found:
            name = key.strip().lower().decode("utf-8", "replace")
            out[name] = value.strip().decode("utf-8", "replace")
    return out


class Unzipped:
    """Forward access to a gzip file of any number of members. What lies before the last mark is dropped."""

    def __init__(self, raw):
        self.raw, self.inflate = raw, zlib.decompressobj(31)
        self.held, self.start, self.place, self.marked, self.over = bytearray(), 0, 0, 0, False

    def size(self) -> int:
        return sys.maxsize  # known at the end only

    def mark(self, at: int) -> None:
        self.marked = at
        self._drop()

    def seek(self, at: int) -> None:
        self.place = at

    def _drop(self) -> None:
        gone = min(self.marked - self.start, len(self.held))
        if gone > 0:
            del self.held[:gone]
            self.start += gone

    def _more(self) -> None:
        data = self.inflate.unused_data if self.inflate.eof else b""
        if self.inflate.eof:
            self.inflate = zlib.decompressobj(31)
        data = data or self.raw.read(1 << 16)
        if not data:
            self.over = True
            return
        try:
            self.held += self.inflate.decompress(data)
        except zlib.error:
            self.over = True

    def read(self, n: int) -> bytes:
        while not self.over and self.start + len(self.held) < self.place + n:
            self._more()
            self._drop()
        at = self.place - self.start
        return bytes(self.held[at:at + n]) if at >= 0 else b""


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, path: str):
        self.path = path
        self.columns = [f.name for f in schema.fields]
        self.wanted: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]):
        """Takes conditions on the columns that come from headers; the others stay with Spark."""
        for f in filters:
            column = f.attribute
            name = FIELDS.get(column[0]) if len(column) == 1 else column[1] if column[0] == "headers" else None
            if name is None:
                yield f
            elif isinstance(f, (EqualTo, EqualNullSafe)):
                self.wanted.append((name, "in", (f.value,)))
            elif isinstance(f, In):
                self.wanted.append((name, "in", tuple(f.value)))
            elif isinstance(f, StringStartsWith):
                self.wanted.append((name, "starts", f.value))
            elif isinstance(f, (IsNotNull, IsNull)):
                self.wanted.append((name, "null", isinstance(f, IsNull)))
            else:
                yield f

    def partitions(self) -> list[Part]:
        fs, root = _open(self.path)
        info = fs.get_file_info(root)
        if info.type == pafs.FileType.File:
            return [Part(root, 0, None)]
        try:
            with fs.open_input_stream(f"{root}/{CONTENTS}") as file:
                listed = json.loads(file.read())
        except FileNotFoundError:
            found = fs.get_file_info(pafs.FileSelector(root, recursive=True))
            return [Part(f.path, 0, None) for f in found if f.path.endswith((".warc", ".warc.gz"))] or [Part("", 0, 0)]
        parts = [Part(f"{root}/{x['name']}", a, b)
                 for x in listed for a, b in zip(x["starts"], [*x["starts"][1:], x["size"]])]
        return parts or [Part("", 0, 0)]

    def _keeps(self, headers: dict[str, str]) -> bool:
        for name, kind, value in self.wanted:
            have = headers.get(name)
            if kind == "null":
                if (have is None) != value:
                    return False
            elif have is None and not (kind == "in" and None in value):
                return False
            elif kind == "in" and have not in value or kind == "starts" and not have.startswith(value):
                return False
        return True

    def read(self, partition: Part) -> Iterator[tuple]:
        if not partition.path:
            return
        fs, _ = _open(self.path)
        payloads = "payload" in self.columns
        if partition.path.endswith(".gz"):
            with fs.open_input_stream(partition.path, compression=None) as raw:
                yield from self._records(Unzipped(raw), 0, None, payloads)
        else:
            with fs.open_input_file(partition.path) as file:
                yield from self._records(file, partition.start, partition.end, payloads)

    def _records(self, file, at: int, end: int | None, payloads: bool) -> Iterator[tuple]:
        whole = file.size()
        end = whole if end is None else end
        mark = getattr(file, "mark", lambda at: None)
        while at < end:
            mark(at)
            head = _until_break(file, at, end) if _begins(file, at) else None
            headers = parse_headers(head) if head is not None else {}
            given = headers.get("content-length", "0")
            body = at + len(head or b"") + len(_BREAK)
            length = int(given) if given.isascii() and given.isdigit() and len(given) < 19 else -1
            if head is None or length < 0 or body + length > whole:
                at = _next_begin(file, at + 1, end, mark)
                continue
            at = body + length + len(_BREAK)
            if not self._keeps(headers):
                continue
            row = self._row(file, headers, body, length, payloads)
            if row is None:
                return
            yield row

    def _row(self, file, headers: dict[str, str], body: int, length: int, payloads: bool) -> tuple | None:
        """The row of a record, None if its payload breaks off."""
        http, start = {}, body
        if headers.get("content-type", "").startswith("application/http"):
            inner = _until_break(file, body, body + length)
            if inner is not None:
                http, start = parse_headers(inner), body + len(inner) + len(_BREAK)
        values = {c: headers.get(h) for c, h in FIELDS.items()}
        values["content_length"] = length
        values["http_length"] = int(http["content-length"]) if http.get("content-length", "").isdigit() else None
        values["headers"] = headers
        if payloads:
            file.seek(start)
            values["payload"] = file.read(body + length - start)
            if len(values["payload"]) < body + length - start:
                return None
        return tuple(values[c] for c in self.columns)


def _begins(file, at: int) -> bool:
    file.seek(at)
    return file.read(5) == b"WARC/"


def _next_begin(file, at: int, end: int, mark) -> int:
    """Where the next line begins that starts a record, or the end."""
    size = 1 << 16
    while at < end:
        mark(at)
        file.seek(at)
        block = file.read(min(size, end - at))
        found = block.find(b"\nWARC/")
        if found >= 0:
            return at + found + 1
        if len(block) < min(size, end - at) or len(block) <= 6:
            return end
        at += len(block) - 6
    return end


def _until_break(file, at: int, end: int) -> bytes | None:
    """The bytes before the next empty line."""
    size = 1024
    while True:
        file.seek(at)
        block = file.read(min(size, end - at))
        found = block.find(_BREAK)
        if found >= 0:
            return block[:found]
        if len(block) >= end - at or len(block) < size:
            return None
        size *= 4


def _line(value: object) -> str:
    return " ".join(str(value).split())


def record(row: Row) -> bytes:
    """One record. Responses carry their payload, revisits only the HTTP header that tells its length."""
    payload = bytes(row["payload"] or b"")
    revisit = row["record_type"] == "revisit"
    length = row["http_length"] if row["http_length"] is not None else len(payload)
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    if not revisit:
        block += payload
    lines = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_line(row['record_id'])}",
        "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_line(row['target_uri'])}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: {_line(row['refers_to'])}", f"WARC-Profile: {SAME_PAYLOAD}"]
    lines += [f"WARC-Payload-Digest: {row['payload_digest']}", "Content-Type: application/http;msgtype=response",
              f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _BREAK + block + _BREAK


class WarcWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        name, size, starts = f"part-{uuid.uuid4().hex}.warc", 0, []
        file = None
        for row in rows:
            if file is None:
                file = fs.open_output_stream(f"{root}/{name}")
            if not starts or size - starts[-1] >= PART:
                starts.append(size)
            data = record(row)
            file.write(data)
            size += len(data)
        if file is not None:
            file.close()
        return Written(name, size, starts)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        fs.create_dir(root, recursive=True)
        listed = [{"name": m.name, "size": m.size, "starts": m.starts} for m in messages if m and m.size]
        if not self.overwrite:
            try:
                with fs.open_input_stream(f"{root}/{CONTENTS}") as file:
                    listed = json.loads(file.read()) + listed
            except FileNotFoundError:
                pass
        with fs.open_output_stream(f"{root}/{CONTENTS}") as file:
            file.write(json.dumps(listed).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = _open(self.path)
        for m in messages:
            if m and m.size:
                fs.delete_file(f"{root}/{m.name}")


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known and let conditions reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_pages(
    pages: DataFrame, path: str, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> None:
    """One record per page. Of equal payloads of ``least`` bytes or more the smallest page_id's is the response and the
    others revisit it; rows that repeat that page_id and payload are responses too. Null ids come after all others."""
    page = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("target_uri"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))
    page = page.withColumn("digest", F.sha2("payload", 256)).withColumn("bytes", F.octet_length("payload").cast("long"))
    # Payloads that occur once need no partner; the others are a small table of digests.
    firsts = materialize(
        page.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1").select("digest", "first"), "warc-firsts")
    page = lookup(page, firsts, ["digest"], F.col("page_id"))
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    page.select(
        name(F.col("page_id")).alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
        F.when(revisit, name(F.col("first"))).alias("refers_to"),
        F.concat(F.lit("sha256:"), "digest").alias("payload_digest"),
        F.lit(0).cast("long").alias("content_length"), F.col("bytes").alias("http_length"),
        F.lit(None).cast("map<string, string>").alias("headers"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) from the archives.

    Responses are read with their payloads, whose digest and size are taken anew; revisits are read without.
    """
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    whole = spark.read.format("warc").load(path).where("record_type = 'response'").select(
        number(F.col("record_id")).alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    light = ", ".join(f"{c} {'long' if c == 'http_length' else 'string'}" for c in (*FIELDS, "http_length"))
    again = spark.read.format("warc").schema(light).load(path).where("record_type = 'revisit'").select(
        number(F.col("record_id")).alias("page_id"), F.col("http_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha256:", "").alias("payload_digest"), "record_type",
        number(F.col("refers_to")).alias("refers_to"))
    return whole.unionByName(again)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to an archive in the shared folder and read it back."""
    spark = pages.sparkSession
    register(spark)
    path = scratch_path(spark, "warc")
    write_pages(pages, path)
    return read_pages(spark, path)
