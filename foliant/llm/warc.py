"""WARC archives: written and read by tasks, revisits resolved by payload digest.

Archives are files of gzip members, one per record, rolled at ``ARCHIVE_BYTES``.  A task
writes them under names of its own and passes on one header row per record (archive,
offset, length and what the header says); the table of these rows is what
counts, so a task that is run again or lost leaves at most files that no row
names.  Files are opened by URI (``pyarrow.fs``), streamed record by record.

Resolution: only headers are shuffled.  Responses of ``least_bytes`` or more give, by payload
digest and length, the one of largest id; that original is joined to all records with its
digest.  Digests of more than a ``HOT_SHARE``-th of all records are at most ``HOT_SHARE`` and are
broadcast; all others are joined by shuffle, so no task gets one digest's
rows beyond that share.

Deduplicated archives: the decisions lie by archive and offset; a task reads an archive
once, front to back, copies a response's payload under a fresh header and writes a
header (and the HTTP head, if there is one) alone for a revisit.  Payloads never leave the task that reads them.

Defined results: a null payload is the empty one; payloads below ``least_bytes`` are
responses each; equal payloads with the largest id several times: the one that sorts last
by archive and offset is the response; a null id is the smallest and is written as an
empty id; a null URI is written as an empty one; a revisit whose digest no response has stays a
revisit without an original; broken or cut records end their archive with a row whose
``error`` says so; an empty table gives no archive and no row.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import new_folder
from .staging import staged

#: Bytes after which a task begins its next archive, bytes read or inflated at once.
ARCHIVE_BYTES, CHUNK = 64 << 20, 1 << 18
#: Digests of more than one in so many records are joined by broadcast: there are no more than that.
HOT_SHARE = 1000
LEAST_BYTES = 1000
#: The profile of revisits with an identical payload, and the date of records that carry none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:foliant:"

HEADER = "archive string, offset long, length long, id string, uri string, type string, payload_bytes long, digest string, refers_to string, error string"
_NAMES = [c.split()[0] for c in HEADER.split(", ")]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"offset": pa.int64(), "length": pa.int64(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds.get(n, pa.string())) for i, n in enumerate(_NAMES)], names=_NAMES)


class Record(NamedTuple):
    """A record as it is written or was read: its block is an HTTP head (or nothing) and the payload."""

    kind: str
    id: str | None
    uri: str | None
    payload: bytes
    n_bytes: int | None
    digest: str | None
    refers_to: str | None = None
    head: bytes = b""
    date: str = NO_DATE
    media: str = "text/html"

    def header(self) -> bytes:
        """The fresh header, blank line included."""
        lines = ["WARC/1.1", f"WARC-Type: {self.kind}", f"WARC-Record-ID: {_ID}{self.id or ''}>", f"WARC-Target-URI: {(self.uri or '').translate({10: ' ', 13: ' '})}", f"WARC-Date: {self.date}", f"Content-Type: {self.media}"]
        if self.digest is not None:
            lines.append(f"WARC-Payload-Digest: sha1:{self.digest}")
        if self.kind == "revisit":
            lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_ID}{self.refers_to or ''}>"]
        return ("\r\n".join([*lines, f"Content-Length: {len(self.head) + len(self.payload)}"]) + "\r\n\r\n").encode()


class Writer:
    """Archives of one task: records as gzip members, a new file after ``ARCHIVE_BYTES``."""

    def __init__(self, folder: str, bytes_each: int = ARCHIVE_BYTES) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.base, self.bytes_each, self.out, self.made = folder, bytes_each, None, []

    def add(self, record: Record) -> None:
        if self.out is None:
            self.files.create_dir(self.folder)
            self.name, self.at = f"{uuid.uuid4().hex}.warc.gz", 0
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
        packer, began = zlib.compressobj(1, zlib.DEFLATED, 31), self.at
        for part in (record.header(), record.head, record.payload, b"\r\n\r\n"):
            self._write(packer.compress(part))
        self._write(packer.flush())
        self.made.append((f"{self.base}/{self.name}", began, self.at - began, record.id, record.uri, record.kind, record.n_bytes, record.digest, record.refers_to, None))
        if self.at >= self.bytes_each:
            self.close()

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None

    def taken(self) -> pa.RecordBatch:
        rows, self.made = self.made, []
        return _rows(rows)


def _members(stream) -> Iterator[tuple[int, int, list[bytes]]]:
    """(offset, length, parts) of each gzip member of a stream; raises ValueError on broken data."""
    at, data = 0, b""
    while True:
        data = data or stream.read(CHUNK)
        if not data:
            return
        unpacker, parts, began = zlib.decompressobj(31), [], at
        while not unpacker.eof:
            if not data:
                data = stream.read(CHUNK)
                if not data:
                    raise ValueError("record is cut")
            try:
                parts.append(unpacker.decompress(data))
            except zlib.error as e:
                raise ValueError(f"no gzip member: {e}") from e
            at += len(data) - len(unpacker.unused_data)
            data = unpacker.unused_data
        yield began, at - began, parts


def _parsed(parts: list[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields, lower-cased names, and the block of a record."""
    head, blank, block = b"".join(parts).partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not blank or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {name.strip().lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
    fields["version"] = lines[0]
    size = int(fields.get("content-length", "-1"))
    if size < 0 or len(block) < size:
        raise ValueError("record is shorter than its Content-Length")
    return fields, block[:size]


def _bare(id_: str | None) -> str | None:
    """A record id without its frame; None if there is none."""
    if id_ is None:
        return None
    return (id_.removeprefix(_ID).removesuffix(">") if id_.startswith(_ID) else id_) or None


def _record(fields: dict[str, str], block: bytes) -> Record:
    """The record of parsed fields; the digest is the payload's own, a revisit's the one it states."""
    kind, media, head = fields.get("warc-type", ""), fields.get("content-type", ""), b""
    if media.startswith("application/http"):
        head, blank, rest = block.partition(b"\r\n\r\n")
        head, block = (head + blank, rest) if blank else (block, b"")
    size, digest = None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if kind in ("response", "resource"):
        size, digest = len(block), hashlib.sha1(block).hexdigest()
    return Record(kind, _bare(fields.get("warc-record-id")), fields.get("warc-target-uri"), block, size, digest, _bare(fields.get("warc-refers-to")), head, fields.get("warc-date", NO_DATE), media)


def records(uri: str) -> Iterator[tuple[tuple, Record | None]]:
    """(header row, record) of each record of an archive; broken data end it with a row that has an error, and no record."""
    at = 0
    try:
        files, path = fs.FileSystem.from_uri(uri)
        with files.open_input_stream(path, compression=None) as stream:
            for at, length, parts in _members(stream):
                r = _record(*_parsed(parts))
                yield (uri, at, length, r.id, r.uri, r.kind, r.n_bytes, r.digest, r.refers_to, None), r
                at += length
    except (ValueError, OSError) as e:
        yield (uri, at, None, None, None, "error", None, None, None, str(e)), None


def write_archives(rows: DataFrame, id_: Column, uri: Column, payload: Column, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """One response record per row; the table of headers, of files below the shared folder."""
    spark, folder = rows.sparkSession, new_folder(rows.sparkSession, "warc")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, archive_bytes)
        for batch in batches:
            for at in range(batch.num_rows):
                data = batch.column(2)[at].as_py() or b""
                out.add(Record("response", batch.column(0)[at].as_py(), batch.column(1)[at].as_py(), data, len(data), hashlib.sha1(data).hexdigest()))
            yield out.taken()
        out.close()

    made = rows.select(id_.cast("string").alias("id"), uri.alias("uri"), payload.cast("binary").alias("payload"))
    return staged(made.mapInArrow(written, HEADER), "headers")


def read_headers(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The header rows of whole archives (column ``archive``: URIs); each file is streamed once by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found = []
                for row, _ in records(archive):
                    found.append(row)
                    if len(found) == 1000:
                        yield _rows(found)
                        found = []
                yield _rows(found)

    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return archives.select("archive").distinct().repartition(tasks, "archive").mapInArrow(read, HEADER)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(archive): the gzipped archives of a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("archive"))


def resolved(headers: DataFrame, least_bytes: int = LEAST_BYTES, order: Column | None = None) -> DataFrame:
    """Headers with ``original``, a struct (id, archive, offset, payload_bytes) of the response that holds the payload, else null.

    ``order`` says which of equal responses is the original: the largest; the default is the id as number.
    """
    order = F.expr("try_cast(id AS bigint)") if order is None else order
    rank = F.struct(order.alias("o"), "id", "archive", "offset", "payload_bytes")
    responses = headers.where((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes)).select("digest", rank.alias("r"))
    every = headers.where(F.col("digest").isNotNull()).groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = responses.groupBy("digest").agg(F.max("r").alias("r"))
    firsts = staged(firsts.join(every, "digest").select("digest", "n", F.struct("r.id", "r.archive", "r.offset", "r.payload_bytes").alias("original")), "originals")
    many = headers.count() / HOT_SHARE
    hot = firsts.where(F.col("n") > many).drop("n")  # at most HOT_SHARE rows
    cold = firsts.where(F.col("n") <= many).drop("n")
    rest = headers.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    found = headers.join(F.broadcast(hot), "digest").select(*headers.columns, "original").unionByName(rest.join(cold, "digest", "left").select(*headers.columns, "original"))
    fits = (F.col("type") == "revisit") | ((F.col("type") == "response") & (F.col("payload_bytes") >= least_bytes))
    return found.withColumn("original", F.when(fits, F.col("original")))


def deduplicated(headers: DataFrame, least_bytes: int = LEAST_BYTES, archive_bytes: int = ARCHIVE_BYTES, order: Column | None = None) -> DataFrame:
    """New archives in which a payload of ``least_bytes`` or more is stored once; the table of their headers."""
    spark, folder = headers.sparkSession, new_folder(headers.sparkSession, "warc")
    first = (F.col("original.archive") == F.col("archive")) & (F.col("original.offset") == F.col("offset"))
    target = F.when(F.col("original").isNotNull() & ~F.coalesce(first, F.lit(False)), F.coalesce("original.id", F.lit("")))
    plan = resolved(headers, least_bytes, order).where("error is null").select("archive", "offset", "type", target.alias("target"), F.col("original.payload_bytes").alias("full"))
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    plan = plan.repartition(tasks, "archive").sortWithinPartitions("archive", "offset")

    def rewritten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Writer(folder, archive_bytes)
        now, stream = None, iter(())
        for batch in batches:
            for archive, offset, target, full in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "target", "full")), strict=True):
                if archive != now:
                    now, stream = archive, records(archive)
                row, record = next((r for r in stream if r[0][1] >= offset), (None, None))
                if record is None or row[1] != offset:
                    raise ValueError(f"{archive} changed since its headers were read")
                if target is not None:
                    record = record._replace(kind="revisit", payload=b"", n_bytes=full, refers_to=target)
                out.add(record)
            yield out.taken()
        out.close()

    return staged(plan.mapInArrow(rewritten, HEADER), "headers")


def page_records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Archives of all pages, deduplicated and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    kind = pages.schema[page_id].dataType
    first = write_archives(pages, F.col(page_id), F.col(url), F.col(html))
    written = deduplicated(first, least_bytes)
    read = staged(read_headers(pages.sparkSession, written.select("archive")), "read")
    rows = resolved(read, least_bytes=0)
    size = F.when(F.col("type") == "revisit", F.col("original.payload_bytes")).otherwise(F.col("payload_bytes"))
    return rows.select(F.col("id").cast(kind).alias("page_id"), size.alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.when(F.col("type") == "revisit", F.col("refers_to").cast(kind)).alias("refers_to"))


ORACLE_SQL = """with p as (select page_id, url, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) b from pages),
r as (select *, max(page_id) over (partition by h) last from p)
select page_id, b::bigint payload_bytes, sha1(h) payload_digest, case when b >= 1000 and page_id <> last then 'revisit' else 'response' end record_type,
  case when b >= 1000 and page_id <> last then last end refers_to from r"""
