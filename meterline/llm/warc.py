"""A content-addressed WARC archive: every payload is stored once, record headers are kept beside it.

``write`` takes records (page_id, url, header, payload; ``originals`` makes them from pages, ``read_files`` from
WARC files) and leaves in one folder

* gzip-compressed WARC files, a member per record: a ``response`` holds its header and payload, a ``revisit``
  names the response and has no payload. Of records of equal payload the one with the least page_id is the response.
* a table of the exact header of every original record, with the strong digest (SHA-256) of its payload,
* an index: file, offset and length of every record.

Payloads are shuffled once, by digest, and copies are dropped by each map task before that. Whatever joins copies
with their payload joins rows without payloads, and Spark splits a crowd of copies among tasks. A file counts only
if the stored index names it, so that a repeated or speculative task does no harm.
``originals_of`` puts every original record together again by a join on the digest, byte for byte; whenever a
payload is read, its SHA-256 must be the one it was stored under, else the job fails.

Defined cases: a null html or payload is an empty one; records without page_id come after all others, and
``refers_to`` is null where the response has none; rows that repeat page and payload are records of their own, one of
them the response; line breaks in a url are percent-encoded in the header and a null url has no header field; an
empty table gives an empty archive; other columns are ignored. Payloads of fewer than ``min_bytes`` are
responses throughout.
"""

from __future__ import annotations

import gzip
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path, store
from .common import columns, partitions

FILE_BYTES = 256_000_000
"""A task starts another file beyond this many bytes on disk."""
DATE = "1970-01-01T00:00:00Z"
_RECORD = "<urn:x-meterline:record:"
_FOUND = "rec long, name string, offset long, length long"


def base32_of_sha1(hexadecimal: Column) -> Column:
    """The bare base32 form of 40 hexadecimal digits: 20 bits give four digits."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, i, 5), 16, 32), 4, "0") for i in range(1, 40, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def target_uri(url: str) -> Column:
    """The header field of a url, '' for a null one."""
    line = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit("WARC-Target-URI: "), line, F.lit("\r\n")), F.lit(""))


def originals(pages: DataFrame, date: str = DATE) -> DataFrame:
    """(page_id, url, header, payload) with an HTTP response record for each row of ``pages``."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"),
    )
    size = F.octet_length("payload")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    header = F.concat(
        F.lit(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Date: {date}\r\nWARC-Record-ID: <urn:x-meterline:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none")),
        F.lit(">\r\n"), target_uri("url"), F.lit("WARC-Payload-Digest: sha1:"), base32_of_sha1(F.sha1("payload")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), size + F.octet_length(http), F.lit("\r\n\r\n"), http,
    )
    return rows.select("page_id", "url", header.cast("binary").alias("header"), "payload")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def _writer(folder: str):
    """Writes (rec, header, payload) as gzip members; gives where each record lies once its file is closed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        out, name, at, found = None, "", 0, []

        def close() -> pa.RecordBatch:
            out.close()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds, strict=True)], names=["rec", "name", "offset", "length"])

        for batch in batches:
            for rec, header, payload in columns(batch, "rec", "header", "payload"):
                if out is None:
                    system.create_dir(path, recursive=True)
                    name, at, found = f"records-{uuid.uuid4().hex}.warc.gz", 0, []
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(b"".join((header, payload, b"\r\n\r\n")), 4, mtime=0)
                out.write(member)
                found.append((rec, name, at, len(member)))
                at += len(member)
                if at >= FILE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[bytes, bytes]]:
    """(header, payload) of the records of a WARC stream; the header takes in an HTTP header, if there is one."""
    while True:
        header = []
        while (line := stream.readline()) not in (b"\r\n", b"\n"):
            if not line:
                if any(x.strip() for x in header):
                    raise ValueError("a record ends within its header")
                return
            header.append(line)
        if not header:
            continue  # the empty lines that follow a record
        head = b"".join([*header, line])
        size = int(re.search(rb"(?im)^Content-Length:\s*(\d+)", head)[1])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a record ends within its block")
        cut = block.find(b"\r\n\r\n") + 4 if re.search(rb"(?im)^Content-Type:\s*application/http", head) else 0
        cut = cut if cut >= 4 else 0
        yield head + block[:cut], block[cut:]


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = file_system(folder)
        for batch in batches:
            for (name,) in columns(batch, "name"):
                held, size = [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as raw:
                    zipped = name.lower().endswith(".gz")
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if zipped else raw, 1 << 20)
                    for header, payload in parse(stream):
                        held.append((name, header, payload))
                        size += len(header) + len(payload)
                        if size >= 8_000_000:
                            yield _rows(held)
                            held, size = [], 0
                if held:
                    yield _rows(held)

    return run


def _rows(held: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds, strict=True)], names=["name", "header", "payload"])


def read_files(names: DataFrame, folder: str) -> DataFrame:
    """(name, header, payload) of all records in the WARC files ``names`` (name) of a folder; a file is one task's stream."""
    spread = names.select("name").distinct().repartition(partitions(names.sparkSession))  # by turns: a key would let Spark keep them in one task
    return spread.mapInArrow(_reader(folder), "name string, header binary, payload binary")


@dataclass
class Archive:
    folder: str
    headers: DataFrame
    """rec, page_id, content, digest, record_type, refers_to, header: a row per original record."""
    index: DataFrame
    """rec, name, offset, length: where each record lies."""


def write(records: DataFrame, folder: str, min_bytes: int = 0) -> Archive:
    """Archives ``records`` (page_id, url, header, payload)."""
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    keys = store(records.select(
        F.monotonically_increasing_id().alias("rec"), "page_id", "url", "header", F.sha2(payload, 256).alias("digest"),
        F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size"),
    ), "warc-keys")
    keyed = keys.withColumn("content", F.when(F.col("size") >= min_bytes, F.col("digest")).otherwise(F.concat_ws("/", "digest", "rec")))
    first = keyed.groupBy("content").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "rec")).alias("first"))
    is_first = F.col("rec") == F.col("first.rec")
    headers = store(keyed.join(first, "content").select(
        "rec", "page_id", "url", "content", "digest", "sha1", "size", "header", F.when(is_first, "response").otherwise("revisit").alias("record_type"),
        F.when(~is_first, F.col("first.page_id")).alias("refers_to"), F.when(~is_first, F.col("first.rec")).alias("refers_rec"),
    ), "warc-headers")
    payloads = records.select(F.sha2(payload, 256).alias("digest"), payload.alias("payload")).groupBy("digest").agg(F.first("payload").alias("payload"))
    held = headers.where("record_type = 'response'").select("digest", "rec", "page_id", "sha1", "header")
    responses = payloads.join(held, "digest").select("rec", _stamped().alias("header"), "payload")
    revisits = headers.where("record_type = 'revisit'").select("rec", _revisit().alias("header"), F.lit(b"").alias("payload"))
    found = reduce(DataFrame.unionByName, [part.mapInArrow(_writer(folder), _FOUND) for part in (responses, revisits)])
    return Archive(folder, headers, store(found, "warc-index"))


_MARK = "X-Archive-Record: "


def _mark(role: str, page_id: Column, refers_to: Column, sha1: Column) -> Column:
    """A header line of this archive, the first after the version: number, role, page, page referred to, digest."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    return F.concat(F.lit(_MARK), F.concat_ws(" ", F.col("rec").cast("string"), F.lit(role), text(page_id), text(refers_to), base32_of_sha1(sha1)), F.lit("\r\n"))


def _stamped() -> Column:
    """The header of a stored response: the original one, and the mark behind its version line."""
    header, end = F.col("header"), F.locate("\n", F.decode("header", "ISO-8859-1"))
    mark = _mark("response", F.col("page_id"), F.lit(None), F.col("sha1"))
    return F.concat(F.substring(header, F.lit(1), end), mark.cast("binary"), F.substring(header, end + 1, F.octet_length(header)))


def _revisit() -> Column:
    return F.concat(
        F.lit("WARC/1.1\r\n"), _mark("revisit", F.col("page_id"), F.col("refers_to"), F.col("sha1")),
        F.lit(f"WARC-Type: revisit\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: {_RECORD}"), F.col("rec"),
        F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), target_uri("url"),
        F.lit(f"WARC-Refers-To: {_RECORD}"), F.col("refers_rec"), F.lit(">\r\nWARC-Payload-Digest: sha1:"), base32_of_sha1(F.col("sha1")),
        F.lit("\r\nContent-Length: 0\r\n\r\n"),
    ).cast("binary")


def stored(archive: Archive) -> DataFrame:
    """What the files hold: rec, record_type, page_id, refers_to, payload_digest (from the headers) and the payload."""
    mark = F.split(F.regexp_extract(F.decode("header", "ISO-8859-1"), rf"(?m)^{_MARK}([^\r\n]*)", 1), " ")
    part = {n: mark[i] for i, n in enumerate(("rec", "record_type", "page_id", "refers_to", "payload_digest"))}
    number = lambda n: F.nullif(part[n], F.lit("none")).cast("long").alias(n)
    return read_files(archive.index, archive.folder).select(
        number("rec"), part["record_type"].alias("record_type"), number("page_id"), number("refers_to"), part["payload_digest"].alias("payload_digest"), "payload"
    )


def _verified(payloads: DataFrame, headers: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns of the stored responses by ``content``, if every payload has the digest it is stored under."""
    held = headers.where("record_type = 'response'").select("rec", "content", "digest")
    good = F.when(F.col("found") == F.col("digest"), F.col("content")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), "digest")))
    return payloads.where("record_type = 'response'").select("rec", F.sha2("payload", 256).alias("found"), *kept).join(held, "rec").withColumn("content", good).drop("rec", "found", "digest")


def originals_of(archive: Archive) -> DataFrame:
    """(rec, page_id, record): every original record, header and payload, as it was before the archive."""
    payloads = _verified(stored(archive), archive.headers, F.col("payload"))
    return archive.headers.join(payloads, "content").select("rec", "page_id", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"))


def listing(archive: Archive) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, read back from the files. Bytes and
    digest are those of the payload that the record gets by its join, and the digest must be the one in its header."""
    found = store(stored(archive).select(
        "rec", "page_id", "record_type", "refers_to", "payload_digest", F.sha2("payload", 256).alias("found"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_sha1(F.sha1("payload")).alias("sha1"),
    ), "warc-found")
    held = archive.headers.select("rec", "content", "digest", "refers_rec")
    good = F.col("found") == F.col("digest")
    contents = found.where("record_type = 'response'").join(held, "rec").select(F.col("rec").alias("refers_rec"), "payload_bytes", "sha1", good.alias("good"))
    named = found.join(held.select("rec", "refers_rec"), "rec").select("page_id", "payload_digest", "record_type", "refers_to", F.coalesce("refers_rec", "rec").alias("refers_rec"))
    sound = F.col("good") & (F.col("payload_digest") == F.col("sha1"))
    digest = F.when(sound, F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest: "), "sha1")))
    return named.join(contents, "refers_rec").select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


def report(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    return listing(write(originals(pages), folder or scratch_path(pages.sparkSession, "warc"), min_bytes))
