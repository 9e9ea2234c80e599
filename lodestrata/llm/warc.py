"""Writing and reading WARC archives, with repeated payloads kept once.

Revisit resolution: headers (record, URL, digest, length) are reduced by payload digest to the smallest record id of each
payload that occurs at least twice, and joined back; a record whose payload another one holds becomes a *revisit* record
without payload, whose fresh header names the original and its URL. Only headers meet by digest, partial sums first, and
the join is proof against a payload that a third of all records share. Payloads are shuffled once, by record, to meet
their verdict.

Records are WARC/1.1: a response's block is an HTTP head and the payload, a revisit's only the head. Archives are written
by Spark as text with ``\\r\\n\\r\\n`` between records (payloads are UTF-8, so this is byte for byte what they hold),
gzipped by default as one member a file; they lie in a folder that all executors share. There is no ``warcinfo`` record.
Files are bounded by bytes: records are written by size classes, each with as many to a file as ``FILE_BYTES`` allows at
the class's greatest size; a larger record has a file of its own. Reading unzips a file in a stream, cuts it by
Content-Length, so payloads may hold anything, and hands on ``BATCH_BYTES`` at a time.

A null payload is empty. Repeated rows with one id give a record each, of the same record id: the smallest id holds the
payload, and its other rows with the same payload are responses too. Null ids are written as ``-`` and read as null; they
are never an original if another row has an id. Very long payloads are held whole, one at a time. An empty table gives no
archives and no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import io
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keyed_join, shared_dir, stored

VERSION = "WARC/1.1"
END = "\r\n\r\n"
#: Payloads of fewer bytes aren't worth a revisit record.
LEAST_BYTES = 100
#: The most bytes of records in a file, before compression, and the bytes at which size classes end.
FILE_BYTES = 64 << 20
CLASS_BYTES = (1 << 14, 1 << 18, 1 << 22, 1 << 26)
#: Bytes that a reader unzips at once, and that it hands on at once.
CHUNK_BYTES = 1 << 20
BATCH_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def resolve(headers: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Headers (page_id, url, payload_digest, payload_bytes) with ``original`` and ``original_url``: id and URL of the
    record that holds the payload, null where the record itself does."""
    big = headers.filter((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull())
    first = big.groupBy("payload_digest").agg(F.min(F.struct("page_id", "url")).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    met = keyed_join(headers, stored(first), "payload_digest", "__n", ["__first"])
    repeat = (F.col("payload_bytes") >= least) & (F.col("__first.page_id") != F.col("page_id"))
    return met.select(*headers.columns, F.when(repeat, F.col("__first.page_id")).alias("original"), F.when(repeat, F.col("__first.url")).alias("original_url"))


def record(page_id: Column, url: Column, payload: Column, digest: Column, size: Column, original: Column, original_url: Column, date: str) -> Column:
    """The text of a WARC record, up to what ends it. URLs are percent-encoded where a header can't hold them."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("-")), F.lit(">"))
    safe = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"[\x00-\x20\x7F]+", "%20")
    revisit = original.isNotNull()
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\n"), line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", size.cast("string")), F.lit("\r\n"))
    refers = F.concat(line("WARC-Refers-To", name(original)), line("WARC-Refers-To-Target-URI", safe(original_url)), line("WARC-Refers-To-Date", F.lit(date)), line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", name(page_id)),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", safe(url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(head) + F.when(revisit, F.lit(0)).otherwise(size)).cast("string")),
        F.lit("\r\n"),
        head,
        F.when(revisit, F.lit("")).otherwise(payload),
    )


def write(pages: DataFrame, path: str, least: int = LEAST_BYTES, compression: str = "gzip", date: str | None = None) -> None:
    """Write a record for each row (page_id, url, html) to archives below ``path``, repeated payloads once. ``date`` is
    the records' date, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    digest, size = F.sha2(F.col("html").cast("binary"), 256), F.octet_length("html").cast("long")
    headers = stored(rows.select("page_id", "url", digest.alias("payload_digest"), size.alias("payload_bytes")))
    revisits = resolve(headers, least).filter("original is not null").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), "original", "original_url").distinct()
    rows = rows.withColumn("payload_digest", digest).withColumn("payload_bytes", size)
    # few or many revisits: Spark picks the join by what it measures
    met = rows.join(revisits, (F.col("page_id") == F.col("__id")) & (F.col("payload_digest") == F.col("__digest")), "left")
    text = record(F.col("page_id"), F.col("url"), F.col("html"), F.col("payload_digest"), F.col("payload_bytes"), F.col("original"), F.col("original_url"), date)
    # a header has some 700 bytes and two URLs, each character of which may become three
    room = F.col("payload_bytes") + 3 * F.octet_length(F.coalesce("url", F.lit(""))) + 1024
    place = F.lit(0)
    for k, low in enumerate(CLASS_BYTES, 1):
        place = F.when(room > low, F.lit(k)).otherwise(place)
    classes = sorted(r[0] for r in headers.select(place).distinct().collect())
    pages.sparkSession.createDataFrame([], "value string").write.mode("overwrite").text(path)
    for k in classes:
        records = max(1, FILE_BYTES // CLASS_BYTES[k]) if k < len(CLASS_BYTES) else 1
        writer = met.filter(place == k).select(text.alias("value")).write.mode("append").option("lineSep", END).option("maxRecordsPerFile", records)
        writer.option("compression", compression).text(path)


def _unzipped(data: bytes) -> Iterator[bytes]:
    """The bytes of an archive, gzipped (in one member or many) or not, some at a time."""
    if data[:2] != b"\x1f\x8b":
        yield from (data[at : at + CHUNK_BYTES] for at in range(0, len(data), CHUNK_BYTES))
        return
    view, at = memoryview(data), 0
    unzip = zlib.decompressobj(31)
    while at < len(data) or unzip.unconsumed_tail:
        part = unzip.unconsumed_tail or view[at : at + CHUNK_BYTES]
        at += 0 if unzip.unconsumed_tail else len(part)
        yield unzip.decompress(part, CHUNK_BYTES)
        if unzip.eof:
            at -= len(unzip.unused_data)
            unzip = zlib.decompressobj(31)
    yield unzip.flush()


class _Stream:
    """Reads from parts: up to a mark, or a number of bytes."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at = parts, bytearray(), 0

    def _more(self) -> bool:
        for part in self.parts:
            if part:
                del self.held[: self.at]
                self.at = 0
                self.held += part
                return True
        return False

    def until(self, mark: bytes) -> bytes:
        start = self.at
        while (end := self.held.find(mark, max(self.at, start))) < 0:
            start = max(0, len(self.held) - self.at - len(mark))  # what is read goes, so the place shifts
            if not self._more():
                raise ValueError("an archive ends within a header")
        out = bytes(self.held[self.at : end])
        self.at = end + len(mark)
        return out

    def take(self, n: int) -> bytes:
        out = io.BytesIO()
        while n:
            if self.at == len(self.held) and not self._more():
                raise ValueError("an archive ends within a record")
            part = self.held[self.at : self.at + n]
            out.write(part)
            self.at += len(part)
            n -= len(part)
        return out.getvalue()

    def done(self) -> bool:
        return self.at == len(self.held) and not self._more()


def _fields(lines: list[bytes]) -> dict[str, str]:
    return {key.decode("ascii", "replace").lower(): value.strip().decode("utf-8", "replace") for key, _, value in (x.partition(b":") for x in lines)}


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, gzipped or not."""
    stream = _Stream(_unzipped(data))
    while not stream.done():
        first, *lines = stream.until(END.encode()).split(b"\r\n")
        if not first.startswith(b"WARC/"):
            raise ValueError("an archive holds something that is no record")
        head = _fields(lines)
        yield head, stream.take(int(head["content-length"]))
        stream.take(len(END))


def _id(value: str | None) -> int | None:
    name = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name not in ("", "-") else None


def _read(payloads: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in READ.split(", ")]
    for batch in batches:
        for content in batch.column(0):
            rows, held = [], 0
            for head, block in parse(content.as_py()):
                kind = head["warc-type"]
                if kind not in ("response", "revisit"):
                    continue
                http, _, payload = block.partition(END.encode())
                size = int(_fields(http.split(b"\r\n")[1:])["content-length"])
                digest = head["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                    raise ValueError(f"{head['warc-record-id']}: the payload isn't what its header says")
                kept = payload if payloads and kind == "response" else None
                rows.append((_id(head["warc-record-id"]), head.get("warc-target-uri"), kind, size, digest, _id(head.get("warc-refers-to")), kept))
                held += 300 + len(kept or b"")
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all archives below ``path``; the payload of a revisit is null, as are all if they aren't asked for.
    Digests are checked against what was read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.filter(F.col("length") > 0).select("content").mapInArrow(functools.partial(_read, payloads), READ)


def round_trip(pages: DataFrame, path: str | None = None, payloads: bool = True) -> DataFrame:
    """Write the pages' archives and read them back."""
    path = path or f"{shared_dir(pages.sparkSession)}/warc"
    write(pages, path)
    return read(pages.sparkSession, path, payloads)
