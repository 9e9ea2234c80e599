"""From files to chunks: parse by kind, chunk, and set bad files aside with the reason."""

from __future__ import annotations

import functools
import json
import traceback
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import html_text, squeeze
from ..operators import chunking
from ..session import stored
from . import files, lined
from .containers import CONTAINERS, MEMBER_CHARS, parse_archive
from .files import decode_bytes, detect
from .parsers import PARSERS, Record, parse_text, record

RECORDS = "source string, kind string, file_hash string, record_index bigint, name string, text string, metadata string, error string, markup boolean"
#: As ``records`` gives them.
PARSED = RECORDS.replace(", markup boolean", "")
FIELDS = [("source", pa.string()), ("kind", pa.string()), ("file_hash", pa.string()), ("record_index", pa.int64()), ("name", pa.string()), ("text", pa.string()), ("metadata", pa.string()), ("error", pa.string()), ("markup", pa.bool_())]


def parse(kind: str, data: bytes, member_chars: int | None = MEMBER_CHARS) -> list[Record]:
    """Records of one file; ``ValueError`` for kinds that aren't text and have no reader here. Members of archives are cut at
    ``member_chars`` characters, if it is given."""
    if kind == "archive":
        return parse_archive(data, member_chars)
    if kind in CONTAINERS:
        return CONTAINERS[kind](data)
    if kind in ("image", "audio", "video", "binary"):
        raise ValueError(f"no reader for {kind}")
    text = decode_bytes(data).replace("\x00", "")
    if kind == "html":
        return [record("", "page", text) | {"markup": True}]
    return PARSERS.get(kind, parse_text)(text)


def _parse_batches(member_chars: int | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, kind, digest, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            try:
                rows = [(path, kind, digest, i, r["name"], r["text"], json.dumps(r["metadata"], ensure_ascii=False, default=str, sort_keys=True), None, r.get("markup", False)) for i, r in enumerate(parse(kind, content or b"", member_chars))]
                rows = rows or [(path, kind, digest, -1, None, None, None, "no text", False)]
            except Exception as e:  # a bad file must not stop the others; it goes to quarantine with its reason
                where = traceback.extract_tb(e.__traceback__)[-1]
                rows = [(path, kind, digest, -1, None, None, None, f"{type(e).__name__}: {e} ({where.name})", False)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), FIELDS, strict=True)], [n for n, _ in FIELDS])


def records(found: DataFrame, member_chars: int | None = MEMBER_CHARS) -> DataFrame:
    """The records of scanned files, and one row with ``error`` for each that gives none. Files are read where they are
    parsed; one at a time is held. Markup becomes text in the JVM; chapters without text go."""
    known = found if "kind" in found.columns else detect(found)
    out = known.select("path", "kind", F.sha2("content", 256), "content").mapInArrow(functools.partial(_parse_batches, member_chars), RECORDS)
    for column in ("text", "name"):
        plain = html_text(F.col(column))
        out = out.withColumn(column, F.when(F.col("markup"), squeeze(plain) if column == "name" else plain).otherwise(F.col(column)))
    blank = F.col("markup") & (F.trim("text") == "")
    out = out.filter(~blank | (F.col("kind") == "html")).withColumn("error", F.when(blank, F.lit("no text")).otherwise(F.col("error")))
    return out.drop("markup")


def read(spark: SparkSession, paths: list[str], hashes: DataFrame, member_chars: int | None = MEMBER_CHARS) -> DataFrame:
    """As ``records``, for files of a block that are named one by one, with their hashes (path, file_hash and wide: a mark of
    two-byte characters begins them). What is read by line is; such files that are wide are parsed whole."""
    by_line = [p for p in paths if lined.kind_of(p)]
    wide = {r.path for r in hashes.filter("wide").select("path").collect()} & set(by_line) if by_line else set()
    by_line = [p for p in by_line if p not in wide]
    other = [p for p in paths if p in wide or not lined.kind_of(p)]
    parts = [records(files.named(spark, other), member_chars)] if other else []
    if by_line:
        found = stored(lined.records(spark, by_line))
        marked = hashes.filter(F.col("path").rlike(lined.PATTERN) & ~F.col("wide")).select("path", "file_hash")
        none = marked.join(found.select("path").distinct(), "path", "left_anti").select(F.col("path").alias("source"), "file_hash", F.lit("no text").alias("error"))
        told = found.join(marked, "path").withColumnRenamed("path", "source").unionByName(none, allowMissingColumns=True)
        parts.append(told.select(*[c.split()[0] for c in PARSED.split(", ")]))
    return functools.reduce(DataFrame.unionByName, parts)


def hashed(files_: DataFrame) -> DataFrame:
    """path, file_hash and wide of scanned files."""
    wide = F.hex(F.substring("content", 1, 2)).isin("FFFE", "FEFF")
    return files_.select("path", files.file_hash(F.col("content")).alias("file_hash"), F.coalesce(wide, F.lit(False)).alias("wide"))


def good(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("error").isNull() & (F.trim("text") != "")).drop("error")


def bad(parsed: DataFrame) -> DataFrame:
    """What goes to quarantine."""
    return parsed.filter(F.col("error").isNotNull()).select("source", "kind", F.col("error").alias("reason"), F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("snippet"), F.current_timestamp().alias("at"))


def chunks(parsed: DataFrame, limit: int = 512, overlap_words: int = 0) -> DataFrame:
    """Chunk rows of good records: paragraphs packed up to the limit, with their place in the record's text and ids that stay the
    same from run to run. An entity keeps its own id for its first chunk."""
    pieces = chunking.pack_spans(chunking.paragraph_spans(F.col("text")), limit, "\n\n", overlap_words)
    out = good(parsed).select("source", "kind", "file_hash", "record_index", "name", "metadata", F.posexplode(pieces).alias("chunk_index", "__piece"))
    entity = F.get_json_object("metadata", "$.id")
    serial = F.concat_ws("::", "source", F.lit("chunk"), F.concat_ws(".", "record_index", "chunk_index"))
    chunk_id = F.when(entity.isNotNull() & (F.col("chunk_index") == 0), entity).otherwise(serial)
    return out.select(chunk_id.alias("chunk_id"), "source", "kind", "file_hash", "record_index", "chunk_index", F.col("__piece.start").alias("start_offset"), F.col("__piece.stop").alias("end_offset"), "name", F.col("__piece.text").alias("text"), "metadata")
