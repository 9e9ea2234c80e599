"""Files as rows: recursive scans, type detection, decoding, hashes."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..config import FILE_TYPES, MIME_TYPES, SKIPPED_FOLDERS

CASCADE = ("utf-8", "cp1252", "latin-1")


def scan(spark: SparkSession, root: str, pattern: str | None = None, recursive: bool = True, skip: Iterable[str] = SKIPPED_FOLDERS) -> DataFrame:
    """path, length, modified and content of the files below a folder; folders named in ``skip`` are passed over. The content
    is only read if it is used."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"), "content")
    for name in skip:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    return files


#: Most tasks in which Spark looks up the paths that it's given.
DISCOVERY = "spark.sql.sources.parallelPartitionDiscovery.parallelism"


def literal_paths(paths: list[str]) -> list[str]:
    """Paths whose characters with a meaning in patterns are taken as they are."""
    return [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]


def named(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The same columns for files named one by one, which must exist. Spark looks each of them up, by itself in a task of its own
    up to 10,000 tasks; here in some tasks for each core."""
    was = spark.conf.get(DISCOVERY)
    spark.conf.set(DISCOVERY, str(min(int(was), 4 * spark.sparkContext.defaultParallelism)))
    try:
        found = spark.read.format("binaryFile").load(literal_paths(paths))
    finally:
        spark.conf.set(DISCOVERY, was)
    return found.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def looks_binary(content: Column) -> Column:
    """A NUL within the first 1,024 bytes."""
    return F.contains(F.substring(content, 1, 1024), F.lit(b"\x00"))


def detect(files: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``mime``: by extension, else text or binary by content."""
    kinds = F.create_map(*[F.lit(x) for pair in FILE_TYPES.items() for x in pair])
    mimes = F.create_map(*[F.lit(x) for pair in MIME_TYPES.items() for x in pair])
    kind = F.coalesce(F.try_element_at(kinds, extension(F.col("path"))), F.when(looks_binary(F.col("content")), "binary").otherwise("text"))
    out = files.withColumn("kind", kind)
    return out.withColumn("mime", F.coalesce(F.try_element_at(mimes, F.col("kind")), F.lit("application/octet-stream")))


def file_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def decode_bytes(data: bytes | None, cascade: Iterable[str] = CASCADE) -> str:
    """Text of bytes: byte order marks first, then the first encoding that fits, with bytes replaced if none does."""
    if not data:
        return ""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            try:
                return data.decode(name)
            except UnicodeDecodeError:
                break
    for name in cascade:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


@F.pandas_udf(StringType())
def decode_all(content: pd.Series) -> pd.Series:
    return content.map(decode_bytes)


def decoded(content: Column) -> Column:
    """UTF-8 within the JVM; only other bytes go through the cascade in Python, which gets nulls for the rest."""
    valid = F.try_validate_utf8(content.cast("string"))
    return F.coalesce(valid, decode_all(F.when(valid.isNull(), content)))


def _readable(text: str) -> bool:
    return sum(c.isprintable() or c in "\t\n\r\f" for c in text) >= 0.9 * len(text)


def decode_wide(data: bytes | None) -> str:
    """As ``decode_bytes`` by marks, then UTF-8, UTF-16 of either order and Latin-1, the first that reads as text; bytes that
    don't are given in hexadecimal."""
    if not data or data.startswith((b"\xef\xbb\xbf", b"\xff\xfe", b"\xfe\xff")):
        return decode_bytes(data)
    for name in ("utf-8", "utf-16-le", "utf-16-be", "cp1252", "latin-1"):
        try:
            text = data.decode(name)
        except UnicodeDecodeError:
            continue
        # two-byte encodings read any bytes as some script, so they must give mostly the script that ASCII marks
        if _readable(text) and (not name.startswith("utf-16") or sum(c < "\u0250" for c in text) > 0.5 * len(text)):
            return text
    return data.hex()


@F.pandas_udf(StringType())
def decode_all_wide(content: pd.Series) -> pd.Series:
    return content.map(decode_wide)


def texts(files: DataFrame, wide: bool = False) -> DataFrame:
    """Files with their text; ``wide`` tries more encodings, in Python."""
    return files.withColumn("text", decode_all_wide(F.col("content")) if wide else decoded(F.col("content"))).drop("content")


def folder_id(path: Column) -> Column:
    """The numeric folder that a package's file lies in, or null."""
    found = F.regexp_extract(path, r"/(\d+)/[^/]+(?:/.*)?$", 1)
    return F.when(found != "", found)


def key_values(text: str) -> dict[str, str]:
    """``key "value"``, ``key = value`` or ``key: value`` lines; the first of a key counts."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        m = re.match(r'\s*"?([A-Za-z_][\w .-]*?)"?\s*(?:[=:]|\s)\s*"?([^"\n]*?)"?\s*,?\s*$', line)
        if m and m[2]:
            out.setdefault(m[1].strip().lower(), m[2].strip())
    return out
