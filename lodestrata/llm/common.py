"""What the training-data operators share: words, Arrow row mapping, shared storage, skew-proof joins."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..session import shared_dir, stored

__all__ = ["decoded", "hashable", "keyed_join", "map_rows", "shared_dir", "slices", "stored", "text_bytes", "to_batch", "tokenizer_file", "words"]

#: Bytes of a text that are taken apart at once.
SLICE = 1 << 20
_BLANK = re.compile(rb"[\x20\x09-\x0D]")

#: The most rows that ``keyed_join`` broadcasts.
HEAVY_KEYS = 1000
#: Rows that a mapped partition reads from an Arrow batch at once; rows and characters that it gathers before it hands on.
READ_ROWS = 256
BATCH_ROWS = 2000
BATCH_CHARS = 8_000_000
#: Spark's bound of an Arrow batch to Python, and the one that ``map_rows`` sets where the session has Spark's.
ARROW_DEFAULT, ARROW_BYTES = "67108864b", "16777216b"
#: How each module drops what it keeps between the tasks of a worker, and the module that ran last.
DROPS: dict[str, Callable[[], object]] = {}
_LAST = [""]


def claim(module: str) -> None:
    """Called as a module's function begins in a worker: what other modules keep there goes, so that a worker holds the
    caches of one operator at a time."""
    if _LAST[0] != module:
        _LAST[0] = module
        for other, drop in DROPS.items():
            if other != module:
                drop()


def map_rows(df: DataFrame, columns: list[Column], fn: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str) -> DataFrame:
    """Stream the given columns of each partition through ``fn`` (rows in, rows out) in Arrow batches."""
    struct = _parse_datatype_string(schema)
    assert isinstance(struct, StructType)
    narrow = df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)])
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(bound, ARROW_DEFAULT) == ARROW_DEFAULT:
        df.sparkSession.conf.set(bound, ARROW_BYTES)
    return narrow.mapInArrow(functools.partial(_run_rows, fn, to_arrow_schema(struct)), struct)


def _run_rows(fn: Callable, schema: pa.Schema, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim(getattr(fn, "func", fn).__module__)

    def rows() -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, READ_ROWS):
                yield from zip(*[c.to_pylist() for c in batch.slice(at, READ_ROWS).columns], strict=True)

    held: list[tuple] = []
    chars = 0
    for row in fn(rows()):
        held.append(row)
        chars += sum([len(v) for v in row if isinstance(v, (str, bytes))])
        if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield to_batch(held, schema)
            held, chars = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def text_bytes(name: str = "text") -> Column:
    """The text as bytes, so that text that isn't valid UTF-8 passes through Arrow too."""
    return F.col(name).cast("string").cast("binary")


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of ``[^\\x20\\x09-\\x0D]``; none for null. ``bytes.split()`` cuts at just these six characters."""
    return text.split() if text else []


def slices(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE`` bytes, cut before blanks, so that no word is cut and what a part becomes in
    memory doesn't grow with the text. A short text is one part, an empty one is one empty part."""
    at = 0
    while len(text) - at > 2 * SLICE:
        blank = _BLANK.search(text, at + SLICE)
        end = blank.start() if blank else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def hashable(df: DataFrame) -> list[Column]:
    """The columns that Spark's hash functions take."""
    return [F.col(f"`{c}`") for c, kind in df.dtypes if not re.search("map<|variant|void", kind)]


def decoded(text: bytes | None) -> str:
    return text.decode("utf-8", "replace") if text else ""


def keyed_join(left: DataFrame, right: DataFrame, key: str, weight: str, keep: list[str]) -> DataFrame:
    """Left join on ``key`` where ``left`` may be skewed and ``right`` has one row for each key.

    The ``HEAVY_KEYS`` keys of most ``weight`` (rows of ``left``) are joined by broadcast, which has that bound; the
    rest meets in a shuffle, where no key is large. ``right`` should be stored: it is read twice. A null key matches
    nothing. ``keep`` are the columns of ``right`` to add. Keys are strings, binary or long.
    """
    heavy = right.orderBy(F.col(weight).desc(), F.col(key)).limit(HEAVY_KEYS)
    heavy = heavy.select(F.col(key).alias("__hk"), F.struct(*keep).alias("__hv"))
    rest = right.select(F.col(key).alias("__rk"), F.struct(*keep).alias("__rv"))
    met = left.join(F.broadcast(heavy), F.col(key) == F.col("__hk"), "left")
    # what is joined already, and nulls, are dealt out evenly under keys that aren't theirs
    other = F.xxhash64(F.lit(1), *hashable(left))
    if (kind := dict(left.dtypes)[key]) != "bigint":
        other = other.cast("string").cast(kind)
    met = met.withColumn("__jk", F.when(F.col("__hk").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(other))
    out = met.join(rest, F.col("__jk") == F.col("__rk"), "left")
    late = F.col(key) == F.col("__rk")
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.coalesce(F.col(f"__hv.{c}"), F.when(late, F.col(f"__rv.{c}"))).alias(c) for c in keep])


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer's file lies; ``LODESTRATA_TOKENIZERS`` names another folder."""
    folder = os.environ.get("LODESTRATA_TOKENIZERS")
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)
