"""Keyed writes as expressions over rows (upsert, insert, delete, retention), batches by bytes, and records beside the corpus.

The stored corpus, which writes only what changes, is ``operators.versions``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text as T
from ..sources.records import register
from .windows import running_sum


def newest(rows: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """One row per key, the first in the given order."""
    w = Window.partitionBy(*keys).orderBy(*by)
    return rows.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Base and batch, where of rows with one key the one with the greatest ``by`` stays (the batch's on ties)."""
    both = base.withColumn("__new", F.lit(0)).unionByName(batch.withColumn("__new", F.lit(1)))
    return newest(both, keys, [F.col(by).desc_nulls_last(), F.col("__new").desc()]).drop("__new")


def upsert_table(base: DataFrame, batch: DataFrame, table: str, by: str) -> DataFrame:
    """Upsert into a relational table, by its own key."""
    return upsert(schemas.typed(base, table), schemas.typed(batch, table), schemas.KEYS[table], by)


def insert_ignore(base: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Base and those rows of the batch whose key is new; of rows that share a new key the first by all columns stays."""
    new = batch.join(base.select(*keys).distinct(), keys, "left_anti").select(*base.columns)
    return base.unionByName(newest(new, keys, [F.col(c).asc_nulls_last() for c in base.columns if c not in keys] or [F.lit(0)]))


def delete(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys).distinct(), keys, "left_anti").select(*base.columns)


def unseen(files: DataFrame, seen: DataFrame, path: str, digest: str) -> DataFrame:
    """Files that are new or whose content has changed; the index is keyed by path."""
    return files.join(seen.select(path, digest).distinct(), [path, digest], "left_anti").select(*files.columns)


def keep_newest(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """Rows beyond the newest n of each group: what retention removes."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") > n)


def batches(rows: DataFrame, by: str, size: Column, limit: int, order: list[Column]) -> DataFrame:
    """Numbers batches within each group so that a batch's running bytes pass the limit once. ``limit`` and sizes are whole
    numbers; no task holds a group."""
    return running_sum(rows, [by], order, size, "cum_bytes").withColumn("batch_no", F.expr(f"(cum_bytes - 1) div {limit}"))


def fingerprint(rows: DataFrame, by: list[str], name: Column, digest: Column) -> DataFrame:
    """12 digits that tell the set of (name, digest) of each group: hashes are summed, so no task gathers a group."""
    return rows.groupBy(*by).agg(T.bag_hash(F.concat_ws(":", name.cast("string"), digest)).alias("fingerprint"))


def audit(spark: SparkSession, path: str, event: str, body: dict) -> None:
    """Append one event as a JSON line."""
    spark.createDataFrame([(event, json.dumps(body, sort_keys=True))], "event string, body string").withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def quarantine(rows: DataFrame, path: str) -> None:
    """Append bad rows as JSON by day; their sources are never changed."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").json(path)


def save_raw(rows: DataFrame, path: str, name: str, body: str, by: str | None = None) -> None:
    """Keep raw records as files ``<12 digits of their hash>_<plain form of their name>.json`` below ``path``, in a folder for each
    value of ``by`` if it is given. Files appear, whole, when the write commits; equal records have equal names."""
    register(rows.sparkSession)
    plain = lambda c: F.left(F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9._-]+", "_"), F.lit(80))
    file = F.concat(F.left(F.sha2(body, 256), F.lit(12)), F.lit("_"), F.regexp_replace(plain(F.coalesce(name, F.lit(""))), r"\.json$", ""), F.lit(".json"))
    named = rows.select((F.concat_ws("/", plain(F.coalesce(F.col(by).cast("string"), F.lit("none"))), file) if by else file).alias("name"), F.col(body).cast("string").alias("body"))
    newest(named, ["name"], [F.col("body")]).write.format("record_files").mode("append").save(path)
