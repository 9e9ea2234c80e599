"""Incremental ingest as a stream: at each tick, new and changed files go through the same code as in batch.

Spark's file source never returns a path twice, so it can't tell of changed files. The stream is a clock; what may be new is
found by path, length and time against the corpus's index, so a tick without changes opens no file, one that is delivered
twice finds nothing to do, and an ingest after a restart goes on from what the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import Snapshots
from ..plans.ingest import Corpus, blocks_of_paths, ingest
from ..session import shared_dir
from ..sources import files
from ..sources.changes import changed_files
from .windows import run_available


def ingest_stream(corpus: Corpus, folder: str, pattern: str | None = None, every: str = "1 minute") -> StreamingQuery:
    """Ingest new and changed files of a folder at every tick, until the query is stopped."""
    clock = corpus.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    tick = lambda batch, number: ingest(corpus, folder, pattern) and None
    return clock.writeStream.foreachBatch(tick).trigger(processingTime=every).option("checkpointLocation", f"{corpus.root}/checkpoint").start()


def ingest_available(corpus: Corpus, folder: str, pattern: str | None = None) -> dict:
    """One tick: ingest what is new or has changed since the last."""
    return ingest(corpus, folder, pattern)


def file_versions(spark: SparkSession, folder: str, table: str, pattern: str | None = None) -> Snapshots:
    """Take in a folder's files that are new or changed since the last call: a table of path, length, modified and file_hash with
    a row for each file's newest state. Only such files are opened; a batch that is delivered twice changes nothing."""
    versions = Snapshots(spark, f"{table}/versions", ["path"], "modified")

    def take(batch: DataFrame, number: int) -> None:
        schema = None
        # files are opened once and taken in together, as a write costs a look at the whole table's keys
        work = f"{shared_dir(spark)}/seen"
        for block in blocks_of_paths(batch.select("path").distinct()):
            seen = files.named(spark, block).select("path", "length", "modified", files.file_hash(F.col("content")).alias("file_hash"))
            # Spark reads some 32 small files a task, and each task would write a file of so many rows
            seen.coalesce(4 * spark.sparkContext.defaultParallelism).write.mode("append").parquet(work)
            schema = seen.schema
        if schema is not None:
            versions.upsert(spark.read.schema(schema).parquet(work), 1)

    run_available(changed_files(spark, folder, pattern), take, "append", f"{table}/checkpoint")
    return versions


def run_lifecycle(starts: DataFrame, ends: DataFrame, within: str = "1 day") -> DataFrame:
    """Pairs of a run's start (id, started_at) and end (id, ended_at, status), as a stream-stream join; both sides have
    watermarks so that state is bounded."""
    s = starts.withWatermark("started_at", within).alias("s")
    e = ends.withWatermark("ended_at", within).alias("e")
    paired = s.join(e, F.expr(f"s.id = e.id AND e.ended_at >= s.started_at AND e.ended_at <= s.started_at + INTERVAL {within}"), "leftOuter")
    return paired.select("s.id", "s.started_at", "e.ended_at", F.coalesce("e.status", F.lit("running")).alias("status"))
