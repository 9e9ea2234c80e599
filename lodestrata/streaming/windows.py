"""Structured Streaming: event-time windows, incremental ingest, idempotent upserts, keyed breaker state."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.store import newest
from ..operators.versions import Snapshots
from ..session import shared_dir


def source(spark: SparkSession, path: str, max_files: int | None = None, folder: str | None = None) -> DataFrame:
    """A stream over the Parquet files at a path (a folder or one file), with the schema they have now; with ``folder`` over
    all files below it, whenever they come."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if folder:
        return reader.option("recursiveFileLookup", "true").parquet(folder)
    # as a pattern, since the stream source takes a plain path for a folder
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def timed(events: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Events with a watermark; NTZ times are read in the session's zone."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def tumbling(events: DataFrame, width: str, by: list[str], ts: str = "ts", slide: str | None = None) -> DataFrame:
    """Counts and sums of ``value`` per window and key; batch and stream alike.

    Sliding windows of a batch are put together from panes, if a window is a whole number of slides: an event is counted once,
    in the pane of one slide, and only the panes' sums are dealt to the windows that hold them. A stream counts each event in each
    of its windows, as its state is kept by window."""
    if slide and not events.isStreaming and (panes := whole_slides(width, slide)):
        parts = events.groupBy(F.window(ts, slide).alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        step = F.expr(f"INTERVAL {slide}")
        starts = F.array(*[F.col("w.start") - F.lit(i) * step for i in range(panes)])
        held = parts.select(F.explode(starts).alias("start"), *by, "n", "total").groupBy("start", *by).agg(F.sum("n").alias("n"), F.round(F.sum("total"), 6).alias("total"))
        return held.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("win_start"), *by, "n", "total")
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    out = events.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("win_start"), *by, "n", "total")


def whole_slides(width: str, slide: str) -> int | None:
    """How many slides a window is ("7 days", "1 day"); None if it isn't a whole number of them or a length isn't plain."""
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}
    found = [re.fullmatch(r"\s*(\d+)\s+([a-z]+?)s?\s*", x.lower()) for x in (width, slide)]
    lengths = [int(m[1]) * seconds.get(m[2], 0) for m in found if m]
    return lengths[0] // lengths[1] if len(lengths) == 2 and all(lengths) and lengths[0] % lengths[1] == 0 else None


def sessions(events: DataFrame, gap: str, by: list[str], ts: str = "ts") -> DataFrame:
    out = events.groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return out.select(*by, F.date_format("w.start", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("session_start"), "n", "total")


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str, checkpoint: str | None = None) -> None:
    """Process all that is there now, batch by batch, and stop. Given the same checkpoint, a later call goes on from it."""
    checkpoint = checkpoint or f"{shared_dir(stream.sparkSession)}/checkpoint"
    query = stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def latest_table(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The table that the stream's last batch leaves."""
    spark = stream.sparkSession
    root = shared_dir(spark)
    last = {"at": None}

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/batch={number}")
        last["at"] = f"{root}/batch={number}"

    run_available(stream, keep, mode)
    return spark.read.parquet(last["at"]) if last["at"] else spark.createDataFrame([], stream.schema)


def deduplicated(events: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 day") -> DataFrame:
    """One event per key within the watermark: replays have no effect."""
    return timed(events, ts, late).dropDuplicatesWithinWatermark(keys)


#: Batches after which a streamed table is made one snapshot.
COMPACT = 20


def upsert_table(spark: SparkSession, table: str, schema: StructType, keys: list[str], by: str) -> DataFrame:
    """The rows of a streamed table: the newest per key of its snapshot and of the batches since."""
    snapshots = Snapshots(spark, f"{table}/base")
    base, done = snapshots.current(), snapshots.note().get("batches", {})
    deltas = [path for path, source, number in _deltas(spark, table) if number > done.get(source, -1)]
    rows = base if base is not None else spark.createDataFrame([], schema)
    if deltas:
        rows = rows.unionByName(spark.read.schema(schema).parquet(*deltas))
    return newest(rows, keys, [F.col(by).desc_nulls_last()])


def _deltas(spark: SparkSession, table: str) -> list[tuple[str, str, int]]:
    """Path, checkpoint and number of each finished batch of a streamed table."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    root = hadoop.Path(f"{table}/deltas")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = []
    for mark in fs.globStatus(hadoop.Path(f"{table}/deltas/*/batch=*/_SUCCESS")) or []:
        folder = mark.getPath().getParent()
        found.append((folder.toString(), folder.getParent().getName(), int(folder.getName()[6:])))
    return found


def upsert_stream(stream: DataFrame, keys: list[str], by: str, table: str, checkpoint: str | None = None) -> DataFrame:
    """Upsert a stream into a table below ``table``: at-least-once delivery, exactly-once effect per key, over restarts.

    A batch is reduced to the newest row per key and written to a folder of its checkpoint and number, so one that is
    delivered twice replaces itself. Every ``COMPACT`` batches the table becomes a new snapshot that notes the batches it
    holds. The checkpoint is kept with the table unless another is given.
    """
    spark, schema = stream.sparkSession, stream.schema
    checkpoint = checkpoint or f"{table}/checkpoint"
    source = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def merge(batch: DataFrame, number: int) -> None:
        newest(batch, keys, [F.col(by).desc_nulls_last()]).write.mode("overwrite").parquet(f"{table}/deltas/{source}/batch={number}")
        if (number + 1) % COMPACT == 0:
            compact(spark, table, schema, keys, by)

    run_available(stream, merge, "append", checkpoint)
    return upsert_table(spark, table, schema, keys, by)


def compact(spark: SparkSession, table: str, schema: StructType, keys: list[str], by: str) -> None:
    """Make the table one snapshot; batches that it holds go once it is current."""
    snapshots = Snapshots(spark, f"{table}/base")
    held = _deltas(spark, table)
    done = dict(snapshots.note().get("batches", {}))
    for _, source, number in held:
        done[source] = max(number, done.get(source, -1))
    snapshots.publish(upsert_table(spark, table, schema, keys, by), 1, {"batches": done})
    for path, _, _ in held:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def _keyed(events: DataFrame, key: str, late: str) -> GroupedData:
    """Events (key, us) by key, with a watermark that lets state expire."""
    return events.select(key, "us", F.timestamp_micros("us").alias("__at")).withWatermark("__at", late).groupBy(key)


def _expire(state: GroupState, last: int, idle: int) -> None:
    state.setTimeoutTimestamp(max(last // 1000, state.getCurrentWatermarkMs()) + idle * 1000)


def breaker_states(failures: DataFrame, key: str, limit: int = 3, seconds: int = 60, idle: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Keyed state: for each failure (key, us) in time order, whether the key's circuit is open after it. Each key holds the
    times of at most ``limit`` failures, and is forgotten when the stream is ``idle`` seconds beyond its last. Works on streams
    and, batch by batch, keeps its state between them."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = []
        for us in sorted(int(x) for f in frames for x in f["us"]):
            times = [t for t in times if us - t <= seconds * 1_000_000][-(limit - 1) :] + [us] if limit > 1 else [us]
            rows.append((k[0], us, len(times) >= limit))
        state.update((times,))
        _expire(state, times[-1], idle)
        yield pd.DataFrame(rows, columns=[key, "us", "open"])

    kind = dict(failures.dtypes)[key]
    return _keyed(failures, key, late).applyInPandasWithState(step, f"{key} {kind}, us long, open boolean", "times array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def heartbeats(beats: DataFrame, key: str, silence: int = 60, window: int = 3600, limit: int = 2, idle: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Keyed state of services that beat (key, us): a beat after more than ``silence`` seconds is a restart; each beat tells
    the restarts of the last ``window`` seconds and whether they exceed ``limit``. A service gives a row with ``lost`` and is
    forgotten when the stream is ``idle`` seconds beyond its last beat."""
    columns = [key, "us", "restarts", "alert", "lost"]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, times = (state.get[0], list(state.get[1])) if state.exists else (None, [])
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(k[0], last, len(times), len(times) > limit, True)], columns=columns)
            return
        rows = []
        for us in sorted(int(x) for f in frames for x in f["us"]):
            times = [t for t in times if us - t <= window * 1_000_000]
            if last is not None and us - last > silence * 1_000_000:
                times.append(us)
            last = us if last is None else max(last, us)
            rows.append((k[0], us, len(times), len(times) > limit, False))
        state.update((last, times))
        _expire(state, last, idle)
        yield pd.DataFrame(rows, columns=columns)

    kind = dict(beats.dtypes)[key]
    schema = f"{key} {kind}, us long, restarts long, alert boolean, lost boolean"
    return _keyed(beats, key, late).applyInPandasWithState(step, schema, "last long, times array<long>", "append", GroupStateTimeout.EventTimeTimeout)
