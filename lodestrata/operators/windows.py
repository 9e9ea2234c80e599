"""Window operators: latest rows, rolling counts with thresholds, streaks, drops between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def latest(rows: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first n rows of each group; tasks cut to n before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n)
    return out.withColumnRenamed("__rn", rank) if rank else out.drop("__rn")


def running_sum(rows: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """Rows with the sum of a whole-number ``value`` over the rows of their group up to them, in order.

    No task holds a group: rows are dealt into ranges of (group, order) and summed within each; a range begins with the
    sums of its group's earlier ranges, of which there are at most as many as shuffle partitions. Rows are stored once.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("__v", value.cast("long")).repartitionByRange(ranges, *[F.col(c) for c in by], *order)
    dealt = stored(dealt.withColumn("__range", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "__range").agg(F.sum("__v").alias("__sum"))
    starts = starts.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], F.col("__range").alias("__at"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    same = F.col("__range") == F.col("__at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    within = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(starts, same).withColumn(name, F.sum("__v").over(within) + F.col("__start"))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], name)


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trailing_count(rows: DataFrame, by: list[str], ts: str, seconds: int, name: str) -> DataFrame:
    """Rows of the group within the last ``seconds``, the row itself included, ``__oldest``, the time of the first of
    them, and ``__gap``, the time since the row before (null if that lies further back than two slots).

    A group is cut into slots of time as long as the window, and each row also stands, as history only, in the next slot,
    so a hot group is many tasks' work.
    """
    span = seconds * 1_000_000
    slot = F.floor(F.col("__us") / span)
    timed = rows.withColumn("__us", micros(F.col(ts)))
    own = timed.withColumn("__slot", slot).withColumn("__own", F.lit(True))
    keys = [F.col(f"`{c}`") for c in by]
    past = timed.select(*[F.col(f"`{c}`") if c in by or c == "__us" else F.lit(None).cast(kind).alias(c) for c, kind in timed.dtypes], (slot + 1).alias("__slot"), F.lit(False).alias("__own"))
    w = Window.partitionBy(*keys, "__slot").orderBy("__us")
    recent = w.rangeBetween(-span, 0)
    out = own.unionByName(past).withColumn(name, F.count("*").over(recent)).withColumn("__oldest", F.min("__us").over(recent))
    out = out.withColumn("__gap", F.col("__us") - F.lag("__us").over(Window.partitionBy(*keys, "__slot").orderBy("__us", "__own"))).filter("__own")
    return out.drop("__slot", "__own")


def breaker(rows: DataFrame, by: list[str], ts: str, seconds: int = 60, limit: int = 3) -> DataFrame:
    """Rows at which ``limit`` failures lie within ``seconds``: the circuit is open."""
    return trailing_count(rows, by, ts, seconds, "recent").filter(F.col("recent") >= limit).drop("__us", "__oldest", "__gap")


def rate_limit(rows: DataFrame, by: list[str], ts: str, seconds: int, limit: int, least: float = 0.5) -> DataFrame:
    """Rows at or above the limit with the delay until the oldest one leaves the window."""
    out = trailing_count(rows, by, ts, seconds, "recent").filter(F.col("recent") >= limit)
    return out.withColumn("delay", F.greatest(F.lit(least), F.lit(float(seconds)) - (F.col("__us") - F.col("__oldest")) / 1e6)).drop("__us", "__oldest", "__gap")


def restarts(rows: DataFrame, by: list[str], ts: str, seconds: int, limit: int, cool: int) -> DataFrame:
    """Rows with more than ``limit`` in the window, and whether the gap to the one before is under ``cool`` seconds. With a
    limit of 1 or more the row before lies in the window, so the gap is known there."""
    out = trailing_count(rows, by, ts, seconds, "recent").filter(F.col("recent") > limit).withColumnRenamed("__gap", "gap_us")
    return out.withColumn("cool_down", F.coalesce(F.col("gap_us") < cool * 1_000_000, F.lit(False))).drop("__us", "__oldest")


def longest_streak(rows: DataFrame, by: list[str], order: list[Column], bad: Column) -> DataFrame:
    """The longest run of bad rows in a row, per group."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.withColumn("__bad", bad).withColumn("__island", F.sum(F.when(F.col("__bad"), 0).otherwise(1)).over(w))
    counts = runs.groupBy(*by, "__island").agg(F.count_if("__bad").alias("__n"))
    return counts.groupBy(*by).agg(F.max("__n").alias("longest"))


def breaker_open(streak: Column, limit: int = 5) -> Column:
    return streak >= limit


def drops(runs: DataFrame, by: list[str], at: str, value: str, warn: float = 10.0, critical: float = 25.0) -> DataFrame:
    """Falls of a value from one run to the next in time, with a severity."""
    w = Window.partitionBy(*by).orderBy(at)
    out = runs.withColumn("previous", F.lag(value).over(w)).withColumn("drop", F.round(F.col("previous") - F.col(value), 2))
    return out.filter(F.col("drop") >= warn).withColumn("severity", F.when(F.col("drop") >= critical, "critical").otherwise("warning"))


def first_failure(rows: DataFrame, by: list[str], order: list[Column], failed: Column) -> DataFrame:
    """Rows up to and with the first failure of each group; what comes after it didn't run."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__failed", failed).withColumn("__before", F.coalesce(F.max("__failed").over(w), F.lit(False))).filter(~F.col("__before")).drop("__failed", "__before")


def backoff(attempt: Column, base: float = 5.0) -> Column:
    return F.lit(base) * F.pow(F.lit(2.0), attempt - 1)


def replay(events: DataFrame, by: list[str], order: list[str], passed: str, limit: int = 5) -> DataFrame:
    """The status that each run's events, in order, lead it to from *planning*, with its retries and number of events. An
    event takes the run one transition on; a failed validation costs a retry. The events of one run are held together."""
    step = F.array_sort(F.collect_list(F.struct(*order, passed)))
    start = F.struct(F.lit("planning").alias("status"), F.lit(0).alias("retries"))

    def after(acc: Column, e: Column) -> Column:
        to = next_status(acc["status"], e[passed], acc["retries"], F.lit(limit))
        return F.struct(to.alias("status"), (acc["retries"] + F.when(to == "fixing", 1).otherwise(0)).alias("retries"))

    return events.groupBy(*by).agg(step.alias("__e")).select(*by, F.aggregate("__e", start, after).alias("s"), F.size("__e").alias("events")).select(*by, "s.status", "s.retries", "events")


def next_status(status: Column, passed: Column, retries: Column, limit: Column) -> Column:
    """The transition table of a run."""
    return (
        F.when(status == "planning", "building").when(status == "building", "validating")
        .when((status == "validating") & passed, "packaging").when((status == "validating") & (retries >= limit), "escalated").when(status == "validating", "fixing")
        .when(status == "fixing", "validating").when(status == "packaging", "done").otherwise(status)
    )
