"""Run, coverage and health views. ``as_of`` is a column or literal of the data, never the clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pct(part: Column, whole: Column, digits: int = 2) -> Column:
    """Percentage, null for nothing of nothing."""
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def newest(rows: DataFrame, ts: str) -> Column:
    """The greatest time of a table as a literal; null if there is none. It goes by way of text, so no time zone but the
    session's has a part in it."""
    return F.lit(rows.agg(F.max(ts).cast("string")).first()[0]).cast(rows.schema[ts].dataType)


def within_days(rows: DataFrame, ts: str, days: int) -> DataFrame:
    """Rows of the last days before the table's newest one. The bound is looked up first, so that it reaches the scan."""
    return rows.filter(F.col(ts) > newest(rows, ts) - F.expr(f"INTERVAL '{days}' DAY"))


def success_rate(projects: DataFrame, runs: DataFrame, project: str, ok: Column, seconds: Column, in_time: Column) -> DataFrame:
    """Per project, also those without runs: runs in time, successes, rate, average seconds. The time bound is part of the
    join, so it never drops a project."""
    r = runs.filter(in_time).withColumn("__ok", ok).withColumn("__s", seconds).groupBy(project).agg(F.count("*").alias("total_runs"), F.count_if("__ok").alias("successes"), F.round(F.avg("__s"), 6).alias("avg_seconds"))
    out = projects.join(r, project, "left").na.fill(0, ["total_runs", "successes"])
    return out.withColumn("success_rate", pct(F.col("successes"), F.col("total_runs")))


def coverage(rows: DataFrame, by: list[str], documented: Column, score: Column) -> DataFrame:
    out = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(documented).alias("documented"), F.round(F.avg(score), 6).alias("avg_completeness"))
    return out.withColumn("coverage_pct", pct(F.col("documented"), F.col("total")))


def mean_coverage(covered: DataFrame, share: str = "coverage_pct") -> DataFrame:
    """One row: categories, and the plain mean of their shares, however many rows each has."""
    return covered.agg(F.count("*").alias("categories"), F.round(F.avg(share), 6).alias("mean_coverage"), F.min(share).alias("least_coverage"))


def pipeline_totals(stages: DataFrame, by: list[str]) -> DataFrame:
    """Per run, the sums over its stages (stage, done, failed) and the names of all that failed, in order. A run's stages are
    those of one pipeline, so their names fit into a row."""
    bad = F.when(F.col("failed") > 0, F.col("stage"))
    return stages.groupBy(*by).agg(F.count("*").alias("stages"), F.sum("done").alias("done"), F.sum("failed").alias("failed"), F.count(bad).alias("n_failures"), F.array_sort(F.collect_list(bad)).alias("failures"))


def status_of(share: Column) -> Column:
    return F.when(share >= 95, "OK").when(share >= 80, "WARN").otherwise("FAIL")


def stale(rows: DataFrame, by: str, ts: str, hours: int = 48) -> DataFrame:
    """Groups whose latest row is over ``hours`` older than the newest of all."""
    last = rows.groupBy(by).agg(F.max(ts).alias("last_ts"))
    newest = rows.agg(F.max(ts).alias("as_of"))
    age = F.floor((F.unix_seconds(F.col("as_of").cast("timestamp")) - F.unix_seconds(F.col("last_ts").cast("timestamp"))) / 3600)
    return last.join(F.broadcast(newest)).withColumn("age_hours", age).filter(F.col("age_hours") > hours).drop("as_of")


def alerts(critical: DataFrame, warning: DataFrame, info: DataFrame) -> DataFrame:
    """One list of (level, subject) from three rule results, each with a ``subject``."""
    parts = [df.select(F.lit(level).alias("level"), F.col("subject").cast("string").alias("subject")) for level, df in (("critical", critical), ("warning", warning), ("info", info))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def run_states(events: DataFrame, run: str = "id", at: str = "at") -> DataFrame:
    """A run's state from its appended events (started, completed): for each field the last value that isn't null, so a
    completion needs to say only what it changes. Never updated in place."""
    order = F.struct(at, "seq") if "seq" in events.columns else F.col(at)
    fields = [c for c in events.columns if c not in (run, at, "seq")]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in fields]
    return events.groupBy(run).agg(F.min(at).alias("started_at"), F.max(at).alias("updated_at"), *last)


def totals(rows: DataFrame, by: list[str], sums: list[str]) -> DataFrame:
    """Sums per group and, with nulls for the group, over all."""
    return rows.rollup(*by).agg(*[F.sum(c).alias(c) for c in sums], F.count("*").alias("rows"), F.grouping_id().alias("level")).filter(F.col("level").isin(0, (1 << len(by)) - 1)).drop("level")


def step_summary(results: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run and level: outcome, errors and warnings; levels after the first failing one are left out."""
    from .windows import first_failure

    ran = first_failure(results, [run], [F.col("level_no")], F.col("result") == "fail")
    return ran.select(run, "level_no", "level", "result", "errors_found", "warnings_found")
