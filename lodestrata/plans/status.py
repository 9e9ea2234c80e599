"""Status of a corpus: collections, alerts, quarantine, coverage, as tables and as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators import monitoring, quality
from .ingest import Corpus
from .retrieval import Engine


def missing_collections(engine: Engine, expected: list[str]) -> DataFrame:
    want = engine.corpus.spark.createDataFrame([(c,) for c in expected], "collection string")
    return want.join(engine.collections(), "collection", "left_anti")


def quarantined(corpus: Corpus) -> DataFrame:
    """Quarantined files by day and reason."""
    schema = "source string, kind string, reason string, snippet string, at timestamp, day date"
    try:
        rows = corpus.spark.read.schema(schema).json(corpus.quarantine_path)
    except AnalysisException:
        rows = corpus.spark.createDataFrame([], schema)
    return rows.groupBy("day", "reason").agg(F.count("*").alias("n"))


def coverage(engine: Engine, expected: dict[str, int]) -> DataFrame:
    """Rows against expected rows per collection, also of missing ones."""
    want = engine.corpus.spark.createDataFrame(list(expected.items()), "collection string, expected long")
    out = F.broadcast(want).join(engine.collections().select("collection", "n"), "collection", "left").na.fill(0, ["n"])
    return out.withColumn("share", monitoring.pct(F.col("n"), F.col("expected"), 2)).withColumn("status", monitoring.status_of(F.col("share")))


def alerts(engine: Engine, expected: dict[str, int]) -> DataFrame:
    """Missing or empty collections are critical, those under half covered a warning, those older than the newest by over 48
    hours information."""
    table = coverage(engine, expected)
    age = engine.collections().withColumn("newest", F.lit(engine.collections().agg(F.max("last_ingest")).first()[0]))
    old = age.filter(F.col("newest") - F.col("last_ingest") > engine.corpus.settings.stale_hours * 3600)
    named = lambda df: df.select(F.col("collection").alias("subject"))
    return monitoring.alerts(named(table.filter("n = 0")), named(table.filter("share > 0 and share < 50")), named(old))


def validation(engine: Engine, dim: int | None = None) -> DataFrame:
    rows = engine.rows()
    share = lambda c: F.coalesce(F.round(F.try_divide(F.count_if(c), F.count("*")), 6), F.lit(1.0))
    checks = {"without embedding": (share(F.col("embedding").isNull()), 0.0, 0.05), "blank text": (share(F.trim("text") == ""), 0.0, 0.0), "bad metadata": (share(F.try_parse_json("metadata").isNull()), 0.0, 0.1)}
    if dim:
        checks["wrong size"] = (share(F.size("embedding") != dim), 0.0, 0.0)
    return quality.report(rows, checks)


def report(engine: Engine, expected: dict[str, int], form: str = "text") -> str:
    """The status as text, Markdown or JSON."""
    parts = {"coverage": coverage(engine, expected), "alerts": alerts(engine, expected), "quarantine": quarantined(engine.corpus), "checks": validation(engine)}
    data = {name: [r.asDict() for r in df.orderBy(*df.columns[:2]).collect()] for name, df in parts.items()}
    if form == "json":
        return json.dumps(data, default=str, sort_keys=True)
    lines = []
    for name, rows in data.items():
        lines.append(f"## {name}" if form == "markdown" else name.upper())
        if form == "markdown" and rows:
            lines += ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *("| " + " | ".join(str(v) for v in r.values()) + " |" for r in rows)]
        else:
            lines += ["  ".join(f"{k}={v}" for k, v in r.items()) for r in rows] or ["none"]
    return "\n".join(lines)
