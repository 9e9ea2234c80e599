"""Promotion: recall over golden questions decides whether a staged corpus becomes the production one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import filters, golden, store
from .ingest import Corpus
from .retrieval import Engine


def retrieved(engine: Engine, questions: DataFrame, k: int, default_version: str) -> DataFrame:
    """(id, doc, rank) for each golden question under its own filter. Questions are the caller's small set, and those with
    one filter share one pass over the corpus."""
    groups: dict[tuple, list] = {}
    for q in questions.collect():
        where = filters.golden_filter(dict(q["filter"] or {}), default_version)
        groups.setdefault(tuple(sorted(where.items())), []).append(q)
    out = None
    for where, asked in groups.items():
        hits = engine.search_many([q["question"] for q in asked], k, dict(where))
        ids = engine.corpus.spark.createDataFrame([(i, q["id"]) for i, q in enumerate(asked)], "position int, id string")
        part = hits.join(F.broadcast(ids), "position").select("id", F.col("chunk_id").alias("doc"), "rank")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else engine.corpus.spark.createDataFrame([], "id string, doc string, rank int")


def evaluate(engine: Engine, questions: DataFrame, k: int | None = None, threshold: float | None = None) -> tuple[DataFrame, DataFrame]:
    """Recall per question, and the campaign's one row."""
    s = engine.corpus.settings
    expected = questions.select("id", F.explode("expected_ids").alias("doc")).distinct()
    per = golden.recall(questions, expected, retrieved(engine, questions, k or s.recall_k, s.default_version), k or s.recall_k, "id", "doc")
    return per, golden.campaign(per, s.recall_threshold if threshold is None else threshold)


def promote(staging: Corpus, production: Corpus, questions: DataFrame, threshold: float | None = None, dry_run: bool = False, force: bool = False) -> dict:
    """Make staging's current version production's if the gate passes (or by force); its files are shared, none is copied, and
    older versions stay for rollback."""
    _, verdict = evaluate(Engine(staging), questions, threshold=threshold)
    row = verdict.first().asDict()
    out = {"passed": bool(row["passed"]), "avg_recall": row["avg_recall"], "promoted": False, "snapshot": None}
    rows = staging.chunks.current()
    if rows is not None and (row["passed"] or force) and not dry_run:
        mark = store.fingerprint(rows.withColumn("all", F.lit(1)), ["all"], F.concat_ws("/", "collection", "chunk_id"), F.sha2("text", 256)).first()
        out["checksum"] = mark.fingerprint if mark else None
        out["snapshot"] = production.chunks.adopt(staging.chunks, production.settings.retention_production)
        out["promoted"] = True
    store.audit(staging.spark, production.audit_path, "promote", {k: v for k, v in out.items()} | {"dry_run": dry_run, "force": force})
    return out


def rollback(production: Corpus) -> str:
    name = production.chunks.rollback()
    store.audit(production.spark, production.audit_path, "rollback", {"snapshot": name})
    return name
