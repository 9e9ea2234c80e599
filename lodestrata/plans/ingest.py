"""Ingestion: scan, skip what is unchanged, parse, chunk, embed, upsert, set aside what fails, and log the run.

Whether a file may have changed is told by its path, length and time alone. Only such files are opened: first their hashes are
taken (a file that was merely touched stops here), then the rest is read where it is parsed. No content is ever shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.embedding import Embedder, embedded, hashed
from ..operators import cells, store
from ..operators.versions import Snapshots
from ..session import shared_dir, stored
from ..sources import dumps, extract, files

KINDS = {"lua": "scripts", "java": "api_reference", "html": "web_pages", "markdown": "guides", "archive": "scripts", "config": "configs", "xml": "configs"}


@dataclass
class Corpus:
    """Where a corpus lies: chunk snapshots, index of seen files, quarantine and audit log, below one folder."""

    spark: SparkSession
    root: str
    settings: Settings = field(default_factory=Settings)
    embed: Embedder = hashed

    def __post_init__(self) -> None:
        self.chunks = Snapshots(self.spark, f"{self.root}/chunks", ["collection", "chunk_id"], "ingest_time")
        self.seen = Snapshots(self.spark, f"{self.root}/seen", ["path"])
        self.index = Snapshots(self.spark, f"{self.root}/index", ["cell"])

    def centroids(self) -> list[tuple[int, list[float]]]:
        """The cells of the vector index, in order, with their centroids: at most ``cells.CENTROID_BYTES``. Empty without one."""
        found = self.index.current()
        return [] if found is None else [(r.cell, r.centroid) for r in found.orderBy("cell").collect()]

    @property
    def quarantine_path(self) -> str:
        return f"{self.root}/quarantine"

    @property
    def audit_path(self) -> str:
        return f"{self.root}/audit"


def collection_of(kind: str = "kind"):
    routes = F.create_map(*[F.lit(x) for p in KINDS.items() for x in p])
    return F.coalesce(F.try_element_at(routes, F.col(kind)), F.lit("guides"))


def to_rows(chunks: DataFrame, version: str, embed: Embedder, at: float | None = None) -> DataFrame:
    """Stored rows of chunk rows: routed, stamped with version and time, and embedded. Equal texts are embedded once."""
    rows = chunks if "collection" in chunks.columns else chunks.withColumn("collection", collection_of())
    vectors = embedded(rows.select("text").distinct(), embed)
    stamp = F.lit(at) if at is not None else F.unix_micros(F.current_timestamp()) / 1e6
    return rows.join(vectors, "text", "left").select("collection", "chunk_id", "text", "embedding", "norm", "metadata", "source", F.lit(version).alias("version"), stamp.alias("ingest_time"))


def like(rows: DataFrame, base: DataFrame) -> DataFrame:
    """Rows with the columns of the stored ones; what they lack, such as a cell, is null."""
    return rows.select(*[F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in base.schema])


def build_index(corpus: Corpus, n_cells: int | None = None) -> dict:
    """Fit cells on a bounded sample, give every stored row its cell, and lay rows out by cell. The centroids are noted
    first: until the rows follow, none of them is in a cell, and searches read all."""
    base = corpus.chunks.current()
    model = None if base is None else cells.fit(base, cells=n_cells)
    if model is None:
        return {"cells": 0}
    first = cells.first_cell()
    centroids = [(first + i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    corpus.index.publish(corpus.spark.createDataFrame(centroids, "cell bigint, centroid array<double>"), 1)
    corpus.chunks.publish(cells.assign(base, model, first), corpus.settings.retention_staging)
    store.audit(corpus.spark, corpus.audit_path, "index", {"cells": len(centroids)})
    return {"cells": len(centroids)}


def write(corpus: Corpus, rows: DataFrame, keep: int | None = None) -> str:
    """Upsert rows into the corpus as a new version."""
    return _upsert(corpus, rows.filter(F.trim("text") != ""), None, keep)


def _upsert(corpus: Corpus, rows: DataFrame, gone: DataFrame | None = None, keep: int | None = None) -> str:
    base = corpus.chunks.current()
    if base is not None and "cell" in base.columns and (centroids := corpus.centroids()):  # the index stays in step
        rows = cells.place(rows, centroids)
    return corpus.chunks.upsert(rows if base is None else like(rows, base), corpus.settings.retention_staging if keep is None else keep, gone)


#: Paths that are read in one job: those of candidates are listed, which Spark does in the driver.
LISTED = 50_000


def blocks_of_paths(files_: DataFrame) -> Iterator[list[str]]:
    """The paths of files in blocks."""
    block: list[str] = []
    for row in files_.select("path").toLocalIterator():
        block.append(row.path)
        if len(block) == LISTED:
            yield block
            block = []
    if block:
        yield block


def ingest(corpus: Corpus, folder: str, pattern: str | None = None, recursive: bool = True, at: float | None = None) -> dict:
    """Ingest the new and changed files of a folder; unchanged ones are skipped, failed ones are tried again next time."""
    spark = corpus.spark
    work, chars = shared_dir(spark), corpus.settings.member_chars or None
    found = files.scan(spark, folder, pattern, recursive)
    index = corpus.seen.current()
    same = ["path", "length", "modified"]
    candidates = stored(found.select(*same) if index is None else found.select(*same).join(index.select(*same), same, "left_anti"), f"{work}/candidates")
    spark.createDataFrame([], extract.PARSED).write.parquet(f"{work}/parsed")
    spark.createDataFrame([], "path string, file_hash string, wide boolean").write.parquet(f"{work}/hashes")
    for block in blocks_of_paths(candidates):
        extract.hashed(files.named(spark, block)).write.mode("append").parquet(f"{work}/hashes")
    hashes = spark.read.parquet(f"{work}/hashes")
    touched = None if index is None else hashes.join(index.select("path", "file_hash"), ["path", "file_hash"], "left_semi").select("path", "file_hash")
    for block in blocks_of_paths(hashes if touched is None else hashes.join(touched, "path", "left_anti")):
        extract.read(spark, block, hashes, chars).write.mode("append").parquet(f"{work}/parsed")
    parsed = spark.read.schema(extract.PARSED).parquet(f"{work}/parsed")
    failed, fine = extract.bad(parsed), extract.good(parsed)
    counts = parsed.agg(F.count_distinct("source").alias("files"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("source"))).alias("failed")).first()
    if counts.failed:
        store.quarantine(failed, corpus.quarantine_path)
    summary = {"files": counts.files, "failed": counts.failed, "chunks": 0}
    if not fine.isEmpty():
        rows = to_rows(extract.chunks(parsed, corpus.settings.chunk_size), corpus.settings.default_version, corpus.embed, at)
        rows.write.parquet(f"{work}/rows")
        rows = spark.read.parquet(f"{work}/rows")
        summary["chunks"] = rows.count()
        _upsert(corpus, rows, rows.select("source").distinct())  # a changed file's old chunks go
    known = fine.select(F.col("source").alias("path"), "file_hash").distinct().join(failed.select(F.col("source").alias("path")), "path", "left_anti")
    known = stored((known if touched is None else known.unionByName(touched)).join(candidates, "path").select(*same, "file_hash"), f"{work}/known")
    if not known.isEmpty():
        corpus.seen.upsert(known, 1)
    store.audit(spark, corpus.audit_path, "ingest", summary | {"folder": folder})
    return summary


def ingest_dump(corpus: Corpus, path: str, at: float | None = None) -> dict:
    """Upsert the entities of a dump, long cards in pieces; pieces of an earlier version that are no more go."""
    rows = dumps.chunks(dumps.normalise(dumps.read(corpus.spark, path))).withColumn("source", F.concat_ws("/", F.lit(path), "key"))
    made = stored(to_rows(rows, corpus.settings.default_version, corpus.embed, at))
    if corpus.chunks.current() is None:
        write(corpus, made)
    else:
        _upsert(corpus, made, made.select("source").distinct())
    summary = {"chunks": made.count()}
    store.audit(corpus.spark, corpus.audit_path, "dump", summary | {"path": path})
    return summary


def drop_rows(corpus: Corpus, ids: list[str]) -> str:
    return corpus.chunks.delete(corpus.spark.createDataFrame([(i,) for i in ids], "chunk_id string"), corpus.settings.retention_staging)


def drop_collection(corpus: Corpus, name: str) -> str:
    return corpus.chunks.delete_where(F.col("collection") == name, ["collection"], corpus.settings.retention_staging)
