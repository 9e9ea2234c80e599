"""Retrieval over a corpus: search in one, several or all collections, exact lookups, guides, prompts."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import INTENT_COLLECTIONS
from ..functions.text import prose
from ..functions.vector import cosine, norm
from ..operators import cells, filters, search
from ..operators.quality import intent, item_id
from .ingest import Corpus

COLUMNS = ["collection", "chunk_id", "text", "score", "distance", "metadata"]


def answers(hits: DataFrame, *more: str) -> DataFrame:
    """The columns of answers; texts are brought into form only here, after the best are chosen."""
    return hits.withColumn("text", prose(F.col("text"))).select(*more, *COLUMNS)


class Engine:
    """Questions to a corpus. All answers are DataFrames; a missing corpus answers with no rows."""

    def __init__(self, corpus: Corpus):
        self.corpus = corpus

    def rows(self) -> DataFrame:
        found = self.corpus.chunks.current()
        if found is None:
            return self.corpus.spark.createDataFrame([], "collection string, chunk_id string, text string, embedding array<float>, norm double, metadata string, source string, version string, ingest_time double")
        return found

    def _queries(self, texts: list[str]) -> DataFrame:
        vectors = self.corpus.embed(texts)
        return self.corpus.spark.createDataFrame([(i, t, v) for i, (t, v) in enumerate(zip(texts, vectors, strict=True))], "position int, query string, query_vector array<float>")

    def _field(self, key: str):
        stored = {"version": "version", "game_version": "version", "source": "source", "collection": "collection"}
        return F.col(stored[key]) if key in stored else F.get_json_object("metadata", f"$.{filters.ALIASES.get(key, key)}")

    def hits(self, texts: list[str], where: dict[str, Any] | None = None, collections: list[str] | None = None, probes: int | None = None) -> DataFrame:
        """All rows with their score for each text; with ``probes``, those of the text's nearest cells and those that are in
        no cell. Without an index, ``probes`` changes nothing."""
        rows = self.rows().filter(filters.compile_filter(where, self._field)).filter(F.col("embedding").isNotNull())
        if collections:
            rows = rows.filter(F.col("collection").isin(*collections))
        q = self._queries(texts).withColumn("query_norm", norm(F.col("query_vector")))
        near = F.lit(True)
        centroids = self.corpus.centroids() if probes is not None and "cell" in rows.columns else []
        if centroids:
            wanted = [cells.nearest(v, centroids, max(1, probes)) for v in self.corpus.embed(texts)]
            loose = cells.outside(centroids[0][0])
            rows = rows.filter(loose | F.col("cell").isin(sorted({c for w in wanted for c in w})))  # reaches the scan
            read = self.corpus.spark.createDataFrame(list(enumerate(wanted)), "position int, probed array<bigint>")
            q = q.join(F.broadcast(read), "position")
            near = loose | F.array_contains("probed", F.col("cell"))
        score = cosine(F.col("embedding"), F.col("query_vector"), F.col("norm"), F.col("query_norm"))
        out = rows.join(F.broadcast(q), near).withColumn("score", F.round(score, 6)).filter(F.col("score").isNotNull() & ~F.isnan("score"))  # a NaN would rank first
        return out.withColumn("distance", F.round(1 - F.col("score"), 6))

    def search(self, text: str, k: int = 5, where: dict[str, Any] | None = None, collections: list[str] | None = None, threshold: float | None = None, probes: int | None = None) -> DataFrame:
        """The best k; of all rows, or with ``probes`` of that many cells of the index."""
        hits = self.hits([text], where, collections, probes)
        if threshold is not None:
            hits = search.above(hits, threshold)
        return answers(search.top_k(hits.withColumn("__key", F.concat_ws("/", "collection", "chunk_id")), k, "__key"))

    def search_all(self, text: str, k: int = 10, where: dict[str, Any] | None = None) -> DataFrame:
        """All collections, each with at most its quota."""
        n = self.rows().select("collection").distinct().count()
        return answers(search.with_quota(self.hits([text], where), "collection", k, n, "chunk_id"))

    def search_many(self, texts: list[str], k: int = 5, where: dict[str, Any] | None = None, probes: int | None = None) -> DataFrame:
        """The best k of each text, in the texts' order."""
        return answers(search.top_k_by(self.hits(texts, where, probes=probes),["position"], k, "chunk_id"), "position", "query", "rank").orderBy("position", "rank")

    def search_by_collection(self, text: str, k: int = 5) -> DataFrame:
        return answers(search.top_k_by(self.hits([text]), ["collection"], k, "chunk_id"), "rank")

    def get(self, chunk_id: str, collection: str | None = None, version: str | None = None) -> DataFrame:
        out = self.rows().filter(F.col("chunk_id") == chunk_id)
        if collection:
            out = out.filter(F.col("collection") == collection)
        return out.filter(F.col("version") == version.strip().lower()) if version else out

    def lookup(self, chunk_id: str, text: str, collection: str | None = None) -> DataFrame:
        """The row with this id, or else the best hit for the text."""
        exact = self.get(chunk_id, collection).select("collection", "chunk_id", "text", F.lit(1.0).alias("score"), F.lit(0.0).alias("distance"), "metadata")
        near = self.search(text, 1, collections=[collection] if collection else None)
        return exact.unionByName(near.join(exact.select(F.lit(1).alias("__any")).limit(1), how="left_anti"))

    def collections(self) -> DataFrame:
        return self.rows().groupBy("collection").agg(F.count("*").alias("n"), F.max("ingest_time").alias("last_ingest"))

    def health(self, dim: int | None = None) -> DataFrame:
        out = self.rows().groupBy("collection").agg(F.count("*").alias("n"), F.count("embedding").alias("embedded"), F.max(F.size("embedding")).alias("dim"))
        return out.withColumn("healthy", (F.col("n") == F.col("embedded")) & (F.lit(dim is None) | (F.col("dim") == F.lit(dim or 0))))

    def answer_context(self, message: str, k: int = 5) -> DataFrame:
        """What a message is about: rows of the item it names, else hits in the collections of its intent."""
        asked = self.corpus.spark.createDataFrame([(message,)], "text string").select(intent(F.col("text")).alias("intent"), item_id(F.col("text")).alias("item")).first()
        if asked.item and self.get(asked.item).limit(1).count():
            return self.lookup(asked.item, message)
        wanted = INTENT_COLLECTIONS.get(asked.intent) if asked.intent != "search" else None
        return self.search(message, k, collections=wanted)

    def prompt(self, message: str, k: int = 5, limit: int = 2000) -> str:
        """Instructions, the k best passages with their places, and the question; the model's call is the caller's."""
        parts = [f"[{r.collection}/{r.chunk_id}]\n{r.text[:limit]}" for r in self.answer_context(message, k).orderBy(F.col("score").desc(), "chunk_id").collect()]
        return "\n\n".join(["Answer from these passages only.", *parts, f"Question: {message}"])
