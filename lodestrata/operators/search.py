"""Vector search over chunks: top-k in one collection, across collections, with quotas, for many queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import METRICS, valid


def scored(vectors: DataFrame, queries: DataFrame, metric: str = "cosine", vector: str = "embedding", query: str = "query_vector") -> DataFrame:
    """Each query with each row and its ``score``. The queries are the caller's few; Spark broadcasts them if they are
    below its size limit and otherwise splits the nested loop itself."""
    score, _ = METRICS[metric]
    # sizes are compared in the join, so that the score itself is computed once, after it
    pairs = queries.join(vectors.filter(F.col(vector).isNotNull()), F.size(vector) == F.size(query))
    return pairs.withColumn("score", F.round(score(F.col(vector), F.col(query)), 6))


def order(metric: str, *ties: str) -> list[Column]:
    best = F.col("score").desc() if METRICS[metric][1] else F.col("score").asc()
    return [best, *[F.col(t) for t in ties]]


def top_k(hits: DataFrame, k: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """The best k of a single query: per-task heaps, merged."""
    return hits.orderBy(*order(metric, id_col)).limit(k)


def top_k_by(hits: DataFrame, by: list[str], k: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """The best k per query or collection, with ``rank``; tasks cut to k before the shuffle."""
    w = Window.partitionBy(*by).orderBy(*order(metric, id_col))
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def above(hits: DataFrame, threshold: float) -> DataFrame:
    return hits.filter(F.col("score") >= threshold)


def with_quota(hits: DataFrame, collection: str, k: int, n_collections: int, id_col: str, metric: str = "cosine") -> DataFrame:
    """At most max(1, k // collections) rows of each collection, then the best k of all."""
    quota = max(1, k // max(1, n_collections))
    return top_k(top_k_by(hits, [collection], quota, id_col, metric).drop("rank"), k, id_col, metric)


def exact_or_nearest(requested: DataFrame, rows: DataFrame, nearest: DataFrame, id_col: str) -> DataFrame:
    """Per requested id: the row itself, or else the best semantic hit; ``match`` tells which."""
    exact = requested.join(rows, requested["requested_id"] == rows[id_col], "left")
    best = nearest.limit(1).select(F.col(id_col).alias("__best"))
    out = exact.join(F.broadcast(best), how="left")
    hit = F.col(id_col).isNotNull()
    return out.select("requested_id", F.when(hit, F.col(id_col)).otherwise(F.col("__best")).alias(id_col), F.when(hit, "exact").otherwise("semantic").alias("match"))


def usable(vectors: DataFrame, dim: int, vector: str = "embedding") -> DataFrame:
    return vectors.filter(valid(F.col(vector), dim))
