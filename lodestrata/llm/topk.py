"""Exact top-k search by inner product.

Queries are taken in blocks of bounded size, which is what is broadcast. Each task lays its shard of the vectors out in
tiles, multiplies a tile with the block, selects the best k of the tile per query and merges them into the list it holds
for that query. The lists of all tasks, at most k rows per query each, are merged in a tree of fixed fan-in, so no task
reads more than fan-in lists of a query. More queries mean more passes over the vectors, never larger tasks.

Components are floor(scale * x); products are exact: in floating point while all partial sums stay below 2**53, else in
whole numbers of any size (results are held to the range of long). Ties go to the smaller id. A vector that is null or
holds a null or non-finite component takes no part, nor does a row with a null id. Vectors are only compared with
vectors of the same length. A row with the query's own id is the query itself; rows that repeat a query's id ask once,
and rows that repeat another id count as candidates each. Blocks and tiles are bounded by bytes as well, so long vectors
come in smaller ones. An empty table, or no queries, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

#: Queries in a block and rows in a tile, and the bytes of their vectors: a tile of products holds 32 MB. Queries are dealt
#: into blocks by hash, so a block holds at least ``LEAST_QUERIES`` on average, which keeps it near its bound.
BLOCK_QUERIES = 32_768
SLICE_QUERIES = 2_048
TILE_ROWS = 2_048
BLOCK_BYTES = TILE_BYTES = 16 << 20
LEAST_QUERIES = 64
FAN_IN = 32
#: Blocks whose lists are merged in one plan; with more, each block's lists are stored first.
LAZY_BLOCKS = 4
EXACT = float(1 << 53)
PART = "query_id long, vec_id long, score long, part int"


def usable(vector: Column) -> Column:
    """Whether a vector is whole: not null, and no component is null, infinite or not a number."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(math.inf))), F.lit(False))


def quantized(column: pa.Array, scale: float) -> list[np.ndarray]:
    """The vectors of an Arrow column of whole lists, scaled and floored."""
    values = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T, exact, as int64."""
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1]
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(a).astype(object) @ whole(b).astype(object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class TopLists:
    """The best k of what was seen, for each query of one block; ``merge`` takes one tile."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merge(self, ids: np.ndarray, tile: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        ids, tile = ids[order], tile[order]
        rows, cols, scores = [], [], []
        for at in range(0, len(self.ids), SLICE_QUERIES):
            got = products(self.vectors[at : at + SLICE_QUERIES], tile)
            own = self.ids[at : at + SLICE_QUERIES, None] == ids[None, :]
            # the k-th best of each row bounds what can be in its list
            if got.shape[1] > self.k:
                low = np.where(own, np.iinfo(np.int64).min, got)
                floor = np.partition(low, low.shape[1] - self.k, axis=1)[:, low.shape[1] - self.k]
                chosen = (got > floor[:, None]) & ~own
                ties = (got == floor[:, None]) & ~own
                room = self.k - chosen.sum(axis=1, keepdims=True)
                chosen |= ties & (np.cumsum(ties, axis=1) <= room)
            else:
                chosen = ~own
            r, c = np.nonzero(chosen)
            rows.append(r + at)
            cols.append(ids[c])
            scores.append(got[r, c])
        self.best.append((np.concatenate(rows), np.concatenate(cols), np.concatenate(scores)))
        if len(self.best) >= 8:
            self._reduce()

    def _reduce(self) -> None:
        rows, ids, scores = (np.concatenate(x) for x in zip(*self.best, strict=True))
        order = np.lexsort((ids, ~scores, rows))
        rows, ids, scores = rows[order], ids[order], scores[order]
        first = np.searchsorted(rows, rows, side="left")
        kept = np.arange(len(rows)) - first < self.k
        self.best = [(rows[kept], ids[kept], scores[kept])]

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.best:
            self._reduce()
        rows, ids, scores = self.best[0] if self.best else (np.zeros(0, dtype=np.int64),) * 3
        return self.ids[rows], ids, scores


def _search(block: Broadcast, k: int, scale: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tops: dict[int, TopLists] = {n: TopLists(ids, vectors, k) for n, (ids, vectors) in block.value.items()}
    held: dict[int, list[tuple[int, np.ndarray]]] = {}

    def flush(n: int) -> None:
        rows = held.pop(n)
        tops[n].merge(np.array([i for i, _ in rows], dtype=np.int64), np.stack([v for _, v in rows]))

    for batch in batches:
        for vec_id, vector in zip(batch.column(0).to_pylist(), quantized(batch.column(1), scale), strict=True):
            n = len(vector)
            if n in tops:
                held.setdefault(n, []).append((vec_id, vector))
                if len(held[n]) >= max(1, min(TILE_ROWS, TILE_BYTES // max(1, 8 * n))):
                    flush(n)
    for n in list(held):
        flush(n)
    part = TaskContext.get().partitionId()
    for top in tops.values():
        q, v, s = top.lists()
        yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64()), pa.array(np.full(len(q), part), pa.int32())], ["query_id", "vec_id", "score", "part"])


def _best(lists: DataFrame, keys: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id"))
    return lists.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score of the best k rows of ``vectors`` for each of ``queries``."""
    spark = vectors.sparkSession

    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector_col).cast("array<double>")
        return df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("embedding")).filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))

    candidates = whole(vectors)
    asked = stored(whole(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding")))
    count, longest = asked.agg(F.count("*"), F.max(F.size("embedding"))).first()
    most = min(BLOCK_QUERIES, max(LEAST_QUERIES, BLOCK_BYTES // max(1, 8 * (longest or 0))))
    blocks = max(1, math.ceil(count / most))
    table = f"{shared_dir(spark)}/lists"
    parts = None
    for b in range(blocks):
        # hashed into blocks, each of which is checked against the bound
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).limit(2 * most + 1).toArrow()
        if rows.num_rows > 2 * most:
            raise RuntimeError("a block of queries is larger than its bound")
        by: dict[int, list[tuple[int, np.ndarray]]] = {}
        for vec_id, vector in zip(rows.column(0).to_pylist(), quantized(rows.column(1).combine_chunks(), scale), strict=True):
            by.setdefault(len(vector), []).append((vec_id, vector))
        block = spark.sparkContext.broadcast({n: (np.array([i for i, _ in x], dtype=np.int64), np.stack([v for _, v in x])) for n, x in by.items()})
        found = candidates.mapInArrow(functools.partial(_search, block, k, scale), PART)
        if blocks > LAZY_BLOCKS:
            found.write.mode("append").parquet(table)
            block.unpersist()
        else:
            parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        parts = spark.read.schema(PART).parquet(table)
    tasks = candidates.rdd.getNumPartitions()
    while tasks > FAN_IN:
        parts = _best(parts.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")), ["query_id", "part"], k).drop("rank")
        tasks = math.ceil(tasks / FAN_IN)
    return _best(parts, ["query_id"], k).select("query_id", "rank", "vec_id", "score")
