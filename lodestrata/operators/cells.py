"""A vector index by cells: centroids of a bounded sample, and the nearest centroid of every row as a column.

Search reads the cells nearest to a question. A write gives its rows cells of the fit that is there. A row without a cell, or
with one of another fit, belongs to no cell and is always read, so rollbacks lose no row.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vector import norm

#: Most cells of a fit. A fit's cells are numbered from a multiple of it that no other fit has.
MOST = 1 << 16
#: Rows of the sample for each cell, and the most bytes of the sample and of the centroids (as doubles).
PER_CELL, SAMPLE_BYTES, CENTROID_BYTES = 64, 1 << 28, 1 << 24


def usable(vector: str, dim: int | None = None) -> Column:
    """Whether a vector has a direction: finite components, not all zero, and ``dim`` of them if that is given."""
    v = F.col(vector)
    fine = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (norm(v) > 0)
    return F.coalesce(fine if dim is None else fine & (F.size(v) == dim), F.lit(False))


def unit(vector: str) -> Column:
    """The vector at length 1, where k-means' distance ranks as the cosine does."""
    return F.transform(F.col(vector).cast("array<double>"), lambda x: x / norm(F.col(vector)))


def fit(rows: DataFrame, vector: str = "embedding", cells: int | None = None, seed: int = 7) -> KMeansModel | None:
    """Centroids by k-means for the most frequent vector size, on a random sample of at most ``PER_CELL`` rows a cell and
    ``SAMPLE_BYTES``. Without ``cells``, the square root of the rows. None where fewer than two rows are usable."""
    sizes = rows.filter(usable(vector)).groupBy(F.size(vector).alias("dim")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "dim").first()
    if sizes is None or sizes.n < 2:
        return None
    k = max(2, min(cells or round(sizes.n**0.5), sizes.n, MOST, CENTROID_BYTES // (8 * sizes.dim)))
    most = max(k, min(PER_CELL * k, SAMPLE_BYTES // (8 * sizes.dim)))
    good = rows.filter(usable(vector, sizes.dim)).select(array_to_vector(unit(vector)).alias("features"))
    sample = (good if sizes.n <= most else good.sample(min(1.0, 1.2 * most / sizes.n), seed)).limit(most)
    return KMeans(k=k, seed=seed, maxIter=10).fit(sample)


def first_cell() -> int:
    return time.time_ns() // 1_000_000 * MOST


def assign(rows: DataFrame, model: KMeansModel, first: int, vector: str = "embedding") -> DataFrame:
    """Adds ``cell``, ``first`` and the number of the nearest centroid; null for vectors that aren't usable or of another
    size."""
    dim = len(model.clusterCenters()[0])
    fine = usable(vector, dim)
    features = array_to_vector(F.when(fine, unit(vector)).otherwise(F.array_repeat(F.lit(0.0), dim)))
    placed = model.setFeaturesCol("__features").setPredictionCol("__cell").transform(rows.drop("cell").withColumn("__features", features))
    return placed.withColumn("cell", F.when(fine, F.col("__cell") + F.lit(first))).drop("__features", "__cell")


#: Distances that ``place`` holds at once.
HELD = 1 << 22


def place(rows: DataFrame, centroids: list[tuple[int, list[float]]], vector: str = "embedding") -> DataFrame:
    """Adds ``cell``, the cell with the nearest of stored centroids (of equals the first): how a write keeps to an index that is
    there. Null for vectors that aren't usable or of another size."""
    names = np.array([c for c, _ in centroids], dtype=np.int64)
    middle = np.array([v for _, v in centroids], dtype=np.float64)
    sent = rows.sparkSession.sparkContext.broadcast((names, middle, (middle**2).sum(axis=1)))

    def cell_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, middle, squares = sent.value
        step = max(1, HELD // len(names))
        for batch in batches:
            out = pd.Series(pd.NA, index=batch.index, dtype="Int64")
            known = batch.notna().to_numpy().nonzero()[0]
            for at in range(0, len(known), step):
                some = known[at : at + step]
                units = np.stack(batch.iloc[some].to_numpy())
                out.iloc[some] = names[(squares - 2 * units @ middle.T).argmin(axis=1)]
            yield out

    fine = usable(vector, middle.shape[1])
    return rows.drop("cell").withColumn("cell", F.pandas_udf(cell_of, "bigint")(F.when(fine, unit(vector))))


def nearest(query: list[float], centroids: list[tuple[int, list[float]]], probes: int) -> list[int]:
    """The ``probes`` cells nearest to a question; all, if it has another size or no direction."""
    q = np.asarray(query, float)
    length = np.linalg.norm(q)
    if not length or len(q) != len(centroids[0][1]):
        return [c for c, _ in centroids]
    gaps = np.linalg.norm(np.array([v for _, v in centroids]) - q / length, axis=1)
    return [centroids[i][0] for i in np.argsort(gaps, kind="stable")[:probes]]


def outside(first: int, cell: str = "cell") -> Column:
    """Rows that belong to no cell of the fit that begins at ``first``."""
    return F.col(cell).isNull() | (F.col(cell) < first) | (F.col(cell) >= first + MOST)
