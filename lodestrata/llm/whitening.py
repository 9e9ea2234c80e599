"""Embedding whitening: principal components of exactly centred vectors, each scaled to variance one.

Entries become whole numbers floor(scale * c) + shift, so sums are exact and n * x - S, the centred entry times n, is a whole
number too; only then is it divided. The covariance is the Gramian matrix of the centred rows (``RowMatrix``, summed in a
tree) over n. Its eigenvectors are found in the driver, which holds d x d numbers, d being the vectors' length; what is
broadcast to the tasks is d x k numbers. Tasks centre and project their rows batch by batch; no row is shuffled.

Rows whose vector is null or holds a null or non-finite entry take no part; nor do, where lengths differ, vectors of other
lengths than the most frequent (of equally frequent ones the shorter). Rows without an id and repeated rows stay and count
each. Components are numbered by falling eigenvalue; directions without variance have none, so constant or single vectors
give no components. The largest entry of a component's direction is positive. A deviation beyond the range of long is null.
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vectors import EXACT, SAFE, gramian, kept, largest, whole

COMPONENTS = 32
SCALE, SHIFT = 64.0, 1_000_000
LONG = (1 << 63) - 1


@dataclass
class Whitening:
    """n and exact sums of the fit list, and the kept components: eigenvalues, unit directions (columns), all variance."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    scale: float = SCALE
    shift: int = SHIFT

    @property
    def explained(self) -> list[float]:
        return (self.values / self.trace).tolist() if len(self.values) else []


def entries(vectors: pd.Series, scale: float, shift: int) -> np.ndarray:
    """A row of whole numbers for each vector."""
    x = np.floor(np.stack(vectors.to_numpy()).astype(np.float64) * scale)
    if np.abs(x).max(initial=0) < EXACT - abs(shift):
        x += shift
        return whole(x)
    return whole(x) + shift


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact."""
    if n * largest(x) + max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _sum(scale: float, shift: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = None
    for batch in batches:
        if len(batch):
            x = entries(batch["vector"], scale, shift)
            exact = x if largest(x) * len(x) < SAFE else x.astype(object)
            part = exact.sum(axis=0).astype(object)
            total = part if total is None else total + part
    if total is not None:
        yield pd.DataFrame({"place": np.arange(len(total), dtype=np.int32), "total": [str(v) for v in total]})


def _centre(n: int, sums: list[int], scale: float, shift: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            d = centred(entries(batch["vector"], scale, shift), n, sums)
            yield pd.DataFrame({"vector": list(d.astype(np.float64) / n)})


def _whiten(model, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    m: Whitening = model.value
    project = m.directions / np.sqrt(m.values)
    for batch in batches:
        if not len(batch):
            continue
        d = centred(entries(batch["vector"], m.scale, m.shift), m.n, m.sums)
        exact = d if largest(d) ** 2 * d.shape[1] < SAFE else d.astype(object)
        deviation = [v if v <= LONG else None for v in (exact * exact).sum(axis=1).tolist()]
        yield pd.DataFrame({"id": batch["id"], "deviation": pd.array(deviation, dtype="Int64"), "whitened": list(d.astype(np.float64) / m.n @ project)})


def fit(df: DataFrame, components: int = COMPONENTS, scale: float = SCALE, shift: int = SHIFT, vector_col: str = "embedding") -> Whitening:
    """Fit on all vectors that take part: three passes over them (length and count, sums, Gramian)."""
    rows, n, size = kept(df, [], vector_col)
    if not n or not size:
        return Whitening(n, [0] * size, np.zeros(0), np.zeros((size, 0)), 0.0, scale, shift)
    told = rows.mapInPandas(functools.partial(_sum, scale, shift), "place int, total string")
    # one row for each place of a vector
    sums = [int(r.total) for r in told.groupBy("place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).orderBy("place").collect()]
    middle = rows.mapInPandas(functools.partial(_centre, n, sums, scale, shift), "vector array<double>")
    covariance = gramian(middle, size) / n
    values, directions = np.linalg.eigh((covariance + covariance.T) / 2)
    values, directions = values[::-1], directions[:, ::-1]
    some = int((values > max(values[0], 0.0) * size * np.finfo(float).eps).sum())
    k = min(components, some)
    values, directions = values[:k].copy(), directions[:, :k].copy()
    if k:
        directions *= np.sign(directions[np.abs(directions).argmax(axis=0), np.arange(k)])
    return Whitening(n, sums, values, directions, float(np.trace(covariance)), scale, shift)


def apply(df: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``id_col``, deviation (sum over the entries of (n * x - S) squared) and whitened (array of doubles, one for each
    component) of the rows whose vector is whole and as long as those of the fit."""
    rows, n, size = kept(df, [F.col(f"`{id_col}`").alias("id")], vector_col)
    kind = dict(df.dtypes)[id_col]
    schema = f"id {kind}, deviation long, whitened array<double>"
    if not n or size != len(model.sums):
        rows = rows.limit(0)
    out = rows.mapInPandas(functools.partial(_whiten, df.sparkSession.sparkContext.broadcast(model)), schema)
    return out.withColumnRenamed("id", id_col)


def identity_error(whitened: DataFrame, components: int) -> float:
    """The largest absolute entry of the covariance of ``whitened`` minus the identity, measured on the rows; read twice,
    so they should be stored."""
    if not components:
        return 0.0
    means = whitened.agg(F.count("*"), *[F.avg(F.col("whitened")[i]) for i in range(components)]).first()
    if not means[0]:
        return 0.0
    middle = whitened.select(F.zip_with("whitened", F.array(*[F.lit(float(m)) for m in means[1:]]), lambda a, b: a - b).alias("vector"))
    return float(np.abs(gramian(middle, components) / means[0] - np.eye(components)).max())
