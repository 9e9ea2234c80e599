"""What operators on vectors share: which rows take part, exact whole numbers in numpy, Gramian matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .topk import usable

#: Whole numbers below this are exact as doubles; sums and products of int64 below the other can't overflow.
EXACT = 1 << 53
SAFE = 1 << 62


def kept(df: DataFrame, columns: list[Column], vector_col: str) -> tuple[DataFrame, int, int]:
    """The columns and ``vector`` (array of doubles) of the rows that take part, their number and their vectors' length.

    A vector takes part if it's whole (not null, no component null or not finite) and has the length that most whole
    vectors have (of lengths as frequent, the shorter). Without rows, both numbers are 0."""
    rows = df.select(*columns, F.col(f"`{vector_col}`").cast("array<double>").alias("vector")).filter(usable(F.col("vector")))
    most = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.col("count").desc(), "size").first()
    if most is None:
        return rows.limit(0), 0, 0
    return rows.filter(F.size("vector") == most["size"]), most["count"], most["size"]


def whole(values: np.ndarray) -> np.ndarray:
    """Doubles that hold whole numbers, as int64 or, beyond what doubles tell apart, as Python's integers."""
    if np.abs(values).max(initial=0) < EXACT:
        return values.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(values).astype(object)


def largest(values: np.ndarray) -> int:
    return int(np.abs(values).max(initial=0))


def gramian(vectors: DataFrame, size: int) -> np.ndarray:
    """Sum of the outer products of a column ``vector`` of arrays; a size x size matrix, which the driver holds."""
    rows = MLUtils.convertVectorColumnsFromML(vectors.select(array_to_vector("vector").alias("vector")), "vector")
    return RowMatrix(rows, 0, size).computeGramianMatrix().toArray()
