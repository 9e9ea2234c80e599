"""Embeddings: any function from texts to vectors; by default a deterministic hashing of words, which needs no model."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

DIM = 256
Embedder = Callable[[list[str]], list[list[float]]]


def hashed(texts: list[str], dim: int = DIM) -> list[list[float]]:
    """Signed counts of words and their letter trigrams, hashed into ``dim`` bins and scaled to length one."""
    out = []
    for text in texts:
        v = np.zeros(dim)
        for w in re.findall(r"\w+", text.lower()):
            for gram, weight in [(w, 1.0), *((f"{w[i:i + 3]}~", 0.3) for i in range(len(w) - 2))]:
                h = int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little")
                v[h % dim] += weight if h >> 63 else -weight
        n = np.linalg.norm(v)
        out.append((v / n if n else v).astype(np.float32).tolist())
    return out


def udf(embed: Embedder) -> Callable[[Column], Column]:
    @F.pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            fine = texts.fillna("")
            yield pd.Series([v if t.strip() else None for t, v in zip(fine, embed(fine.tolist()), strict=True)])

    return run


def embedded(rows: DataFrame, embed: Embedder = hashed, text: str = "text") -> DataFrame:
    """Adds ``embedding`` and its norm. A blank text has none; a row always keeps its own vector."""
    from .vector import norm

    return rows.withColumn("embedding", udf(embed)(F.col(text))).withColumn("norm", norm(F.col("embedding")))
