"""Similar pairs of sets by Jaccard's measure, without meeting on frequent elements.

Elements are ordered by how many sets hold them, the rarest first. Two sets that are similar enough share one of the first few
elements of each, so only these are joined: frequent elements come last and fall away. Pairs whose sizes differ too much, or
whose places leave too few common elements, go before they are verified; a pair is verified where its first common element is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ordered(rows: DataFrame, key: str, elements: str) -> DataFrame:
    """``key`` and ``set``, the distinct elements of each row's array, the rarest first. Keys are distinct; empty sets go."""
    each = rows.select(F.col(key).alias("__k"), F.explode(F.array_distinct(elements)).alias("__e")).filter("__e IS NOT NULL")
    held = each.groupBy("__e").agg(F.count("*").alias("__n"))
    # what is gathered is a row's own set
    sets = each.join(held, "__e").groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__n", "__e"))).alias("__s"))
    return sets.select(F.col("__k").alias(key), F.transform("__s", lambda x: x["__e"]).alias("set"))


def candidates(sets: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs (a, b) with a < b, each once, that no bound rules out, with both sets."""
    n = F.size("set")
    # of a set's elements so many may lie outside of another that is similar enough, and one more
    first = F.greatest(F.lit(1), n - F.ceil(F.lit(least) * n - 1e-9).cast("int") + 1)
    spread = sets.select(F.col(key).alias("k"), "set", F.posexplode(F.slice("set", F.lit(1), first)).alias("at", "e"))
    one, two = spread.select(*[F.col(c).alias(f"{c}1") for c in spread.columns]), spread.select(*[F.col(c).alias(f"{c}2") for c in spread.columns])
    met = one.join(two, (F.col("e1") == F.col("e2")) & (F.col("k1") < F.col("k2")))
    n1, n2 = F.size("set1"), F.size("set2")
    fits = (n1 >= F.lit(least) * n2 - 1e-9) & (n2 >= F.lit(least) * n1 - 1e-9)
    left = 1 + F.least(n1 - F.col("at1") - 1, n2 - F.col("at2") - 1)
    enough = left >= F.lit(least / (1 + least)) * (n1 + n2) - 1e-9
    earlier = F.arrays_overlap(F.slice("set1", F.lit(1), F.col("at1")), F.slice("set2", F.lit(1), F.col("at2")))
    # before its first common element a pair has none, so ``left`` bounds all it can share
    return met.filter(fits & ~earlier & enough).select(F.col("k1").alias("a"), F.col("k2").alias("b"), "set1", "set2")


def similar_pairs(rows: DataFrame, key: str, elements: str, least: float) -> DataFrame:
    """a, b and similarity (six digits) of the pairs of rows whose sets have a Jaccard similarity of at least ``least`` (above 0)."""
    pairs = candidates(ordered(rows, key, elements), key, least)
    shared = F.size(F.array_intersect("set1", "set2"))
    similarity = shared / (F.size("set1") + F.size("set2") - shared)
    return pairs.select("a", "b", F.round(similarity, 6).alias("similarity")).filter(F.col("similarity") >= least)
