"""Mixing sources to target weights.

Words are summed per source. Sources in code point order, null last, weigh ``weights`` in turn and share ``share`` times
all words, where a source's target stops at ``cap`` times its words and the excess is shared again by weight until no
target is above. The rate of a source is its target over its words. Each document is emitted floor(rate) times, plus
once more if a hash of its id (of its text, where the id is null) falls below the rate's fraction; so the copies of one
document depend on itself alone, and reruns agree.

Sizes are counted in one pass and stored with ids only. Sums are partial before they are shuffled; a hot source costs
one row for each task. Rates come back to the rows by ``keyed_join``, so neither a hot source nor many sources meet in
one task, and what is broadcast has at most a thousand rows. The order of sources comes from a running sum over ranges.
Sharing again takes a few rounds over the sources' sums, each a single aggregate.

Null and empty texts have size 0 and are emitted like others; very long texts are counted whole. A null source is a source
of its own, after all others. Repeated rows and rows that share an id get the same number of copies, as do equal texts
without ids. A source without words has target 0 and rate 0. An empty table gives no rows. Only ``doc_id``, ``text`` and ``source`` are read; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.windows import running_sum
from .common import keyed_join, map_rows, shared_dir, slices, stored, text_bytes, words

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: Tells sources from the null source in keys.
NAMED, UNNAMED = "s:", "n"


def _sizes(rows: Iterator[tuple]) -> Iterator[tuple]:
    for doc_id, mark, source, text in rows:
        yield doc_id, mark, source, sum([len(words(part)) for part in slices(text or b"")])


def mark() -> Column:
    """What stands for the id in a row without one: a hash of the text."""
    return F.when(F.col("doc_id").cast("long").isNull(), F.md5(F.coalesce(text_bytes(), F.lit(b""))))


def source_key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit(UNNAMED)).otherwise(F.concat(F.lit(NAMED), source.cast("string")))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, mark, key of the source, size; stored."""
    counted = map_rows(docs, [F.col("doc_id").cast("long"), mark(), F.col("source").cast("string"), text_bytes()], _sizes, "doc_id long, mark string, source string, size long")
    return stored(counted.select("doc_id", "mark", "source", source_key(F.col("source")).alias("key"), "size"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per source key: rows, source_size and target; stored."""
    spark = sized.sparkSession
    sums = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    ranked = running_sum(sums, [], [F.col("source").asc_nulls_last()], F.lit(1), "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    at = shared_dir(spark)
    table = stored(ranked.select("key", "source_size", "rows", weight.alias("weight")), f"{at}/weights")
    limit = F.col("source_size") * F.lit(cap)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while total:
        # level: words per weight of the sources that are below their limit; it only rises
        free = F.col("weight") * F.lit(level) < limit
        row = table.agg(F.sum(F.when(free, F.col("weight"))).alias("w"), F.sum(F.when(~free, limit)).alias("full")).first()
        after = (share * total - (row.full or 0.0)) / row.w if row.w else level
        if after <= level:
            break
        level = after
    target = F.least(F.col("weight") * F.lit(level), limit)
    return stored(table.select("key", "source_size", "rows", target.alias("target")), f"{at}/targets")


def copies(doc_id: Column, mark: Column, rate: Column) -> Column:
    """floor(rate), plus one with the probability of the fraction, seeded by the id or what stands for it."""
    seed = F.substring(F.md5(F.concat(F.lit("mix:"), F.coalesce(doc_id.cast("string"), mark))), 1, 12)
    drawn = F.conv(seed, 16, 10).cast("double") / F.lit(float(16**12))
    return (F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def rate(target: Column, source_size: Column) -> Column:
    return F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies and taken words."""
    sized = sizes(docs)
    joined = keyed_join(sized, targets(sized, weights, share, cap), "key", "rows", ["source_size", "target"])
    times = copies(F.col("doc_id"), F.col("mark"), rate(F.col("target"), F.col("source_size")))
    return joined.select("doc_id", "source", "size", "source_size", "target", times.alias("copies"), (F.col("size") * times).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with its own columns only.

    Only the rates, one row per source, are joined to the rows; texts aren't shuffled for the (at most 1,000) largest
    sources.
    """
    rates = targets(sizes(docs), weights, share, cap)
    keyed = docs.withColumn("__key", source_key(F.col("source")))
    joined = keyed_join(keyed, rates.withColumnRenamed("key", "__key").withColumnsRenamed({"source_size": "__size", "target": "__target"}), "__key", "rows", ["__size", "__target"])
    times = copies(F.col("doc_id").cast("long"), mark(), rate(F.col("__target"), F.col("__size")))
    again = joined.withColumn("__copies", times).filter(F.col("__copies") > 0)
    return again.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])
