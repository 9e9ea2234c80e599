"""The quality gate: expected against retrieved ids, recall per question, campaigns, comparison, verdict.

Golden items are a query set that is put to all documents in blocks of a bounded number of words, which is what is sent to
all tasks. One pass over the documents does both: an inverted index of a block's words gives the words that a document shares
with each item, and an automaton over the items' texts finds those that it holds. A task keeps each item's k best and the
count that a document must reach to be among them; it grows as documents come, so soon most documents are left out for all but
a few items, or at once where they have fewer indexed words than any item still asks for. Only the best few are shuffled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_list
from ..session import shared_dir, stored
from .windows import latest, running_sum

#: Words of the items of a block; an item with more is a block of its own. Candidates that a task gathers before it sorts them.
BLOCK_WORDS = 200_000
TILE = 2_000_000


def item_blocks(items: DataFrame) -> list[DataFrame]:
    """The items (item_id, text) in blocks of at most ``BLOCK_WORDS`` words and one item; stored."""
    words = items.select("item_id", "text", F.size(word_list(F.col("text"))).cast("long").alias("__n"))
    numbered = running_sum(words, [], [F.col("item_id")], F.col("__n"), "__sum").withColumn("__block", F.expr(f"(__sum - __n) div {BLOCK_WORDS}"))
    told = stored(numbered.select("item_id", "text", "__block"))
    return [told.filter(F.col("__block") == b[0]).drop("__block") for b in told.select("__block").distinct().orderBy("__block").collect()]


class _Best:
    """Each item's k best documents of a task, by count, then id, and the count that the next one must reach."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.least = np.ones(n, dtype=np.int64)
        self.floor = 1
        none = np.zeros(0, dtype=np.int64)
        self.kept = (none, none, none)
        self.fresh: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0
        self.most = min(TILE, max(1000, 8 * k * n))

    def add(self, doc: int, found: list[np.ndarray]) -> None:
        """A document by the items of each of its words that are in the index."""
        if len(found) < self.floor:
            return
        hits = np.concatenate(found)
        if 4 * len(hits) < self.n:
            items, counts = np.unique(hits, return_counts=True)
            fits = counts >= self.least[items]
            items, counts = items[fits], counts[fits]
        else:
            counts = np.bincount(hits, minlength=self.n)
            items = np.nonzero(counts >= self.least)[0]
            counts = counts[items]
        if len(items):
            self.fresh.append((items, counts, np.full(len(items), doc, dtype=np.int64)))
            self.waiting += len(items)
            if self.waiting >= self.most:
                self.settle()

    def settle(self) -> None:
        items, counts, docs = (np.concatenate(x) for x in zip(self.kept, *self.fresh, strict=True))
        order = np.lexsort((docs, -counts, items))
        items, counts, docs = items[order], counts[order], docs[order]
        place = np.arange(len(items)) - np.searchsorted(items, items, side="left")
        stay = place < self.k
        last = place == self.k - 1
        self.least[items[last]] = counts[last]
        self.floor = int(self.least.min(initial=1 << 40))
        self.kept = items[stay], counts[stay], docs[stay]
        self.fresh, self.waiting = [], 0


MATCH = "item_id long, doc_id long, overlap long, held boolean"


def _matches(ids: np.ndarray, texts: list[str], places: dict[bytes, np.ndarray], k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import ahocorasick

    whole: dict[str, list[int]] = {}
    for i, text in enumerate(texts):
        whole.setdefault(text, []).append(i)
    automaton = ahocorasick.Automaton()
    for text, items in whole.items():
        if text:
            automaton.add_word(text, items)
    automaton.make_automaton()
    best = _Best(len(ids), k)

    def batch_of(items: np.ndarray, docs: list | np.ndarray, overlap: np.ndarray | None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids[items]), pa.array(docs, pa.int64()), pa.nulls(len(items), pa.int64()) if overlap is None else pa.array(overlap), pa.array(np.full(len(items), overlap is None))], ["item_id", "doc_id", "overlap", "held"])

    for batch in batches:
        held: list[tuple[int, int | None]] = []
        for doc_id, low, text in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            if doc_id is not None:
                best.add(doc_id, [p for w in set((low.as_py() or b"").split()) if (p := places.get(w)) is not None])
            if len(automaton) and text.is_valid:
                held += [(i, doc_id) for i in {i for _, items in automaton.iter(text.as_py().decode("utf-8", "replace")) for i in items}]
        if held:
            yield batch_of(np.array([i for i, _ in held]), [d for _, d in held], None)
    best.settle()
    items, counts, docs = best.kept
    yield batch_of(items, docs, counts)


def matches(items: DataFrame, docs: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """From one pass over the documents for each block of items (item_id, text): pairs (item_id, doc_id) whose document contains
    the item's text, and the k documents that share most distinct words, in lower case, with each item (item_id, doc_id, overlap
    and rank). An empty item is in no document. A document that shares no word isn't ranked, nor is one without an id; ties go
    to the smaller id. Stored."""
    at, n, out = shared_dir(docs.sparkSession), 0, None
    texts = docs.select(F.col("doc_id").cast("long"), F.lower("text").cast("binary").alias("low"), F.col("text").cast("binary"))
    for block in item_blocks(items):
        rows = sorted(((r.item_id, r.text or "", r.low or "") for r in block.withColumn("low", F.lower("text")).collect()))
        places: dict[bytes, list[int]] = {}
        for i, (_, _, low) in enumerate(rows):
            for w in set(low.encode().split()):
                places.setdefault(w, []).append(i)
        told = {w: np.array(p) for w, p in places.items()}
        found = texts.mapInArrow(functools.partial(_matches, np.array([r[0] for r in rows], dtype=np.int64), [r[1] for r in rows], told, k), MATCH)
        part = stored(found, f"{at}/{n}")
        out, n = part if out is None else out.unionByName(part), n + 1
    if out is None:
        out = docs.sparkSession.createDataFrame([], MATCH)
    ranked = latest(out.filter("NOT held").drop("held"), ["item_id"], [F.col("overlap").desc(), F.col("doc_id")], k, "rank")
    return out.filter("held").select("item_id", "doc_id").distinct(), ranked


def passages(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (item_id, doc_id) whose document contains the item's text."""
    return matches(items, docs, 1)[0]


def overlap_ranked(items: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The k documents that share most distinct words with each item: item_id, doc_id, overlap and rank."""
    return matches(items, docs, k)[1]


def recall(questions: DataFrame, expected: DataFrame, retrieved: DataFrame, k: int, question: str, doc: str) -> DataFrame:
    """Per question: expected, hits within the first k, recall (0 if nothing is expected). Pairs meet by hash joins."""
    hits = expected.join(retrieved.filter(F.col("rank") <= k).select(question, doc), [question, doc], "left_semi")
    e = expected.groupBy(question).agg(F.count("*").alias("n_expected"))
    h = hits.groupBy(question).agg(F.count("*").alias("n_hits"))
    out = questions.select(question).join(e, question, "left").join(h, question, "left").na.fill(0, ["n_expected", "n_hits"])
    return out.withColumn("recall", F.when(F.col("n_expected") > 0, F.round(F.col("n_hits") / F.col("n_expected"), 6)).otherwise(0.0))


def missing(expected: DataFrame, retrieved: DataFrame, k: int, question: str, doc: str) -> DataFrame:
    return expected.join(retrieved.filter(F.col("rank") <= k).select(question, doc), [question, doc], "left_anti")


def campaign(recalls: DataFrame, threshold: float = 0.75) -> DataFrame:
    """One row: questions, average and least recall, passes, perfect ones, and whether the gate opens."""
    out = recalls.agg(
        F.count("*").alias("questions"), F.round(F.avg("recall"), 6).alias("avg_recall"), F.min("recall").alias("min_recall"),
        F.count_if(F.col("recall") >= threshold).alias("n_pass"), F.count_if(F.col("recall") < threshold).alias("n_fail"), F.count_if(F.col("recall") == 1).alias("n_perfect"),
    )
    return out.withColumn("passed", F.coalesce(F.col("avg_recall") >= threshold, F.lit(False)))


def compare(now: DataFrame, before: DataFrame, question: str, limit: float = 0.1) -> DataFrame:
    """Change of each question's recall against a baseline; a question the baseline lacks counts as 0 there."""
    old = before.select(question, F.col("recall").alias("old_recall"))
    out = now.select(question, "recall").join(old, question, "left").withColumn("old_recall", F.coalesce("old_recall", F.lit(0.0)))
    out = out.withColumn("delta", F.round(F.col("recall") - F.col("old_recall"), 6))
    return out.withColumn("status", F.when(F.col("delta") < -limit, "regression").when(F.col("delta") > limit, "improvement").otherwise("stable"))
