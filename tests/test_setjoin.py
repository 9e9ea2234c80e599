"""The set-similarity join against all pairs, and how many candidates its bounds leave; panes against sliding windows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import setjoin
from lodestrata.streaming import windows as S


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_pairs_equal_all_pairs(spark, least):
    rng = random.Random(4)
    sets = {f"k{i}": [rng.choice("aabcdefghij") + rng.choice("xyz") for _ in range(rng.randrange(1, 14))] for i in range(80)}
    rows = spark.createDataFrame([*sets.items(), ("none", []), ("null", None)], "name string, g array<string>")
    got = {(r.a, r.b): r.similarity for r in setjoin.similar_pairs(rows, "name", "g", least).collect()}
    want = {}
    for a, x in sets.items():
        for b, y in sets.items():
            j = len(set(x) & set(y)) / len(set(x) | set(y))
            if a < b and j >= least - 1e-12:
                want[a, b] = round(j, 6)
    assert got == want


def test_frequent_elements_make_no_candidates(spark):
    """Sets that share only what all share never meet."""
    rows = spark.createDataFrame([(i, ["all", "of", "us", *[f"{i // 2}-{k}" for k in range(6)]]) for i in range(200)], "name long, g array<string>")
    pairs = setjoin.candidates(setjoin.ordered(rows, "name", "g"), "name", 0.5)
    assert pairs.count() == 100  # of 19,900 that share an element
    assert setjoin.similar_pairs(rows, "name", "g", 0.5).count() == 100


def test_panes_equal_sliding_windows(spark):
    rng = random.Random(5)
    events = spark.createDataFrame([(rng.randrange(86400 * 20), rng.choice("ab"), float(rng.randrange(100))) for _ in range(300)], "s long, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    for width, slide, n in (("7 days", "1 day", 7), ("1 day", "12 hours", 2), ("36 hours", "1 day", None)):
        assert S.whole_slides(width, slide) == n
        got = {(r.win_start, r.event_type): (r.n, r.total) for r in S.tumbling(events, width, ["event_type"], slide=slide).collect()}
        plain = events.groupBy(F.window("ts", width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        assert got == {(str(r.w.start), r.event_type): (r.n, r.total) for r in plain.collect()}
    text = S.tumbling(events, "7 days", ["event_type"], slide="1 day")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate") == 2 and "Generate explode" in text and "Expand" not in text
