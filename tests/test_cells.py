"""The vector index: recall against exact search, rows that are in no cell, layout and pushed filters."""

import io
from contextlib import redirect_stdout

import numpy as np

from lodestrata.operators import cells
from lodestrata.plans.ingest import Corpus, build_index, write
from lodestrata.plans.retrieval import Engine

SCHEMA = "collection string, chunk_id string, text string, embedding array<float>, norm double, metadata string, source string, version string, ingest_time double"


def rows(spark, vectors, at=1.0, prefix="c"):
    made = [("guides" if i % 2 else "items", f"{prefix}{i}", f"text {i}", None if v is None else [float(x) for x in v], None if v is None else float(np.linalg.norm(v)), "{}", "s", "b41", at) for i, v in enumerate(vectors)]
    return spark.createDataFrame(made, SCHEMA)


def test_cells_find_what_exact_search_finds(spark, tmp_path):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 16))
    vectors = [centres[i % 20] + 0.3 * rng.normal(size=16) for i in range(600)]
    questions = {f"q{i}": [float(x) for x in centres[i] + 0.3 * rng.normal(size=16)] for i in range(20)}
    corpus = Corpus(spark, str(tmp_path / "c"), embed=lambda texts: [questions[t] for t in texts])
    write(corpus, rows(spark, vectors))
    engine, asked = Engine(corpus), list(questions)
    best = lambda probes: {(r.position, r.collection, r.chunk_id) for r in engine.search_many(asked, 10, probes=probes).collect()}
    exact = best(None)
    assert best(3) == exact  # without an index, all rows are read
    assert build_index(corpus, 20) == {"cells": 20}
    assert best(None) == exact and best(20) == exact
    assert len(best(4) & exact) / len(exact) >= 0.9
    assert engine.hits(["q0"], probes=4).count() < 0.6 * len(vectors)
    plan = io.StringIO()
    with redirect_stdout(plan):
        engine.hits(["q0"], probes=2).explain("formatted")
    assert "cell" in next(line for line in plan.getvalue().splitlines() if line.startswith("PushedFilters") and "cell" in line)


def test_rows_outside_of_cells_are_always_read(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"), embed=lambda texts: [[1.0, 0.0, 0.0] for _ in texts])
    odd = [[float("nan"), 1.0, 1.0], [0.0, 0.0, 0.0], [1.0, 0.0], None]
    write(corpus, rows(spark, [[1.0, 0.1 * i, 0.0] for i in range(10)] + [[-1.0, 0.0, 0.1 * i] for i in range(10)] + [[0.0, 1.0, 0.0]] * 5 + odd))
    assert build_index(corpus, 3)["cells"] == 3
    got = {r.chunk_id: r.cell for r in corpus.chunks.current().collect()}
    assert len(got) == 29 and [got[f"c{i}"] for i in range(25, 29)] == [None] * 4 and all(got[f"c{i}"] is not None for i in range(25))
    assert len({got[f"c{i}"] for i in range(20, 25)}) == 1  # equal vectors share a cell
    write(corpus, rows(spark, [[-1.0, 0.0, 0.0], [1.0, 0.05, 0.0], [0.0, 0.0, 0.0], [1.0, 2.0]], 2.0, "new"))  # placed as it is written
    engine = Engine(corpus)
    now = {r.chunk_id: r.cell for r in corpus.chunks.current().collect()}
    assert now["new0"] == got["c10"] and now["new1"] == got["c0"] and now["new2"] is None and now["new3"] is None
    seen = {r.chunk_id for r in engine.hits(["x"], probes=1).collect()}
    assert "new0" not in seen and {"new1", "c0"} <= seen and "c15" not in seen  # far from the question; near; what has no cell has no score
    first = corpus.centroids()[0][0]
    build_index(corpus, 2)
    assert corpus.centroids()[0][0] >= first + cells.MOST
    corpus.chunks.rollback()  # rows of the fit before are in no cell of this one
    assert {r.chunk_id for r in engine.hits(["x"], probes=1).collect()} == {r.chunk_id for r in engine.hits(["x"]).collect()}
    assert engine.search("x", 1, probes=1).first().chunk_id == "c0"


def test_written_rows_get_the_cells_of_a_fit(spark):
    """Placing by stored centroids equals the fit's own assignment, in blocks of any size."""
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    model = cells.fit(vectors, cells=12)
    want = {r.vec_id: r.cell for r in cells.assign(vectors, model, 5000).collect()}
    centroids = [(5000 + i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    assert {r.vec_id: r.cell for r in cells.place(vectors, centroids).collect()} == want


def test_nothing_to_index(spark, tmp_path):
    corpus = Corpus(spark, str(tmp_path / "c"))
    assert build_index(corpus) == {"cells": 0}
    write(corpus, rows(spark, [[1.0, 2.0]]))
    assert build_index(corpus) == {"cells": 0} and corpus.centroids() == []


def test_recall_on_the_embeddings_table(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    model = cells.fit(vectors)
    placed = cells.assign(vectors, model, 0).persist()
    assert placed.count() == vectors.count() and placed.filter("cell is null").isEmpty()
    data = {r.vec_id: (np.array(r.embedding, float), r.cell) for r in placed.collect()}
    placed.unpersist()
    centroids = [(i, list(c)) for i, c in enumerate(model.clusterCenters())]
    cos = lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)
    found = total = 0
    for q in [i for i in data if i % 50 == 0]:
        probed = set(cells.nearest(list(data[q][0]), centroids, len(centroids) // 2))
        ranked = sorted((i for i in data if i != q), key=lambda i: -cos(data[i][0], data[q][0]))[:5]
        found, total = found + sum(data[i][1] in probed for i in ranked), total + 5
    assert found / total >= 0.9
