"""Whitening and code compression of vectors against plain arithmetic, with odd rows."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.llm import codes, queries, whitening

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def plain_whitening(vecs, k, scale=64, shift=1_000_000):
    """Exact covariance in fractions, then eigenvectors."""
    x = [[math.floor(scale * float(c)) + shift for c in v] for v in vecs]
    n, d = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(d)]
    dev = [[n * r[i] - sums[i] for i in range(d)] for r in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in dev), n**3)) for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return n, [sum(v * v for v in r) for r in dev], np.array(dev, dtype=float) / n @ (vectors / np.sqrt(values)), values / np.trace(cov)


def test_whitening_query_equals_exact_arithmetic(spark):
    got = queries.op11_whitening(spark, SF).toPandas()
    rows = [r for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect() if r.embedding is not None]
    n, deviation, white, explained = plain_whitening([r.embedding for r in rows], 32)
    k = min(32, n - 1, len(rows[0].embedding))
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.max() < 1e-4
    place = {r.vec_id: i for i, r in enumerate(rows)}
    at = got.vec_id.map(place)
    assert (got.deviation == at.map(dict(enumerate(deviation)))).all()
    assert np.allclose(got.explained, explained[got.component - 1], rtol=1e-9)
    for c in range(1, k + 1):
        part = got[got.component == c]
        want = white[part.vec_id.map(place), c - 1]
        sign = np.sign(want @ part.whitened.to_numpy())
        assert np.allclose(part.whitened, sign * want, atol=1e-6)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [(i if i else None, [float(v) for v in rng.normal(size=3)], "a") for i in range(40)] + [(7, [0.5, -0.25, 1.0], "a")] * 3
    odd = [(50, None, "a"), (51, [], "a"), (52, [1.0, None, 2.0], "a"), (53, [1.0, NAN, 2.0], "a"), (54, [1.0, INF, 2.0], "a"), (55, [1.0, 2.0], "a")]
    df = spark.createDataFrame(good + odd, "vec_id long, embedding array<double>, vector string").repartition(3)
    model = whitening.fit(df)
    out = whitening.apply(df, model).toPandas()
    n, deviation, white, explained = plain_whitening([v for _, v, _ in good], 3)
    assert model.n == n == len(out) and sorted(out.deviation) == sorted(deviation) and np.allclose(model.explained, explained)
    assert whitening.identity_error(whitening.apply(df, model), 3) < 1e-9
    assert out.vec_id.isna().sum() == 1 and (out.vec_id == 7).sum() == 4
    assert np.allclose(np.sort(np.abs(np.stack(out.whitened)).ravel()), np.sort(np.abs(white).ravel()), atol=1e-8)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [2.0, 3.0])] * 5, [(1, [])]])
def test_whitening_without_variance_has_no_components(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    model = whitening.fit(df)
    out = whitening.apply(df, model).collect()
    assert len(model.values) == 0 and len(out) == sum(v is not None for _, v in rows) and all(r.whitened == [] and r.deviation == 0 for r in out)
    assert whitening.identity_error(whitening.apply(df, model), 0) == 0


def test_whitening_of_huge_entries_is_exact(spark):
    rows = [(i, [float(10**18 + i * 10**6), float(i % 3), -float(i)]) for i in range(30)]
    model = whitening.fit(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert model.sums == [sum(math.floor(64 * v[i]) + 1_000_000 for _, v in rows) for i in range(3)]
    out = whitening.apply(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), model).collect()
    dev = [sum((30 * (math.floor(64 * v[i]) + 1_000_000) - model.sums[i]) ** 2 for i in range(3)) for _, v in rows]
    assert [r.deviation for r in out] == [x if x < 1 << 63 else None for x in dev]


def test_directions_that_repeat_others_have_no_component(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [a, a, b]) for i, (a, b) in enumerate(rng.normal(size=(50, 2)).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    assert len(model.values) == 2 and whitening.identity_error(whitening.apply(df, model), 2) < 1e-9


# --- codes ---


def plain_codes(rows, entries, parts, rounds, scale=1024):
    """(id, label, vector) rows by Lloyd's rounds without bounds."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    x = [[math.floor(scale * float(c)) for c in v] for _, _, v in rows]
    cut = codes.bounds(len(x[0]), parts)
    told, books = [[] for _ in rows], []
    for p in range(parts):
        part = [v[cut[p] : cut[p + 1]] for v in x]
        book = [list(v) for v in part[:entries]]
        for n in range(rounds + 1):
            near = [min((sum((a - b) ** 2 for a, b in zip(v, e)), j) for j, e in enumerate(book)) for v in part]
            if n == rounds:
                break
            for j in range(len(book)):
                mine = [v for v, (_, k) in zip(part, near) if k == j]
                if mine:
                    book[j] = [sum(c) // len(mine) for c in zip(*mine)]
        books.append(book)
        for t, (d, j) in zip(told, near):
            t.append((j, d))
    return [(i, label, [j for j, _ in t], sum(d for _, d in t)) for (i, label, _), t in zip(rows, told)], books


def compared(spark, data, entries, parts, rounds, kind="double"):
    df = spark.createDataFrame(data, f"vec_id long, label int, embedding array<{kind}>").withColumn("k0", F.lit(1)).withColumn("vector", F.lit(2)).repartition(3)
    got, books = codes.compress(df, ["vec_id", "label"], entries, parts, rounds)
    usable = [r for r in data if r[2] is not None and all(c is not None and math.isfinite(c) for c in r[2])]
    want, plain = plain_codes(usable, entries, parts, rounds)
    assert [e.tolist() for e in books.entries] == plain
    key = lambda r: str(r)
    assert sorted([(r.vec_id, r.label, list(r.entries), r.error) for r in got.collect()], key=key) == sorted([(*w[:3], min(w[3], codes.LONG)) for w in want], key=key)


@pytest.mark.parametrize("seed", range(4))
def test_codes_equal_plain_rounds(spark, monkeypatch, seed):
    monkeypatch.setattr(codes, "BLOCK_ROWS", 37)
    rng = np.random.default_rng(seed)
    step = [1, 0.25, 0.001, 0.02][seed]  # coarse steps make ties
    size = [8, 6, 7, 3][seed]
    data = [(int(i), int(rng.integers(3)) if i % 5 else None, [float(v) for v in np.round(rng.normal(size=size) / step) * step]) for i in rng.permutation(260)]
    compared(spark, data, [16, 5, 33, 200][seed], 4 if seed else 2, 4)


def test_codes_of_odd_rows(spark):
    good = [(None, None, [0.5, 1.0, -2.0, 0.0])] * 2 + [(i // 2, i % 2, [i * 0.25, -1.0 * i, 0.0, float(i % 3)]) for i in range(20)]
    odd = [(90, 1, None), (91, 1, []), (92, 1, [None, 1.0, 1.0, 1.0]), (93, 1, [NAN, 1.0, 1.0, 1.0]), (94, 1, [INF, 1.0, 1.0, 1.0]), (95, 1, [1.0, 2.0])]
    df = spark.createDataFrame(good + odd, "vec_id long, label int, embedding array<double>")
    got, _ = codes.compress(df, ["vec_id", "label"], 4, 4, 3)
    want, _ = plain_codes(good, 4, 4, 3)
    assert sorted(map(str, [(r.vec_id, r.label, list(r.entries), r.error) for r in got.collect()])) == sorted(map(str, want))
    rows = codes.with_label_error(got).collect()
    by = {label: sum(r.error for r in rows if r.label == label) for label in (None, 0, 1)}
    assert len(rows) == len(good) and all(r.label_error == by[r.label] for r in rows)


def test_codes_of_one_row_and_of_huge_components(spark):
    compared(spark, [(5, 1, [0.1, -0.1, 0.2, 0.3])], 256, 4, 4)
    compared(spark, [(i, 0, [1e10 * i, -3e10, float(i * i), 0.5]) for i in range(30)], 4, 2, 4)


@pytest.mark.parametrize("rows", [[], [(1, 2, None)]])
def test_codes_of_nothing(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got, books = codes.compress(df, ["vec_id", "label"])
    assert codes.with_label_error(got).select(codes.hex_code()).collect() == [] and len(books.digest()) == 64


def test_few_parts_are_scanned_again():
    """Where entries hardly move, heaps stay closed."""
    rng = np.random.default_rng(4)
    centres = rng.integers(-500, 500, size=(16, 8)) * 100
    x = centres[rng.integers(16, size=2000)] + rng.integers(-50, 50, size=(2000, 8))
    books = codes.Codebooks([centres + rng.integers(-20, 20, size=centres.shape)])
    heaps, nearest = codes.Heaps.new(x, books.entries[0], books.drift[0])
    scanned = []
    plain = codes.Heaps._scan
    for _ in range(3):
        moves = {}
        codes._moves(x, np.arange(len(x)), heaps.assigned(), 1, moves)
        books = codes.Codebooks(books.entries, books.drift).move([(0, j, n, s.tolist()) for j, (n, s) in moves.items()])
        with pytest.MonkeyPatch.context() as m:
            m.setattr(codes.Heaps, "_scan", staticmethod(lambda v, b: scanned.append(len(v)) or plain(v, b)))
            heaps.rescan(x, books.entries[0], books.drift[0])
        assert (heaps.assigned() == codes.distances(x, books.entries[0]).argmin(axis=1)).all()
    assert sum(scanned) < 200
