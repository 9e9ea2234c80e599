"""The table of versions: equal to a plain dictionary, writes that touch little, shared files, compaction, two tables."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.operators import versions
from lodestrata.operators.versions import Snapshots
from lodestrata.plans import ingest as ingestion
from lodestrata.plans.ingest import Corpus, ingest
from lodestrata.sources import extract, files

SCHEMA = "c string, k string, v int, t double"


def rows(df):
    return {(r.c, r.k): (r.v, r.t) for r in df.collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


@pytest.mark.parametrize("seed", range(2))
def test_writes_equal_a_dictionary(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(versions, "SMALL_FILES", 4)
    monkeypatch.setattr(versions, "FILE_ROWS", 40)
    rng = random.Random(seed)
    table = Snapshots(spark, f"file://{tmp_path}/t", ["c", "k"], "t")
    want, past = {}, []
    for step in range(9):
        some = [(rng.choice(["a", "b", None]), rng.choice([None, *[f"k{i}" for i in range(60)]]), rng.randrange(100), rng.choice([None, float(rng.randrange(5)), float(step)])) for _ in range(rng.randrange(1, 50))]
        batch = spark.createDataFrame(some, SCHEMA)
        kind = rng.choice(["upsert", "upsert", "insert", "delete", "where", "gone"]) if want else "upsert"
        newest = {}
        for c, k, v, t in some:  # of equal times any may stay, so times of a batch are made unlike
            newest[c, k] = (v, t)
        batch = spark.createDataFrame([(*k, *v) for k, v in newest.items()], SCHEMA)
        late = lambda t: (t is not None, t or 0.0)
        if kind in ("upsert", "gone"):
            if kind == "gone":
                want = {k: v for k, v in want.items() if v[0] % 3 != 1}
            gone = spark.createDataFrame([(v,) for v in range(100) if v % 3 == 1], "v int") if kind == "gone" else None
            table.upsert(batch, 3, gone)
            for k, v in newest.items():
                if k not in want or late(v[1]) >= late(want[k][1]):
                    want[k] = v
        elif kind == "insert":
            table.insert(batch, 3)
            want = newest | want
        elif kind == "delete":
            table.delete(batch.filter("c IS NOT NULL AND k IS NOT NULL").select("c", "k"), 3)
            want = {k: v for k, v in want.items() if k not in newest or None in k}
        else:
            table.delete_where(F.col("v") > 70, ["v"], 3)
            want = {k: v for k, v in want.items() if v[0] <= 70}
        assert rows(table.current()) == want, (step, kind)
        past.append(dict(want))
    if len(past) > 1:
        table.rollback()
        assert rows(table.current()) == past[-2]
    table.compact(3)
    assert rows(table.current()) == past[-2] and all(f.gone <= versions.MOST_GONE * f.rows for f in table._now()[1].files)


def test_a_small_write_is_small(spark, tmp_path):
    root = tmp_path / "t"
    table = Snapshots(spark, f"file://{root}", ["c", "k"], "t")
    base = spark.range(20_000).select(F.lit("a").alias("c"), F.lpad(F.col("id").cast("string"), 8, "0").alias("k"), F.col("id").cast("int").alias("v"), F.lit(1.0).alias("t"), F.sha2(F.col("id").cast("string"), 512).alias("text"))
    table.publish(base.repartition(4), 5)
    before = size(root)
    batch = base.filter("id % 100 = 7").withColumn("t", F.lit(2.0)).withColumn("v", F.lit(-1))
    table.upsert(batch.select(*base.columns), 5)
    assert size(root) - before < 0.05 * before
    assert table.current().count() == 20_000 and table.current().filter("v = -1").count() == 200
    # promotion and rollback write no data
    other = Snapshots(spark, f"file://{tmp_path}/p", ["c", "k"], "t")
    at = size(root)
    other.adopt(table, 2)
    other.adopt(table, 2)
    other.rollback()
    assert size(root) - at < 1000 and not (tmp_path / "p" / "data").exists() and other.current().filter("v = -1").count() == 200


def test_keys_outside_of_a_files_range_leave_it_alone(spark, tmp_path, monkeypatch):
    table = Snapshots(spark, f"file://{tmp_path}/t", ["k"], "t")
    for low in (0, 1000, 2000):
        table.upsert(spark.range(low, low + 500).select(F.col("id").alias("k"), F.lit(float(low)).alias("t")), 9)
    _, manifest = table._now()
    staged = lambda ids: table._staged(spark.createDataFrame([(i,) for i in ids], "k long"))
    met = lambda ids: {f.low[0] // 1000 for f in table._met(manifest, staged(ids))}
    assert met([1100]) == {1} and met([700, 2499]) <= {0, 1, 2} and 2 in met([700, 2499]) and met([9000]) == set() and met([-1]) == set()
    seen = []
    scan = Snapshots._scan
    monkeypatch.setattr(Snapshots, "_scan", lambda self, m, some, columns, named=False: seen.append((len(some), columns)) or scan(self, m, some, columns, named))
    table.upsert(spark.createDataFrame([(1003, 5000.0)], "k long, t double"), 9)
    assert seen == [(len([f for f in manifest.files if f.low[0] // 1000 == 1]), ["k", "t"])]  # keys and times of one range
    assert table.current().count() == 1500


def test_old_versions_go_but_not_what_others_hold(spark, tmp_path):
    def batch(n):
        return spark.range(50).select(F.col("id").alias("k"), F.lit(n).alias("v"))

    one, two = Snapshots(spark, f"file://{tmp_path}/one", ["k"]), Snapshots(spark, f"file://{tmp_path}/two", ["k"])
    one.publish(batch(1), 1)
    two.adopt(one, 1)
    for n in range(2, 6):
        one.publish(batch(n), 1)
    assert len(list(tmp_path.glob("one/data/w*"))) == 3 and two.current().first().v == 1 and one.current().first().v == 5
    two.upsert(spark.createDataFrame([(3, 9)], "k long, v int"), 1)
    assert two.current().filter("k = 3").first().v == 9 and two.current().count() == 50
    two.publish(batch(7), 1)
    two.publish(batch(8), 1)  # nothing of the other table is held any more
    one.publish(batch(6), 1)
    one.publish(batch(7), 1)
    assert len(list(tmp_path.glob("one/data/w*"))) == 2 and len(list(tmp_path.glob("one/versions/v*.json"))) == 2


def test_many_small_writes_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(versions, "SMALL_FILES", 5)
    table = Snapshots(spark, f"file://{tmp_path}/t", ["k"])
    for n in range(9):
        table.upsert(spark.range(n, n + 3).select(F.col("id").alias("k"), F.lit(n).alias("v")).coalesce(1), 2)
        assert len(table.sizes()) <= 7
    assert {r.k: r.v for r in table.current().collect()} == {k: min(k, 8) for k in range(11)}


def test_no_version_and_no_rows(spark, tmp_path):
    table = Snapshots(spark, f"file://{tmp_path}/t", ["k"])
    assert table.current() is None and table.compact(1) is None and table.note() == {}
    with pytest.raises(ValueError):
        table.delete(spark.createDataFrame([("a",)], "k string"), 1)
    empty = spark.createDataFrame([], "k string, v int")
    table.upsert(empty, 1)
    assert table.current().count() == 0 and table.current().columns == ["k", "v"]
    table.upsert(spark.createDataFrame([("a", 1)], "k string, v int"), 1)
    table.delete(spark.createDataFrame([("a",)], "k string"), 1)
    assert table.current().count() == 0 and not table.sizes()


# --- change detection ---


def test_unchanged_files_are_not_opened(spark, tmp_path, monkeypatch):
    src = tmp_path / "src"
    src.mkdir()
    for n in range(6):
        (src / f"a[{n}].txt").write_text(f"text number {n} of the corpus")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    assert ingest(corpus, f"file://{src}", at=1.0) == {"files": 6, "failed": 0, "chunks": 6}
    opened, parsed = [], []
    named, records = files.named, extract.records
    monkeypatch.setattr(files, "named", lambda s, paths: opened.extend(paths) or named(s, paths))
    monkeypatch.setattr(extract, "records", lambda df, *more: parsed.extend(r.path for r in df.select("path").collect()) or records(df, *more))
    assert ingest(corpus, f"file://{src}", at=2.0) == {"files": 0, "failed": 0, "chunks": 0}
    assert opened == [] and parsed == []
    os.utime(src / "a[0].txt", (1, 1))  # touched: hashed, not parsed
    (src / "a[1].txt").write_text("short")
    os.utime(src / "a[2].txt", (2, 2))
    assert ingest(corpus, f"file://{src}", at=3.0)["chunks"] == 1
    names = lambda paths: sorted(p.rsplit("/", 1)[1] for p in paths)
    assert names(set(opened)) == ["a[0].txt", "a[1].txt", "a[2].txt"] and names(parsed) == ["a[1].txt"]
    opened.clear()
    assert ingest(corpus, f"file://{src}", at=4.0)["files"] == 0 and opened == []
    got = {r.source.rsplit("/", 1)[1]: r.text for r in corpus.chunks.current().collect()}
    assert len(got) == 6 and got["a[1].txt"] == "short"


def test_changed_files_come_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingestion, "LISTED", 2)
    src = tmp_path / "src"
    src.mkdir()
    (src / "0.txt").write_text("first")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    ingest(corpus, f"file://{src}", at=1.0)
    for n in range(1, 6):
        (src / f"{n}.txt").write_text(f"more {n}")
    assert ingest(corpus, f"file://{src}", at=2.0) == {"files": 5, "failed": 0, "chunks": 5}
    assert corpus.chunks.current().count() == 6


def test_no_content_is_shuffled(spark, tmp_path):
    (tmp_path / "a.txt").write_text("a")
    found = files.scan(spark, f"file://{tmp_path}").select("path", "length", "modified")
    text = found.join(found.select("path"), "path", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "content:binary" not in text and "ReadSchema" in text


def test_a_stream_of_changed_files_opens_only_these(spark, tmp_path, monkeypatch):
    from lodestrata.streaming.ingest import file_versions

    src = tmp_path / "src"
    (src / "sub").mkdir(parents=True)
    for i in range(5):
        (src / "sub" / f"{i}.txt").write_text(f"text {i}")
        os.utime(src / "sub" / f"{i}.txt", (1000 + i, 1000 + i))
    (src / "_hidden.txt").write_text("x")
    (src / "other.md").write_text("x")
    opened = []
    named = files.named
    monkeypatch.setattr(files, "named", lambda s, paths: opened.extend(p.rsplit("/", 1)[1] for p in paths) or named(s, paths))
    call = lambda: {r.path.rsplit("/", 1)[1]: (r.length, r.file_hash) for r in file_versions(spark, f"file://{src}", f"file://{tmp_path}/t", "*.txt").current().collect()}
    first = call()
    assert sorted(opened) == [f"{i}.txt" for i in range(5)] == sorted(first)
    opened.clear()
    assert call() == first and opened == []  # nothing has changed: no file is opened
    (src / "sub" / "1.txt").write_text("t")  # shrunken
    (src / "sub" / "2.txt").write_text("text x")  # of the same length
    (src / "new.txt").write_text("new")
    second = call()
    assert sorted(opened) == ["1.txt", "2.txt", "new.txt"]
    assert {n for n in second if second[n] != first.get(n)} == {"1.txt", "2.txt", "new.txt"} and second["1.txt"][0] == 1


def test_a_batch_of_changed_files_is_taken_in_at_once(spark, tmp_path, monkeypatch):
    """Files are looked up in blocks, by few tasks; the table is written once a batch however many blocks there are."""
    from lodestrata.streaming.ingest import file_versions

    src = tmp_path / "src"
    src.mkdir()
    for i in range(40):
        (src / f"{i}.txt").write_text(f"text {i}")
    tasks, written, was = [], [], spark.conf.get(files.DISCOVERY)
    load, upsert = files.literal_paths, Snapshots.upsert
    monkeypatch.setattr(ingestion, "LISTED", 15)
    monkeypatch.setattr(files, "literal_paths", lambda paths: tasks.append(int(spark.conf.get(files.DISCOVERY))) or load(paths))
    monkeypatch.setattr(Snapshots, "upsert", lambda *a, **k: written.append(1) or upsert(*a, **k))
    got = {r.path.rsplit("/", 1)[1]: r.length for r in file_versions(spark, f"file://{src}", f"file://{tmp_path}/t").current().collect()}
    assert got == {f"{i}.txt": len(f"text {i}") for i in range(40)}
    assert len(tasks) == 3 and max(tasks) <= 4 * spark.sparkContext.defaultParallelism and len(written) == 1
    assert spark.conf.get(files.DISCOVERY) == was
