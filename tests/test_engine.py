"""Filters, functions, chunking properties, store, ingest, retrieval, gate, status, streams."""

import hashlib
import json
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata import cli, config
from lodestrata.functions import text as T
from lodestrata.functions import vector as V
from lodestrata.operators import chunking, filters, golden, graph, monitoring, quality, store, windows
from lodestrata.operators.versions import Snapshots
from lodestrata.plans import gate, status
from lodestrata.plans.ingest import Corpus, drop_collection, drop_rows, ingest
from lodestrata.plans.retrieval import Engine
from lodestrata.streaming import ingest as stream_ingest
from lodestrata.streaming import windows as S


def test_filters(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "3")], "k string, v string")
    n = lambda w: rows.filter(filters.compile_filter(w)).count()
    assert [n(None), n({}), n({"k": "a"}), n({"k": {"$ne": "a"}}), n({"$and": [{"k": "a"}, {}, {"v": 2}]}), n({"$or": [{"k": "a"}, {"v": "3"}]})] == [3, 3, 1, 1, 0, 2]
    with pytest.raises(ValueError):
        filters.compile_filter({"k": {"$gt": 1}})
    assert filters.version_and(" B41 ", None, {}) == {"game_version": {"$eq": "b41"}}
    assert filters.version_filter(" ") is None and filters.version_not(None) is None
    assert filters.golden_filter({"type": "item", "version": "b42"}, "b41") == {"game_version": "b42"}


def test_settings():
    s = config.load_settings("# x\nchunk_size = 100\nnope=1\nrecall_threshold='0.5'", {"LODESTRATA_CHUNK_SIZE": "200"})
    assert (s.chunk_size, s.recall_threshold) == (200, 0.5)
    assert config.current_version({}, " B42 \n") == "b42" and config.current_version({"DATA_VERSION": "X"}, "y") == "x" and config.current_version({}, None) == "b41"


def test_prose_takes_only_whole_texts_for_json(spark, tmp_path):
    """A text that begins with a number stays whole; a query's texts are cut as they are, as its SQL does."""
    from lodestrata.queries import prose_truncate

    said = ["8294846167456848 is a number", '{"a": 1} and more', "1] x", "1} x", '1, "v": 2', "1,", "", " ", "[1] [2]", "plain"]
    json_texts = {'{ "a": [1, 2] }': '{"a":[1,2]}', " 12 ": "12", "null": "null", "[ ]": "[]"}
    rows = [*said, *json_texts, None, "{" + "x" * 4000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    got = dict(docs.select("text", T.prose(F.col("text")).alias("cut")).collect())
    assert got == {t: json_texts.get(t, t and t[:3000]) for t in rows}
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: None if t is None else hashlib.sha256(t[:3000].encode()).hexdigest() for i, t in enumerate(rows)}
    assert {r.doc_id: r.cut_hash for r in prose_truncate(spark, str(tmp_path)).collect()} == want


def test_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    versions = ["1.0.0-alpha", "1.0.0-beta.2", "1.0.0-rc.1", "v1.0.0", "1.2.0"]
    df = spark.createDataFrame([(v,) for v in versions[::-1]], "v string")
    assert [r.v for r in df.orderBy(T.semver(F.col("v"))).collect()] == versions
    assert get(T.bump(F.lit("1.2.3"), "minor")) == "1.3.0"
    assert [get(T.duration(F.lit(x))) for x in (450, 12_300, 245_000, 7_380_000)] == ["450ms", "12.3s", "4m 05s", "2h 03m"]
    assert get(T.absolute(F.lit("http://h.org/a/b?x"), F.lit("c"))) == "http://h.org/a/c"
    assert get(T.absolute(F.lit("http://h.org/a/b/c"), F.lit("../../x/./y"))) == "http://h.org/x/y" and get(T.absolute(F.lit("http://h.org"), F.lit("/.."))) == "http://h.org"
    page = F.lit("<p>A<b>b</b></p><script>no</script><a href='x?q'>1</a><a href=\"mailto:a@b\">2</a><a href='/x'>3</a>")
    assert get(T.html_links(F.lit("http://h.org/"), page)) == ["http://h.org/x"] and get(T.html_text(page)) == "A b \n 1 2 3"
    assert get(V.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0 and get(V.cosine(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(1.0)))) is None
    assert get(V.literal(F.array(F.lit(0.5), F.lit(1e-9)))) == "[0.50000000,1.0000000e-09]"
    assert get(T.bar(F.lit(0.5), 4)) == "##.."


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text("ab c", min_size=1, max_size=40).filter(str.strip), min_size=1, max_size=12))
def test_packing_loses_nothing_and_keeps_the_limit(spark, parts):
    got = spark.createDataFrame([(parts,)], "p array<string>").select(chunking.pack(F.col("p"), 50, "\n")).first()[0]
    assert "\n".join(got) == "\n".join(parts)
    assert all(len(c) <= 50 or "\n" not in c for c in got)


def test_entity_split(spark):
    card = "Axe\n---\n" + "word " * 500 + "\n---\n" + "more " * 500
    split = lambda t, n: spark.createDataFrame([(t,)], "t string").select(chunking.entity_split(F.col("t"), n)).first()[0]
    assert split(card, 5000) == [card]
    assert [(p[:9], len(p.split())) for p in split(card, 800)] == [("Axe\n\nword", 501), ("Axe\n\nmore", 501)]
    # short sections are packed, a long one is cut by paragraphs and then by words, and nothing is lost
    long = "Item: Axe\nKey: axe\n---\nKey: b\n" + "".join(f"---\ns{i} " + "x " * 30 + "\n" for i in range(40)) + "## Long\n\n" + "\n\n".join(f"p{i} " + "y " * n for i, n in enumerate((10, 950, 30)))
    got = split(long, 800)
    assert all(len(p.split()) <= 800 and p.startswith("Item: Axe\nKey: axe\nKey: b\n\n") for p in got) and len(got) <= 5
    assert " ".join(" ".join(p.split()[6:]) for p in got).split() == [w for w in long.split() if w != "---"][6:]
    assert all(len(p.split()) <= 50 for p in split("w " * 300, 50)) and " ".join(split("w " * 300, 50)).split() == ["w"] * 300


@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="ab \n\té", max_size=120), st.integers(1, 40), st.integers(0, 2))
def test_offsets_are_exact(spark, text, limit, overlap):
    for whole, sep in ((chunking.paragraph_spans, "\n\n"), (chunking.line_spans, "\n")):
        parts, pieces = spark.createDataFrame([(text,)], "t string").select(whole(F.col("t")), chunking.pack_spans(whole(F.col("t")), limit, sep, overlap)).first()
        assert all(text[p.start :].startswith(p.piece) for p in parts)
        at, plain = 0, [p.piece for p in parts]
        for p in pieces:
            n = next(n for n in range(1, len(plain) - at + 1) if p.text.endswith(sep.join(plain[at : at + n])) and p.stop == parts[at + n - 1].start + len(plain[at + n - 1]))
            assert p.start == parts[at].start and (overlap or p.text == sep.join(plain[at : at + n]))
            at += n
        assert at == len(plain)


def test_store(spark, tmp_path):
    base = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 1.0)], "k string, v int, t double")
    batch = spark.createDataFrame([("b", 2, 2.0), ("c", 2, 2.0), ("a", 0, 0.5)], "k string, v int, t double")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    merged = store.upsert(base, batch, ["k"], "t")
    assert rows(merged) == [("a", 1), ("b", 2), ("c", 2)] == rows(store.upsert(merged, batch, ["k"], "t"))
    assert rows(store.insert_ignore(base, batch, ["k"])) == [("a", 1), ("b", 1), ("c", 2)]
    assert rows(store.delete(base, batch.filter("k = 'b'"), ["k"])) == [("a", 1)]
    snaps = Snapshots(spark, f"file://{tmp_path}/s")
    assert snaps.current() is None
    names = [snaps.publish(base.withColumn("n", F.lit(i)), 2) for i in range(4)]
    assert snaps.list() == names[1:] and snaps.current().first().n == 3
    assert snaps.rollback() == names[2] and snaps.current().first().n == 2
    with pytest.raises(ValueError):
        snaps.restore(names[0])


def test_windows_and_graph(spark):
    assert spark.range(1).select(windows.backoff(F.lit(3))).first()[0] == 20
    states = spark.createDataFrame([("validating", True, 0), ("validating", False, 1), ("validating", False, 5), ("packaging", True, 0)], "s string, p boolean, r int")
    assert [r[0] for r in states.select(windows.next_status(F.col("s"), F.col("p"), F.col("r"), F.lit(5))).collect()] == ["packaging", "fixing", "escalated", "done"]
    links = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "d", 0), ("a", "x", 1)], "src string, dst string, pos int")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.crawl(seeds, links, 2, 1).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert [r.node for r in graph.budget(graph.crawl(seeds, links, 3), 3).collect()] == ["a", "b", "x"]
    typed = spark.createDataFrame([("r", "plank", "i", "log", "uses", 0.5), ("r", "x", "i", "plank", "makes", None)], "source_category string, source_name string, target_category string, target_name string, link_type string, confidence double")
    assert graph.touching(typed, name="plank").count() == 2 and graph.touching(typed, "r", "plank", "makes").count() == 1


def test_quality(spark):
    df = spark.createDataFrame([('{"id": "Base.Axe", "name": "Axe"}',), ('{"id": "axe", "name": " "}',)], "metadata string")
    good, bad = quality.split_valid(df, quality.item_rules())
    assert good.count() == 1 and len(bad.first().messages) == 2
    recipes = spark.createDataFrame([('{"name": "a", "result": "b", "ingredients": {"x": 1}}',), ('{"name": "a", "result": "b", "ingredients": {"x": 0}}',)], "metadata string")
    assert quality.split_valid(recipes, quality.recipe_rules())[0].count() == 1
    known = spark.createDataFrame([("metal_sheet", "Sheet"), ("cloth", "Cloth")], "key string, name string")
    refs = spark.createDataFrame([("Metal Sheet",), ("CLOTH",), ("Glue",)], "ref string")
    assert [r.ref for r in quality.broken_references(refs, "ref", known, ["key", "name"]).collect()] == ["Glue"]


@pytest.fixture
def corpus(spark, tmp_path):
    src = tmp_path / "src"
    src.mkdir()
    for name, text in {"axe.md": "# Axe\nAn axe cuts wood and trees quickly.", "water.txt": "Water from a well is safe to drink after boiling.", "bad.json": "{", "dup.txt": "Water from a well is safe to drink after boiling."}.items():
        (src / name).write_text(text)
    return Corpus(spark, f"file://{tmp_path}/corpus"), src


def test_ingest_search_gate_status(spark, corpus, tmp_path):
    c, src = corpus
    assert ingest(c, f"file://{src}", at=1.0) == {"files": 4, "failed": 1, "chunks": 3}
    assert ingest(c, f"file://{src}", at=2.0)["chunks"] == 0  # only the bad file is tried again
    (src / "axe.md").write_text("# Axe\nAn axe is a heavy tool.")
    assert ingest(c, f"file://{src}", at=3.0) == {"files": 2, "failed": 1, "chunks": 1}
    e = Engine(c)
    assert e.rows().count() == 3 and e.search("heavy axe tool", 1).first().text.endswith("heavy tool.")
    hits = e.search_all("well water", 10).collect()
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True) and "Water" in hits[0].text
    assert e.search("water", 5, {"version": "b42"}).count() == 0 and e.search("water", 5, {"version": "b41"}).count() == 3
    some = e.search("water", 3).collect()[0]
    assert e.get(some.chunk_id).count() == 1 and e.lookup("nothing", "axe").count() == 1 and e.lookup(some.chunk_id, "axe").first().score == 1.0
    assert e.search_many(["axe tool", "boiling water"], 1).count() == 2
    assert "Question: water" in e.prompt("water")
    axe = e.search("axe", 1).first().chunk_id
    qs = spark.createDataFrame([("q1", "heavy axe tool", [axe], {"type": "item"}), ("q2", "anything", [], {})], "id string, question string, expected_ids array<string>, filter map<string,string>")
    per, verdict = gate.evaluate(e, qs)
    assert {r.id: r.recall for r in per.collect()} == {"q1": 1.0, "q2": 0.0} and not verdict.first().passed
    prod = Corpus(spark, f"file://{tmp_path}/prod")
    assert not gate.promote(c, prod, qs)["promoted"] and prod.chunks.current() is None
    assert gate.promote(c, prod, qs, threshold=0.5, dry_run=True)["promoted"] is False
    assert gate.promote(c, prod, qs, threshold=0.5)["promoted"] and prod.chunks.current().count() == 3
    report = json.loads(status.report(e, {"guides": 3, "items": 5}, "json"))
    assert {(a["level"], a["subject"]) for a in report["alerts"]} == {("critical", "items")}
    assert report["quarantine"][0]["n"] >= 1 and "## coverage" in status.report(e, {"guides": 3}, "markdown")
    assert {r.status for r in status.validation(e).collect()} == {"PASS"} and status.missing_collections(e, ["guides", "mobs"]).count() == 1
    drop_rows(c, [axe])
    assert e.rows().count() == 2
    drop_collection(c, "guides")
    assert e.rows().count() == 0
    gate.promote(c, prod, qs, force=True)
    gate.rollback(prod)
    assert prod.chunks.current().count() == 3


def test_empty_corpus(spark, tmp_path):
    e = Engine(Corpus(spark, f"file://{tmp_path}/none"))
    assert e.search("x").count() == 0 and e.collections().count() == 0


def test_command_line(spark, corpus, capsys):
    c, src = corpus
    assert cli.main([c.root, "ingest", f"file://{src}"]) == 0
    assert cli.main([c.root, "search", "axe", "-k", "1"]) == 0
    assert '"collection":"guides"' in capsys.readouterr().out
    (src / "golden.json").write_text(json.dumps([{"id": "q", "question": "axe", "expected_ids": ["none"], "filter": {}}]))
    assert cli.main([c.root, "evaluate", f"file://{src}/golden.json"]) == 1
    assert cli.main([c.root, "collections"]) == 0 and cli.main([c.root, "status"]) == 0


def test_stream_ingest_takes_new_changed_and_shrunken_files(spark, corpus):
    c, src = corpus
    (src / "long.md").write_text("\n\n".join(f"Paragraph {i} " + "word " * 60 for i in range(4)))
    stream_ingest.ingest_available(c, f"file://{src}")
    long = lambda: sorted(r.text for r in Engine(c).rows().filter(F.col("source").endswith("long.md")).collect())
    assert Engine(c).rows().count() == 7 and len(long()) == 4
    (src / "new.txt").write_text("A new text about bread.")
    (src / "long.md").write_text("Now short.")
    again = Corpus(spark, c.root)  # as after a restart
    stream_ingest.ingest_available(again, f"file://{src}")
    assert Engine(again).rows().count() == 5 and [t.strip() for t in long()] == ["Now short."]


def test_ingest_runs_as_a_stream(spark, corpus):
    c, src = corpus
    query = stream_ingest.ingest_stream(c, f"file://{src}", every="1 hour")
    for _ in range(120):  # the first tick comes at once
        if query.lastProgress or query.awaitTermination(1):
            break
    query.stop()
    assert Engine(c).rows().count() == 3


def test_upsert_stream_goes_on_after_restarts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "COMPACT", 2)
    want = {}
    for n in range(5):
        rows = [(k, n, f"v{n}") for k in (n, n + 1, 0)]
        want |= {k: f"v{n}" for k, _, _ in rows}
        spark.createDataFrame(rows, "k int, at int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = S.source(spark, f"{tmp_path}/in/0", folder=f"{tmp_path}/in")
        got = S.upsert_stream(stream, ["k"], "at", f"file://{tmp_path}/table")
        assert {r.k: r.v for r in got.collect()} == want and got.count() == len(want)
    elsewhere = S.upsert_stream(S.source(spark, f"{tmp_path}/in/0"), ["k"], "at", f"file://{tmp_path}/table", f"file://{tmp_path}/other")
    assert {r.k: r.v for r in elsewhere.collect()} == want  # a second stream of the same table keeps its own batches


T0 = 1_700_000_000  # seconds; streams take nothing from 1970 for new


def test_stream_heartbeats(spark, tmp_path):
    beats = [("a", 0), ("a", 30), ("a", 120), ("a", 300), ("a", 500), ("a", 5000), ("b", 0)]
    for some in (beats, [("c", 5000)]):
        spark.createDataFrame([(k, (T0 + s) * 1_000_000) for k, s in some], "k string, us long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/f")
    out = []
    S.run_available(S.heartbeats(S.source(spark, f"{tmp_path}/f", 1), "k"), lambda b, n: out.extend(map(tuple, b.collect())), "append")
    assert [(k, us) for k, us, _, _, lost in out if lost] == [("b", T0 * 1_000_000)]
    assert [(us // 1_000_000 - T0, n, alert) for k, us, n, alert, lost in sorted(out) if k == "a" and not lost] == [(0, 0, False), (30, 0, False), (120, 1, False), (300, 2, False), (500, 3, True), (5000, 1, False)]


def test_pointers_are_never_replaced(spark, tmp_path):
    root = f"file://{tmp_path}/s"
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    one, two = Snapshots(spark, root), Snapshots(spark, root)
    first = one.publish(rows, 3, {"n": 1})
    assert one.note() == {"n": 1}
    stale = two._read_pointer()
    second = one.publish(rows.withColumn("v", F.lit(2)), 3)
    with pytest.raises(RuntimeError):  # another writer was faster
        two._point(stale | {"current": first})
    assert one.current().first().v == 2 and two.list() == [first, second]
    last = max(tmp_path.glob("s/CURRENT-*.json"), key=lambda p: int(p.stem[8:]))
    (tmp_path / "s" / f".CURRENT-{int(last.stem[8:]) + 1}.json.1").write_text("{")  # a writer was lost, or has only begun
    assert two.current().first().v == 2
    two.publish(rows.withColumn("v", F.lit(3)), 3)
    assert one.current().first().v == 3 and len(one.list()) == 3


def test_of_two_writers_that_have_begun_one_fails(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/s"
    rows = spark.createDataFrame([("a", 1)], "k string, v int")
    one, two = Snapshots(spark, root, ["k"]), Snapshots(spark, root, ["k"])
    one.publish(rows, 3)
    write = Snapshots._write

    def meanwhile(self, *args):  # the other writes and finishes between this one's reading and its pointer
        monkeypatch.setattr(Snapshots, "_write", write)
        two.upsert(rows.withColumn("v", F.lit(2)), 3)
        return write(self, *args)

    monkeypatch.setattr(Snapshots, "_write", meanwhile)
    with pytest.raises(RuntimeError):
        one.upsert(rows.withColumn("v", F.lit(3)), 3)
    assert one.current().first().v == 2 and len(one.list()) == 2


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from lodestrata.session import shared_dir

    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_dir(fake)


def test_raw_records_and_tables(spark, tmp_path):
    rows = spark.createDataFrame([("items", " Big Axe!", '{"a": 1}'), ("items", " Big Axe!", '{"a": 1}'), ("mobs", "x", "{}")], "category string, name string, body string")
    for _ in range(2):  # again: the same files
        store.save_raw(rows, f"file://{tmp_path}/raw", "name", "body", "category")
        names = sorted(f"{p.parent.name}/{p.name[13:]}" for p in tmp_path.glob("raw/*/*"))
        assert names == ["items/big_axe_.json", "mobs/x.json"] and not list(tmp_path.glob("raw/.pending*"))
    assert next(tmp_path.glob("raw/items/*.json")).read_text() == '{"a": 1}'
    store.save_raw(rows.limit(1).withColumn("name", F.lit("x.json")), f"file://{tmp_path}/plain", "name", "body")
    assert [p.name[13:] for p in tmp_path.glob("plain/*")] == ["x.json"]
    health = spark.createDataFrame([("items", 1, "2024-01-01")], "collection_name string, chunk_count long, updated_at string")
    newer = spark.createDataFrame([("items", 2, "2024-01-02"), ("mobs", 5, "2024-01-01")], "collection_name string, chunk_count long, updated_at string")
    got = store.upsert_table(health, newer, "collection_health", "updated_at")
    assert {(r.collection_name, r.chunk_count) for r in got.collect()} == {("items", 2), ("mobs", 5)} and len(got.columns) == 8


def test_a_failed_write_of_records_leaves_nothing(spark, tmp_path):
    from lodestrata.sources import records

    records.register(spark)
    rows = spark.createDataFrame([(f"a/{i}.txt" if i != 150 else "../out.txt", f"body {i}") for i in range(200)], "name string, body string").repartition(4)
    with pytest.raises(Exception, match="not a name"):
        rows.write.format("record_files").mode("append").save(f"file://{tmp_path}/r")
    assert not list(tmp_path.glob("r/[!.]*"))
    old = tmp_path / "r" / ".pending-old"  # of a killed task, long ago
    old.mkdir(parents=True, exist_ok=True)
    os.utime(old, (1, 1))
    rows.filter("name not like '..%'").write.format("record_files").mode("append").save(f"file://{tmp_path}/r")
    assert {p.name: p.read_text() for p in tmp_path.glob("r/a/*")} == {f"{i}.txt": f"body {i}" for i in range(200) if i != 150}
    spark.createDataFrame([("a/0.txt", None)], "name string, body binary").write.format("record_files").mode("append").save(f"file://{tmp_path}/r")
    assert not old.exists()
    assert (tmp_path / "r/a/0.txt").read_bytes() == b"" and len(list(tmp_path.glob("r/a/*"))) == 199


def test_golden_items_in_blocks(spark, monkeypatch):
    import random

    rng = random.Random(11)
    text = lambda n: " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(150)] + [(900, None), (901, "")]
    items = [(i, " ".join(docs[i * 7][1].split()[1 : 3 + i])) for i in range(15)] + [(50, "zzzz"), (51, text(30))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: set((t or "").lower().split())
    want = set()
    for i, t in items:
        scored = sorted((-len(words(t) & words(x)), n) for n, x in docs if words(t) & words(x))[:4]
        want |= {(i, n, -s, k + 1) for k, (s, n) in enumerate(scored)}
    held = {(i, n) for i, t in items for n, x in docs if x is not None and t in x}
    for block, tile in ((200_000, 2_000_000), (25, 60)):
        monkeypatch.setattr(golden, "BLOCK_WORDS", block)
        monkeypatch.setattr(golden, "TILE", tile)
        assert {(r.item_id, r.doc_id, r.overlap, r["rank"]) for r in golden.overlap_ranked(q, d, 4).collect()} == want
        assert {tuple(r) for r in golden.passages(q, d).collect()} == held
    assert golden.overlap_ranked(q.limit(0), d, 4).count() == 0 and golden.passages(q.limit(0), d).count() == 0


def test_stream_equals_batch(spark, tmp_path):
    events = spark.createDataFrame([(i, f"2024-01-0{1 + i % 3} 0{i % 7}:00:00", i % 2, "e", float(i)) for i in range(30)], "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.repartition(3).write.parquet(f"{tmp_path}/e")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for slide in (None, "12 hours"):
        batch = S.tumbling(events, "1 day", ["event_type"], slide=slide)
        assert rows(S.latest_table(S.tumbling(S.timed(S.source(spark, f"{tmp_path}/e", 1)), "1 day", ["event_type"], slide=slide))) == rows(batch)


def test_stream_breaker_state(spark, tmp_path):
    fails = [("a", 0), ("a", 10_000_000), ("a", 20_000_000), ("a", 90_000_000), ("b", 0)]
    fails = [(k, T0 * 1_000_000 + us) for k, us in fails]
    spark.createDataFrame(fails, "k string, us long").coalesce(1).write.parquet(f"{tmp_path}/f")
    out = []
    S.run_available(S.breaker_states(S.source(spark, f"{tmp_path}/f"), "k", 3, 60), lambda b, n: out.extend(map(tuple, b.collect())), "append")
    assert [(k, us - T0 * 1_000_000, is_open) for k, us, is_open in sorted(out)] == [("a", 0, False), ("a", 10_000_000, False), ("a", 20_000_000, True), ("a", 90_000_000, False), ("b", 0, False)]


def test_stream_run_lifecycle(spark, tmp_path):
    spark.createDataFrame([("r1", "2024-01-01 00:00:00"), ("r2", "2024-01-01 00:00:00")], "id string, at string").select("id", F.col("at").cast("timestamp").alias("started_at")).write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([("r1", "2024-01-01 01:00:00", "completed")], "id string, at string, status string").select("id", F.col("at").cast("timestamp").alias("ended_at"), "status").write.parquet(f"{tmp_path}/e")
    out = []
    S.run_available(stream_ingest.run_lifecycle(S.source(spark, f"{tmp_path}/s"), S.source(spark, f"{tmp_path}/e")), lambda b, n: out.extend((r.id, r.status) for r in b.collect()), "append")
    assert ("r1", "completed") in out


def test_run_states_and_totals(spark):
    events = spark.createDataFrame([("r1", 1, "running", None, None), ("r1", 2, "completed", 5, None), ("r2", 1, "running", None, "x")], "id string, at int, status string, chunks int, note string")
    got = {r.id: (r.status, r.chunks, r.note, r.started_at, r.updated_at) for r in monitoring.run_states(events).collect()}
    assert got == {"r1": ("completed", 5, None, 1, 2), "r2": ("running", None, "x", 1, 1)}
    rows = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 3)], "k string, j string, n int")
    assert {(r.k, r.n) for r in monitoring.totals(rows, ["k"], ["n"]).collect()} == {("a", 3), ("b", 3), (None, 6)}
    steps = spark.createDataFrame([("r", 1, "static", "pass", 0, 1), ("r", 2, "boot", "fail", 2, 0), ("r", 3, "runtime", "pass", 0, 0)], "run_id string, level_no int, level string, result string, errors_found int, warnings_found int")
    assert [r.level for r in monitoring.step_summary(steps).orderBy("level_no").collect()] == ["static", "boot"]


def test_links_and_requests(spark):
    classes = spark.createDataFrame([("Box", ["a.b.Lid", "int", "List<Lid>[]", "Box"]), ("Lid", ["String"])], "name string, types array<string>")
    assert [tuple(r) for r in graph.class_links(classes).collect()] == [("Box", "Lid")]
    recipes = spark.createDataFrame([("plank", ["log", "saw", "log"])], "name string, refs array<string>")
    assert graph.typed_edges(recipes, "recipes", "name", "refs", "items", "uses").count() == 2
    visited = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "node string, depth int")
    assert graph.crawl_stats(visited).first().by_depth == {0: 1, 1: 2}
    asks = spark.createDataFrame([("mod BigAxe with a weapon",), ("a fast car",), ("hello",)], "t string")
    assert [tuple(r) for r in asks.select(quality.mod_type(F.col("t")), quality.mod_name(F.col("t"))).collect()] == [("item", "BigAxe"), ("vehicle", "a fast car"), ("feature", "hello")]
    said = spark.createDataFrame([("/stats Base.Axe",), ("/survie now",), ("stats de Base.Axe",), ("how to craft",), ("/luaapi x",), ("what is this",)], "t string")
    assert [r[0] for r in said.select(quality.intent(F.col("t"))).collect()] == ["stats", "survival", "stats", "recipe", "moddoc", "search"]
    assert said.select(quality.query_text(F.col("t"))).first()[0] == "Base.Axe"


def test_governance(spark):
    runs = spark.createDataFrame([(["x"], 0, 0, False), (["dependency_on_proprietary_mod"], 0, 0, False), ([], 3, 0, False), ([], 0, 2, False), ([], 0, 1, True), ([], 5, 0, False)], "e array<string>, f int, w int, c boolean")
    got = runs.select(quality.tier(F.col("e"), F.col("f"), F.col("w"), F.col("c")).alias("t"), quality.should_escalate(F.col("f"), F.col("e")).alias("s"), quality.escalation_reason(F.col("e")).alias("r")).collect()
    assert [r.t for r in got] == ["green", "red", "red", "orange", "orange", "red"] and [r.s for r in got] == [False, True, False, False, False, True]
    assert got[1].r == "critical: dependency_on_proprietary_mod" and got[0].r == "x"


def test_table_and_metadata_rules(spark):
    users = spark.createDataFrame([("a", "admin"), ("", "boss")], "username string, role string")
    assert [len(r.messages) for r in quality.split_valid(users, quality.table_rules("users"))[1].collect()] == [2]
    metas = spark.createDataFrame([('{"item_type": "food", "game_version": "b41", "base_id": "Base.X"}',), ('{"item_type": "song", "base_id": "y"}',)], "metadata string")
    good, bad = quality.split_valid(metas, quality.metadata_rules())
    assert good.count() == 1 and bad.first().messages == ["game_version is missing", "item_type is unknown"]


def test_overlap_counts_every_word(spark):
    items = spark.createDataFrame([(1, "the cat sat on a mat"), (2, "日本 東京 大阪"), (3, "considerable of it")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "The mat on a cat"), (2, "considerable"), (3, "東京 日本 of"), (4, "of of it"), (5, "")], "doc_id long, text string")
    got = sorted((r.item_id, r["rank"], r.doc_id, r.overlap) for r in golden.overlap_ranked(items, docs, 2).collect())
    assert got == [(1, 1, 1, 5), (2, 1, 3, 2), (3, 1, 4, 2), (3, 2, 2, 1)]


def test_running_sums_need_no_whole_group(spark):
    rows = [(None if i % 3 == 0 else f"g{0 if i % 3 == 1 else i % 7}", i, i % 5) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, i int, n int").repartition(7)
    got = {r.i: r.total for r in windows.running_sum(df, ["g"], [F.col("i")], F.col("n"), "total").collect()}
    assert got == {i: sum(n2 for g2, i2, n2 in rows if g2 == g and i2 <= i) for g, i, _ in rows}
    got = {r.i: r.total for r in windows.running_sum(df, [], [F.col("i").desc()], F.lit(1), "total").collect()}
    assert got == {i: 200 - i for i in range(200)}


def test_trailing_counts_are_cut_into_slots(spark):
    import random

    rng = random.Random(5)
    rows = sorted({("hot" if rng.random() < 0.9 else "cold", rng.randrange(0, 4_000)) for _ in range(500)})
    df = spark.createDataFrame([(i, k, s) for i, (k, s) in enumerate(rows)], "i int, k string, s int").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.i: (r.n, r.oldest, r.gap) for r in windows.trailing_count(df, ["k"], "ts", 60, "n").select("i", "n", F.col("__oldest").alias("oldest"), F.col("__gap").alias("gap")).collect()}
    for i, (k, s) in enumerate(rows):
        near = [x for j, x in rows if j == k and s - 60 <= x <= s]
        before = [x for j, x in rows if j == k and x < s]
        n, oldest, gap = got[i]
        assert (n, oldest) == (len(near), min(near) * 1_000_000)
        if n > 1:
            assert gap == (s - max(before)) * 1_000_000
