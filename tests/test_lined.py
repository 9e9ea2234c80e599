"""Files read by line give the records that the parsers of whole files give; bounds, encodings, what fails."""

import json
import random

from lodestrata.plans.ingest import Corpus, ingest
from lodestrata.sources import extract, files, lined


def read(spark, folder):
    found = files.scan(spark, f"file://{folder}")
    paths = [r.path for r in found.select("path").collect()]
    return extract.read(spark, paths, extract.hashed(files.named(spark, paths)))


def told(rows):
    """Records by file, in order, without their numbers."""
    out = {}
    for r in sorted(rows, key=lambda r: (r.source, r.record_index)):
        out.setdefault(r.source.rsplit("/", 1)[1], []).append((r.name, r.text, None if r.metadata is None else json.loads(r.metadata), r.error, r.file_hash))
    return out


def test_records_equal_the_parsers(spark, tmp_path):
    rng = random.Random(11)
    bits = ["# One", "## two", "### a : int — first", "### note", "body text", "", '<!-- meta: {"level": 2, "none": ""} -->', "<!-- a comment -->", "```", "<!-- meta:\n{\"b\": [1]}\n-->", "ünï\tx  "]
    for i in range(16):
        (tmp_path / f"m {i}+é.md").write_text("\n".join(rng.choice(bits[:2] + bits[3:] if i % 2 else bits) for _ in range(rng.randrange(1, 25))) + "\n")
    cells = ["", "a", "b, c", 'd "e"', " f ", "g\nh", "ü"]
    for i in range(8):
        quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c
        body = [",".join(quoted(rng.choice(cells)) for _ in range(rng.choice([3, 3, 3, 2, 4]))) for _ in range(rng.randrange(0, 12))]
        (tmp_path / f"t{i}.csv").write_text("\n".join([["id,name,note", "x, name ,z", "a,b,c"][i % 3], *body]) + "\n")
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfid,v\n1,x\n")
    (tmp_path / "latin.md").write_bytes("# caf\xe9\nth\xe9".encode("cp1252"))
    (tmp_path / "wide.md").write_bytes("# Title\nbody".encode("utf-16"))
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / "other.txt").write_text("plain")
    got, want = told(read(spark, tmp_path).collect()), told(extract.records(files.scan(spark, f"file://{tmp_path}")).collect())
    assert got.keys() == want.keys()
    for name in want:
        assert got[name] == want[name], name


def test_long_sections_and_bad_metadata(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lined, "RECORD_CHARS", 1000)
    body = [f"line {i} " + "y" * 40 for i in range(200)]
    (tmp_path / "long.md").write_text("# H\n" + "\n".join(body) + "\n")
    (tmp_path / "bad.md").write_text("# Bad\n<!-- meta: {no} -->\n# Good\ntext\n")
    rows = read(spark, tmp_path).collect()
    long = sorted((r for r in rows if r.source.endswith("long.md")), key=lambda r: r.record_index)
    assert len(long) > 8 and {r.name for r in long} == {"H"} and max(len(r.text) for r in long) < 1100
    assert "\n".join(r.text.removeprefix("H\n") for r in long) == "\n".join(body)
    bad = {r.name: r.error for r in rows if r.source.endswith("bad.md")}
    assert bad["Bad"].startswith("ValueError") and bad["Good"] is None


def test_ingest_reads_by_line(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "a.csv").write_text("id,name\nk1,Axe\nk2,Saw\n")
    (raw / "b.md").write_text("# Bad\n<!-- meta: {no} -->\n# Good\ntext\n")
    corpus = Corpus(spark, f"file://{tmp_path}/corpus")
    assert ingest(corpus, f"file://{raw}") == {"files": 2, "failed": 1, "chunks": 3}
    assert {r.chunk_id for r in corpus.chunks.current().collect()} >= {"k1", "k2"}
    assert ingest(corpus, f"file://{raw}")["files"] == 1  # what failed in part is tried again
    (raw / "b.md").write_text("# Bad\n# Good\nnew text\n")
    assert ingest(corpus, f"file://{raw}") == {"files": 1, "failed": 0, "chunks": 2}
    assert {r.text for r in corpus.chunks.current().collect()} == {"id: k1\nname: Axe", "id: k2\nname: Saw", "Bad", "Good\nnew text"}
