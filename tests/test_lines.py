"""Lines and sections of text files against plain splitting, files in many parts, sections in pieces."""

import csv
import random
import re

from lodestrata.sources import lines, parsers


def plain(text):
    """(section, heading, lines below it) by a loop."""
    out, fenced = [("", [])], False
    for line in text.split("\n")[: -1 if text.endswith("\n") else None]:
        line = line.removesuffix("\r")
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if not fenced and line.startswith("#") and line.lstrip("#")[:1] in (" ", "\t") and len(line) - len(line.lstrip("#")) <= 6:
            out.append((line.lstrip("#").strip().rstrip("#").strip(), []))
        else:
            out[-1][1].append(line)
    return [(n, h, b) for n, (h, b) in enumerate(out) if n or b]


def test_sections_equal_a_loop(spark, tmp_path):
    rng = random.Random(3)
    bits = ["# One", "## Two ##", "#not", "####### seven", "text here", "", "  ```", "```py", "# in code", "ü line\r", "### Three"]
    texts = {f"{i}.md": "\n".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) + "\n" for i in range(12)} | {"empty.md": "", "x.txt": "# no"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")  # a file is many parts
    try:
        found = lines.lines(spark, f"file://{tmp_path}", "*.md")
        assert found.select("path", "part").distinct().count() > 24
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for r in lines.headed(found).orderBy("path", "n").collect():
        held = got.setdefault(r.path.rsplit("/", 1)[1], {}).setdefault((r.section, r.heading), [])
        if r.section == 0 or r.place > 0:
            held.append(r.line)
            assert r.place == len(held)
    assert got == {name: {(n, h): b for n, h, b in plain(text)} for name, text in texts.items() if text and name.endswith(".md")}
    for name, text in texts.items():  # the headings that the parser of whole files finds
        if name.endswith(".md") and "\r" not in text:
            assert [h for h, _ in parsers.sections(text) if h] == [h for _, h, _ in plain(text) if h]


def test_sections_in_pieces(spark, tmp_path):
    body = [f"line {i} " + "x" * (i % 50) for i in range(400)]
    (tmp_path / "a.md").write_text("\n".join(["before", "# H", *body, "# Empty", "", "# Last", "end"]) + "\n")
    pieces = lines.section_pieces(lines.headed(lines.lines(spark, f"file://{tmp_path}")), 300).orderBy("section", "piece").collect()
    assert "\n".join(p.text for p in pieces if p.heading == "H") == "\n".join(body)
    assert max(len(p.text) for p in pieces) < 300 + 70 and [p.text for p in pieces if p.heading in ("", "Last")] == ["before", "end"]
    assert not [p for p in pieces if p.heading == "Empty"]


def test_csv_equals_a_reader(spark, tmp_path):
    rng = random.Random(5)
    bits = ["plain", "", " spaced ", "with, comma", 'a "quote"', "line\nend", '""', ",", '"', "ü", "two\n\nends", "x" * 90]
    tables = {f"{i}.csv": [["id", "name", "note"], *[[rng.choice(bits) for _ in range(rng.randrange(2, 5))] for _ in range(rng.randrange(0, 30))]] for i in range(10)}
    for name, rows in tables.items():
        with open(tmp_path / name, "w", newline="") as f:
            csv.writer(f, lineterminator="\n" if name < "5" else "\r\n").writerows(rows[:3])
            f.write("\n , \n")
            csv.writer(f, lineterminator="\n").writerows(rows[3:])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64b")  # parts begin within quoted fields
    try:
        got = {}
        for r in lines.csv_records(lines.lines(spark, f"file://{tmp_path}")).orderBy("path", "record").collect():
            assert r.piece == 0 and r.record == len(got.setdefault(r.path.rsplit("/", 1)[1], []))
            got[r.path.rsplit("/", 1)[1]].append(r.fields)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    # a line of commas and quotes alone is blank, as the parser of whole files has it for the rows that it reads
    filled = lambda rows: [row for row in rows if any(re.sub(r'[\s,"]', "", x) for x in row)]
    assert got == {name: filled(rows) for name, rows in tables.items()}


def test_a_quote_that_stays_open(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,a\n2,\"open\n" + "".join(f"{i},x\n" for i in range(3, 200)))
    got = lines.csv_records(lines.lines(spark, f"file://{tmp_path}"), 100).orderBy("record", "piece").collect()
    assert [r.fields for r in got[:2]] == [["id", "name"], ["1", "a"]] and max(len(r.fields[0]) for r in got) < 110
    assert "\n".join(r.fields[0] for r in got[2:]) == "2,\"open\n" + "\n".join(f"{i},x" for i in range(3, 200))
