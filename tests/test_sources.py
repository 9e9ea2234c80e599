"""Parsers and file sources on small invented inputs."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestrata.sources import containers, dumps, extract, files, packages, parsers


def test_decoding_cascade():
    assert files.decode_bytes("é".encode()) == "é"
    assert files.decode_bytes("é€".encode("cp1252")) == "é€"
    assert files.decode_bytes("é".encode("utf-16")) == "é"
    assert files.decode_bytes(b"\xef\xbb\xbfabc") == "abc"
    assert files.decode_bytes(b"\x81") == "\x81"
    assert files.decode_bytes(None) == ""


def test_csv_keeps_ragged_rows():
    got = parsers.parse_csv("id,name\n1,Axe\n2,Saw,extra\n\n")
    assert [r["metadata"] for r in got] == [{"id": "1", "name": "Axe"}, {"raw": "2,Saw,extra"}]


def test_xml_entities():
    got = parsers.parse_entity_xml('<r><item id="Base.Axe" weight="2.5" type="Tool"><tag>Sharp</tag></item><recipe name="Plank" result="Plank"><ingredients><ingredient item="Log" count="1"/><ingredient item="Saw" count="2"/></ingredients><skill>Wood</skill></recipe><trait id="Fit" cost="6"><effect>a</effect><effect>b</effect></trait></r>')
    assert got[0]["metadata"] == {"id": "Base.Axe", "weight": 2.5, "type": "Tool", "tags": ["Sharp"]}
    assert got[1]["metadata"]["ingredients"] == {"Log": 1.0, "Saw": 2.0} and got[1]["metadata"]["skills"] == ["Wood"]
    assert got[2]["metadata"] == {"id": "Fit", "cost": 6.0, "effects": ["a", "b"]}
    with pytest.raises(ValueError):
        parsers.parse_xml('<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')


def test_markdown_sections_and_metadata():
    got = parsers.parse_markdown('intro\n# One\n<!-- meta: {"level": 2} -->\ntext\n```\n# not a heading\n```\n## Two\nmore')
    assert [r["name"] for r in got] == ["", "One", "Two"]
    assert got[1]["metadata"] == {"level": 2} and "not a heading" in got[1]["text"]


def test_lua_docs_and_sources():
    doc = parsers.parse_lua_doc("## getPlayer\nGives a player.\n### index : number — which one\n## stop\nEnds.")
    assert [r["name"] for r in doc] == ["getPlayer", "stop"]
    assert doc[0]["metadata"]["parameters"] == [{"name": "index", "type": "number", "text": "which one"}]
    src = parsers.parse_lua('-- function no()\nlocal function helper(a, b)\nend\nMyUI = Panel:derive("MyUI")\nfunction MyUI:new(x)\nend\nMAX_SIZE = 10\n--[[ function never() ]]\nTable = {\n}')
    assert {(r["kind"], r["name"]) for r in src} == {("function", "helper"), ("class", "MyUI"), ("function", "MyUI:new"), ("constant", "MAX_SIZE"), ("class", "Table")}
    assert next(r for r in src if r["name"] == "MyUI:new")["metadata"]["owner"] == "MyUI"


JAVA = """
package demo.game;
import java.util.List;
import java.util.Map;
/** A box of things. */
public class Box extends Base implements Lid, Comparable<Box> {
    private static final int SIZE = 3;
    public Map<String, List<Integer>> parts;
    public Box(int n) { this.n = n; }
    /**
     * Opens it.
     * @param how the way, in words
     * @return whether it opened
     */
    @Override
    public boolean open(final String how, Map<String, Integer> keys) throws IOException { if (x) { return "}".isEmpty(); } return true; }
    static void count() {}
    protected abstract int size();
}
class Empty {}
"""


def test_java_classes():
    box, empty = parsers.parse_java(JAVA)
    m = box["metadata"]
    assert (box["name"], m["package"], m["extends"], m["implements"]) == ("Box", "demo.game", "Base", ["Lid", "Comparable<Box>"])
    assert m["javadoc"] == "A box of things." and m["imports"] == ["java.util.List", "java.util.Map"]
    assert [(f["name"], f["type"], f["static"], f["default"]) for f in m["fields"]] == [("SIZE", "int", True, "3"), ("parts", "Map<String, List<Integer>>", False, "")]
    assert [x["name"] for x in m["methods"]] == ["open", "count", "size"]
    assert m["methods"][0]["parameters"] == [{"type": "String", "name": "how"}, {"type": "Map<String, Integer>", "name": "keys"}]
    assert m["methods"][0]["annotations"] == ["Override"] and m["methods"][0]["javadoc"] == "Opens it."
    assert m["methods"][1]["static"] and m["methods"][2]["abstract"]
    assert empty["name"] == "Empty" and "methods" not in empty["metadata"]
    assert parsers.javadoc("* Does.\n * @param a the a\n * @return b")["params"] == {"a": "the a"}
    assert parsers.parse_java("no class here") == []


def zipped(path, members):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in members.items():
            z.writestr(name, data)
    return path.read_bytes()


def test_containers(tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    docx = zipped(tmp_path / "a.docx", {"word/document.xml": f"<w:document {w}><w:body>{p('One')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Two')}</w:body></w:document>"})
    assert containers.parse_docx(docx)[0]["text"] == "One\n\na | b\n\nTwo"
    opf = '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>T</dc:title></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>'
    epub = zipped(tmp_path / "a.epub", {"META-INF/container.xml": '<c><rootfiles><rootfile full-path="O/p.opf"/></rootfiles></c>', "O/p.opf": opf, "O/c.xhtml": "<html><h1>Start</h1><p>Text &amp; more</p></html>"})
    assert containers.parse_epub(epub)[0]["markup"] and "Text &amp; more" in containers.parse_epub(epub)[0]["text"] and containers.parse_epub(epub)[0]["metadata"]["title"] == "T"
    got = containers.parse_archive(zipped(tmp_path / "a.zip", {"a.lua": "x=1", "b.lua": "y" * 20_000, "c.txt": "t", "d.png": "no"}))
    assert [r["name"] for r in got] == ["a.lua", "b.lua", "c.txt"] and {r["metadata"]["collection"] for r in got} == {"scripts"}
    assert len(got[1]["text"]) == containers.MEMBER_CHARS


@pytest.fixture
def tree(tmp_path):
    for name, data in {"a/readme.md": b"# Title\nbody", "a/b/x.txt": "caf\xe9".encode("cp1252"), "backup/old.txt": b"old", "bad.xml": b"<a>", "blob": b"\x00\x01", "plain": b"just text", "page.html": b"<p>Hello &amp; bye</p><script>no</script>"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan_detect_and_records(spark, tree):
    found = files.detect(files.scan(spark, f"file://{tree}"))
    kinds = {r.path.rpartition("/")[2]: r.kind for r in found.select("path", "kind").collect()}
    assert kinds == {"readme.md": "markdown", "x.txt": "text", "bad.xml": "xml", "blob": "binary", "plain": "text", "page.html": "html"}
    assert files.texts(found.filter(F.col("path").endswith("x.txt"))).first().text == "café"
    parsed = extract.records(found).cache()
    assert {r.source.rpartition("/")[2] for r in extract.bad(parsed).collect()} == {"bad.xml", "blob"}
    rows = {r.source.rpartition("/")[2]: r for r in extract.chunks(parsed).collect()}
    assert rows["page.html"].text == "Hello & bye" and rows["readme.md"].name == "Title"
    assert files.scan(spark, f"file://{tree}", recursive=False).count() == 4


def test_entity_dump(spark, tmp_path):
    one = tmp_path / "one"
    one.mkdir()
    (one / "dump.json").write_text(json.dumps({"items": {"axe": {"Name": "Axe", "Type": "Weapon", "weight": 0, "damage": 3}, "_meta": {}, "odd": 5}, "recipes": [{"name": "Plank", "Result": "plank", "ingredients": {"log": 1, "saw": 1}}], "unknown": {"x": {"name": "X"}}, "broken": 7}))
    got = {r.chunk_id: r for r in dumps.normalise(dumps.read(spark, str(one))).collect()}
    assert set(got) == {"items.axe", "recipes.0", "unknown.x"}
    assert got["items.axe"].text == "Axe\ntype: Weapon\nweight: 0" and got["items.axe"]["class"] == "weapon_firearm" and got["items.axe"].completeness == round(3 / 9, 6)
    assert got["recipes.0"].ingredient_refs == ["log", "saw"] and got["recipes.0"].result_ref == "plank"
    assert got["unknown.x"].collection == "web_pages"
    assert got["recipes.0"].completeness == 0.5
    many = tmp_path / "many"
    many.mkdir()
    (many / "items.json").write_text(json.dumps({"saw": {"name": "Saw"}}))
    (many / "recipes.json").write_text(json.dumps([{"name": "Cut"}]))
    assert {(r.category, r.key) for r in dumps.read(spark, str(many)).collect()} == {("items", "saw"), ("recipes", "0")}
    objects = spark.createDataFrame([("Base.Axe", "item", "b41", "Axe", "Cuts.", ["t"], {"damage": "3"}), ("Base.Rag", "item", "b41", "Rag", "Soft.", ["t"], {})], "base_id string, item_type string, game_version string, display_name string, description string, tags array<string>, game_specific map<string,string>")
    assert sorted(r.chunk_id for r in dumps.structured_chunks(objects).collect()) == ["Base.Axe::full", "Base.Axe::stats", "Base.Rag::full"]


def test_packages(spark, tmp_path):
    for name, text in {"123/addoninfo.txt": 'title "Big Axe"\nauthor=Ann\ntags = a; b', "123/mod.info": "id=x\nname=X", "123/media/lua/a.lua": "function f() end", "456/README.md": "# Saw\nmore", "456/bad.json": "{", "other/x.txt": "no"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan(spark, f"file://{tmp_path}")
    got = {r.package: r for r in packages.packages(found).collect()}
    assert set(got) == {"123", "456"} and got["123"].n_files == 3 and got["123"].tags == ["a", "b"] and got["123"].author == "Ann"
    assert got["456"].name == "Saw"
    rows, result = packages.ingest(found)
    assert {(r.package, r.n_errors, r.success) for r in result.collect()} == {("123", 0, True), ("456", 1, True)}
    assert {r.collection for r in rows.collect()} == {"scripts", "guides"}
    checks = {(r.package, r.message) for r in packages.check_manifests(found).collect()}
    assert ("123", "description is missing") in checks and ("456", "mod.info is missing") in checks and ("123", "media is missing") not in checks
    log = spark.createDataFrame([("all fine",), ("STACK TRACE at x",), ("error in a.lua",)], "value string")
    assert [r.alert for r in packages.log_alerts(log).collect()] == ["stack trace", "script error"]
    subjects = spark.createDataFrame([("feat: a",), ("fix(x): b",), ("misc",), ("chore(release): 1",)], "value string")
    assert {r.kind: r.n for r in packages.commits(subjects).collect()} == {"feat": 1, "fix": 1, "other": 1}
    paged = spark.createDataFrame([("s", "--- Page 1 ---\nOne. Two.\n--- Page 2 ---\nThree.")], "source string, text string")
    assert [r.text.strip() for r in packages.page_chunks(paged).orderBy("page").collect()] == ["One. Two.", "Three."]


def test_wide_decoding():
    assert files.decode_wide("grüße".encode("utf-16-le")) == "grüße" and files.decode_wide("été".encode("cp1252")) == "été"
    assert files.decode_wide(b"\x00\x01\x02\x90\x8f") == "000102908f" and files.decode_wide(None) == "" and files.decode_wide("日本".encode()) == "日本"


def test_markup_keeps_words_apart(spark, tmp_path):
    (tmp_path / "a.html").write_text("<table><tr><td>one</td><td>two &eacute;&#233;</td></tr></table>")
    (tmp_path / "b.html").write_text("<script>x</script>")
    got = {r.source[-6:]: r for r in extract.records(files.scan(spark, f"file://{tmp_path}")).collect()}
    assert got["a.html"].text.split() == ["one", "two", "éé"] and got["b.html"].error == "no text"


def test_chapters_become_text(spark, tmp_path):
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="c" href="c.xhtml"/><item id="d" href="d.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="d"/></spine></package>'
    zipped(tmp_path / "a.epub", {"META-INF/container.xml": '<c><rootfiles><rootfile full-path="p.opf"/></rootfiles></c>', "p.opf": opf, "c.xhtml": "<h1>A<b>b</b></h1><td>one</td><td>two &amp;</td>", "d.xhtml": "<p> </p>"})
    (got,) = extract.records(files.scan(spark, f"file://{tmp_path}")).collect()
    assert (got["name"], got.text.split(), got.error) == ("A b", ["A", "b", "one", "two", "&"], None)


def test_long_cards_are_split(spark, tmp_path):
    (tmp_path / "items.json").write_text(json.dumps({"axe": {"Name": "Axe", "description": "word " * 500 + "\n\n" + "more " * 500}, "saw": {"Name": "Saw"}}))
    got = dumps.chunks(dumps.normalise(dumps.read(spark, str(tmp_path)))).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.split) for r in got] == [("items.axe", True), ("items.axe#1", True), ("items.saw", False)]
    assert all(r.text.startswith("Axe") for r in got[:2])


def test_parsers_by_kind():
    assert parsers.PARSERS["markdown"]("## f\nmakes\n### a : int - count")[0]["kind"] == "function"
    assert parsers.PARSERS["markdown"]("## f\n### note\nx")[0]["kind"] == "section"
    assert parsers.PARSERS["xml"]('<r><item id="B.A" weight="1"/></r>')[0]["metadata"]["weight"] == 1.0
