"""Parsers of single texts. Each gives records: dicts with ``name``, ``kind``, ``text`` and ``metadata``.

They are plain functions of one file's text; ``sources.extract`` runs them on the executors.
"""

from __future__ import annotations

import csv
import io
import json
import re
import xml.etree.ElementTree as ET
from typing import Any

from .files import key_values

Record = dict[str, Any]


def record(name: str, kind: str, text: str, /, **metadata: Any) -> Record:
    return {"name": name, "kind": kind, "text": text.strip(), "metadata": {k: v for k, v in metadata.items() if v not in (None, "", [], {})}}


def parse_text(text: str) -> list[Record]:
    return [record("", "text", text)] if text.strip() else []


def parse_json(text: str) -> list[Record]:
    data = json.loads(text)
    return [record(str(d.get("name", i)) if isinstance(d, dict) else str(i), "json", json.dumps(d, ensure_ascii=False, sort_keys=True), fields=len(d) if isinstance(d, dict) else None) for i, d in enumerate(data if isinstance(data, list) else [data])]


def parse_csv(text: str) -> list[Record]:
    """A record per row under the header's names; a row of another width is kept raw."""
    rows = list(csv.reader(io.StringIO(text)))
    if not rows:
        return []
    head = [h.strip() for h in rows[0]]
    out = []
    for i, row in enumerate(r for r in rows[1:] if any(c.strip() for c in r)):
        fields = dict(zip(head, (c.strip() for c in row), strict=True)) if len(row) == len(head) else {"raw": ",".join(row)}
        out.append(record(fields.get("name", fields.get("id", str(i))), "csv", "\n".join(f"{k}: {v}" for k, v in fields.items()), **fields))
    return out


def flatten(e: ET.Element) -> dict[str, Any]:
    """Attributes and children of an element; children that repeat become lists, texts of leaves are values."""
    out: dict[str, Any] = dict(e.attrib)
    for child in e:
        value: Any = flatten(child) if len(child) or child.attrib else (child.text or "").strip()
        if child.tag in out:
            out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), value]
        else:
            out[child.tag] = value
    if e.text and e.text.strip() and not len(e):
        out["text"] = e.text.strip()
    return out


def parse_xml(text: str) -> list[Record]:
    """A record per child of the root, or the root itself if it has none. Documents with entity declarations are refused."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text):
        raise ValueError("XML with declarations isn't read")
    root = ET.fromstring(text)
    out = []
    for e in list(root) or [root]:
        fields = flatten(e)
        name = str(fields.get("id") or fields.get("name") or e.tag)
        out.append(record(name, e.tag, "\n".join(f"{k}: {v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)}" for k, v in fields.items()), **fields))
    return out


def parse_entity_xml(text: str) -> list[Record]:
    """Items, recipes and traits: typed records with the fields each kind has."""
    out = []
    for r in parse_xml(text):
        f = r["metadata"]
        if r["kind"] == "item":
            r["metadata"] = {"id": f.get("id") or f.get("name"), "weight": _number(f.get("weight")), "type": f.get("type"), "tags": _list(f.get("tags") or f.get("tag"))}
        elif r["kind"] == "recipe":
            parts = f.get("ingredients", {})
            parts = parts.get("ingredient", []) if isinstance(parts, dict) else parts
            parts = parts if isinstance(parts, list) else [parts]
            r["metadata"] = {"name": r["name"], "result": f.get("result"), "ingredients": {p.get("item", p.get("name", "?")) if isinstance(p, dict) else str(p): _number(p.get("count", 1)) if isinstance(p, dict) else 1 for p in parts}, "skills": _list(f.get("skill"))}
        elif r["kind"] == "trait":
            r["metadata"] = {"id": f.get("id") or f.get("name"), "cost": _number(f.get("cost")), "effects": _list(f.get("effect"))}
        out.append(r)
    return out


def _number(v: Any) -> float | None:
    try:
        return float(v)
    except (TypeError, ValueError):
        return None


def _list(v: Any) -> list[Any]:
    if v is None:
        return []
    return v if isinstance(v, list) else [x.strip() for x in v.split(";")] if isinstance(v, str) else [v]


def sections(text: str, level: str = r"#{1,6}") -> list[tuple[str, str]]:
    """(heading, body) of a Markdown text; what precedes the first heading has an empty one."""
    out: list[tuple[str, list[str]]] = [("", [])]
    fenced = False
    for line in text.splitlines():
        if line.lstrip().startswith("```"):
            fenced = not fenced
        m = None if fenced else re.match(rf"({level})\s+(.*?)\s*#*$", line)
        if m:
            out.append((m[2], []))
        else:
            out[-1][1].append(line)
    return [(h, "\n".join(b).strip()) for h, b in out if h or "\n".join(b).strip()]


def parse_markdown(text: str) -> list[Record]:
    """A record per section; ``<!-- meta: {json} -->`` comments give its metadata."""
    out = []
    for heading, body in sections(text):
        meta: dict[str, Any] = {}
        for m in re.finditer(r"<!--\s*meta:\s*(\{.*?\})\s*-->", body, re.S):
            meta |= json.loads(m[1])
        body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
        out.append(record(heading, "section", f"{heading}\n{body}", **meta))
    return out


def parse_lua_doc(text: str) -> list[Record]:
    """Documented functions: ``## name`` sections whose ``### parameter : type — text`` lines are the parameters."""
    out = []
    for heading, body in sections(text, "##"):
        if not heading:
            continue
        params = [{"name": m[1], "type": m[2], "text": m[3] or ""} for m in re.finditer(r"(?m)^###\s+(\w+)\s*:\s*([\w.<>\[\]]+)(?:\s*(?:—|-)\s*(.*))?$", body)]
        plain = re.sub(r"(?m)^###.*$", "", body)
        out.append(record(heading, "function", f"{heading}\n{plain}", parameters=params))
    return out


def parse_lua(text: str) -> list[Record]:
    """Functions, classes (tables) and constants at the outermost level of a Lua source."""
    bare = re.sub(r"--\[\[.*?\]\]", "", text, flags=re.S)
    bare = re.sub(r"--[^\n]*", "", bare)
    out = []
    for m in re.finditer(r"(?m)^\s*(local\s+)?function\s+([\w.:]+)\s*\(([^)]*)\)", bare):
        args = [a.strip() for a in m[3].split(",") if a.strip()]
        owner = re.match(r"([\w.]+)[.:]\w+$", m[2])
        out.append(record(m[2], "function", f"function {m[2]}({', '.join(args)})", arguments=args, local=bool(m[1]), owner=owner[1] if owner else None))
    for m in re.finditer(r"(?m)^(?:local\s+)?([A-Z]\w*)\s*=\s*(?:[\w.]+[:.]derive\(\s*\"(\w+)\"\s*\)|\{)", bare):
        out.append(record(m[1], "class", f"class {m[1]}" + (f" : {m[2]}" if m[2] else ""), parent=m[2]))
    for m in re.finditer(r"(?m)^(?:local\s+)?([A-Z][A-Z0-9_]+)\s*=\s*(\"[^\"\n]*\"|-?\d+(?:\.\d+)?|true|false)", bare):
        out.append(record(m[1], "constant", f"{m[1]} = {m[2]}", value=m[2].strip('"')))
    return out


JAVADOC = re.compile(r"/\*\*(.*?)\*/", re.S)
MODIFIERS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|transient|volatile|strictfp)\s+)*"
NAMED = r"[\w.]+(?:<[^;{}()]*>)?(?:\[\])*"


def javadoc(block: str) -> dict[str, Any]:
    lines = [re.sub(r"^\s*\*?\s?", "", x) for x in block.strip().splitlines()]
    body = "\n".join(lines)
    params = dict(re.findall(r"@param\s+(\w+)\s+([^@]*)", body))
    returns = re.search(r"@returns?\s+([^@]*)", body)
    return {"text": body.split("@")[0].strip(), "params": {k: " ".join(v.split()) for k, v in params.items()}, "returns": " ".join(returns[1].split()) if returns else ""}


def split_outside(s: str, sep: str = ",") -> list[str]:
    """Split where no bracket is open."""
    out, depth, held = [], 0, ""
    for ch in s:
        depth += (ch in "<([{") - (ch in ">)]}")
        if ch == sep and depth == 0:
            out.append(held)
            held = ""
        else:
            held += ch
    return [x.strip() for x in [*out, held] if x.strip()]


def matching_brace(s: str, at: int) -> int:
    """Where the block that opens at ``at`` ends; braces in strings and comments don't count."""
    depth, i = 0, at
    for m in re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/|[{}]", re.S).finditer(s, at):
        if m[0] in "{}":
            depth += 1 if m[0] == "{" else -1
            i = m.end()
            if depth == 0:
                return i
    return len(s)


def parse_java(text: str) -> list[Record]:
    """Each class, interface or enum with its fields and methods (constructors left out) as nested metadata."""
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", text)
    imports = re.findall(r"(?m)^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", text)
    out = []
    head = re.compile(rf"({MODIFIERS})(class|interface|enum)\s+(\w+)(?:<[^{{]*?>)?(?:\s+extends\s+([\w.<>, ]+?))?(?:\s+implements\s+([\w.<>, ]+?))?\s*\{{")
    for m in head.finditer(re.sub(r"(?s)/\*.*?\*/|//[^\n]*", lambda c: re.sub(r"[^\n]", " ", c[0]), text)):
        end = matching_brace(text, m.end() - 1)
        body = text[m.end() : end - 1]
        docs = [d for d in JAVADOC.finditer(text, 0, m.start())]
        about = javadoc(docs[-1][1])["text"] if docs and not text[docs[-1].end() : m.start()].replace("@", "").strip().strip(";") else ""
        fields, methods = java_members(body, m[3])
        lines = [f"{m[2]} {m[3]}" + (f" extends {m[4]}" if m[4] else "") + (f" implements {m[5]}" if m[5] else ""), f"package {package[1]}" if package else "", about]
        lines += ["imports: " + ", ".join(imports[:15])] if imports else []
        lines += [f"{f['access']} {f['type']} {f['name']}" for f in fields]
        lines += [f"{x['access']} {x['returns']} {x['name']}({', '.join(p['type'] + ' ' + p['name'] for p in x['parameters'])})" for x in methods]
        out.append(record(m[3], m[2], "\n".join(x for x in lines if x), package=package[1] if package else "", extends=m[4], implements=split_outside(m[5] or ""), imports=imports[:20], fields=fields, methods=methods, javadoc=about))
    return out


def java_members(body: str, owner: str) -> tuple[list[Record], list[Record]]:
    """Fields and methods at the first level of a class body."""
    level, i = "", 0
    while i < len(body):  # blocks of methods and inner classes are cut out
        if body[i] == "{":
            i = matching_brace(body, i)
            level += "{}"
        else:
            level += body[i]
            i += 1
    access = lambda mods: next((a for a in ("public", "protected", "private") if a in mods), "package")
    methods, fields = [], []
    method = re.compile(rf"(?:/\*\*((?:(?!\*/).)*)\*/\s*)?((?:@\w+(?:\([^)]*\))?\s+)*)({MODIFIERS})(?:<[^>]+>\s+)?({NAMED})\s+(\w+)\s*\(([^)]*)\)\s*(?:throws\s+[\w., ]+)?\s*(\{{\}}|;)", re.S)
    for m in method.finditer(level):
        if m[5] == owner or m[4] in ("return", "new", "else", "throw"):
            continue
        params = []
        for p in split_outside(m[6]):
            kind, _, name = re.sub(r"@\w+\s+|final\s+", "", p).rpartition(" ")
            params.append({"type": kind.strip(), "name": name})
        doc = javadoc(m[1]) if m[1] else {"text": ""}
        methods.append({"name": m[5], "returns": m[4], "access": access(m[3]), "static": "static" in m[3], "abstract": "abstract" in m[3] or m[7] == ";", "parameters": params, "javadoc": doc["text"], "annotations": re.findall(r"@(\w+)", m[2])})
    rest = method.sub(";", re.sub(r"(?s)/\*.*?\*/", "", level))
    for m in re.finditer(rf"(?m)(?:^|[;}}])\s*((?:@\w+\s+)*)({MODIFIERS})({NAMED})\s+(\w+)\s*(?:=\s*([^;]*))?(?=;)", rest):
        if m[3] not in ("return", "package", "import", "throw", "new", "class", "enum", "interface"):
            fields.append({"name": m[4], "type": m[3], "access": access(m[2]), "static": "static" in m[2], "default": (m[5] or "").strip()})
    return fields, methods


def parse_key_values(text: str) -> list[Record]:
    found = key_values(text)
    return [record(found.get("name", ""), "config", "\n".join(f"{k}: {v}" for k, v in found.items()), **found)] if found else parse_text(text)


def parse_markdown_or_lua_doc(text: str) -> list[Record]:
    """Documented functions if a text lists typed parameters under its headings, else its sections."""
    return parse_lua_doc(text) if re.search(r"(?m)^###\s+\w+\s*:\s*[\w.<>\[\]]+(?:\s*(?:—|-)\s.*)?$", text) else parse_markdown(text)


PARSERS = {
    "text": parse_text, "markdown": parse_markdown_or_lua_doc, "json": parse_json, "csv": parse_csv, "xml": parse_entity_xml,
    "java": parse_java, "lua": parse_lua, "config": parse_key_values,
}
