"""Word documents, e-books and archives, by the standard library; PDF and media by optional libraries where they are."""

from __future__ import annotations

import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile

from .files import decode_bytes
from .parsers import Record, record

#: Members of these kinds are read as text; each gives at most MEMBER_CHARS characters, all of them where that is None.
TEXT_MEMBERS = {"txt", "lua", "xml", "json", "md", "ini", "cfg", "csv", "java", "info", "properties"}
MEMBER_CHARS: int | None = 10_000
#: What an archive may unpack to.
MEMBER_BYTES = 64 * 1024 * 1024
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _open(data: bytes) -> zipfile.ZipFile:
    return zipfile.ZipFile(io.BytesIO(data))


def _read(z: zipfile.ZipFile, name: str) -> bytes:
    with z.open(name) as f:
        data = f.read(MEMBER_BYTES + 1)
    if len(data) > MEMBER_BYTES:
        raise ValueError(f"{name} is too large")
    return data


def parse_docx(data: bytes) -> list[Record]:
    """All paragraphs and tables, in order; cells of a row are joined by `` | ``."""
    with _open(data) as z:
        body = ET.fromstring(_read(z, "word/document.xml")).find(f"{WORD}body")
    run = lambda e: "".join(t.text or "" for t in e.iter(f"{WORD}t"))
    parts, tables = [], 0
    for e in body if body is not None else []:
        if e.tag == f"{WORD}p" and run(e).strip():
            parts.append(run(e).strip())
        elif e.tag == f"{WORD}tbl":
            tables += 1
            parts += [" | ".join(run(c).strip() for c in row.iter(f"{WORD}tc")) for row in e.iter(f"{WORD}tr")]
    return [record("", "docx", "\n\n".join(parts), tables=tables or None)] if parts else []


def parse_epub(data: bytes) -> list[Record]:
    """A record per chapter in reading order, with the book's title, creator and language. Chapters and their names are
    markup still."""
    with _open(data) as z:
        container = ET.fromstring(_read(z, "META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
        package = ET.fromstring(_read(z, opf))
        meta = {e.tag.rpartition("}")[2]: (e.text or "").strip() for e in package.iter() if e.tag.startswith("{http://purl.org/dc/elements/1.1/}")}
        places = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
        out = []
        for ref in (e.attrib["idref"] for e in package.iter() if e.tag.endswith("}itemref")):
            page = decode_bytes(_read(z, posixpath.normpath(posixpath.join(posixpath.dirname(opf), places[ref]))))
            title = re.search(r"(?is)<(?:h1|title)[^>]*>(.*?)</", page)
            out.append(record(title[1] if title else ref, "chapter", page, title=meta.get("title"), creator=meta.get("creator"), language=meta.get("language")) | {"markup": True})
    return out


def parse_archive(data: bytes, chars: int | None = MEMBER_CHARS) -> list[Record]:
    """A record per text member, cut at ``chars`` if given; all go to scripts if over half of them are Lua."""
    out = []
    with _open(data) as z:
        for name in sorted(z.namelist()):
            ext = name.rpartition(".")[2].lower()
            if name.endswith("/") or ext not in TEXT_MEMBERS:
                continue
            text = decode_bytes(_read(z, name))
            if text.strip():
                out.append(record(name, "member", text[:chars], member=name, extension=ext, cut=chars is not None and len(text) > chars))
    lua = sum(r["metadata"]["extension"] == "lua" for r in out)
    for r in out:
        r["metadata"]["collection"] = "scripts" if lua > len(out) // 2 else "guides"
    return out


def parse_pdf(data: bytes) -> list[Record]:
    """A record per page; needs pypdf. Pages of under 20 characters are marked for OCR."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs pypdf") from e
    reader = PdfReader(io.BytesIO(data))
    if reader.is_encrypted:
        raise ValueError("the PDF is locked")
    texts = [p.extract_text() or "" for p in reader.pages]
    return [record(f"page {i + 1}", "page", t, page=i + 1, needs_ocr=len(t.strip()) < 20) for i, t in enumerate(texts)]


CONTAINERS = {"docx": parse_docx, "epub": parse_epub, "archive": parse_archive, "pdf": parse_pdf}
