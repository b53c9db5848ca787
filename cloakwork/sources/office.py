"""Spreadsheets and text documents as zip archives of XML, read and written with the standard library.

Files are the unit of work: a task reads whole files, each of which is bounded by what an office
program opens. Spark lists and distributes them.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

#: Namespaces of the formats.
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
TABLE = "{urn:oasis:names:tc:opendocument:xmlns:table:1.0}"
#: A row or cell that a spreadsheet repeats more often than this is padding to the sheet's edge.
MOST_REPEATS = 10_000


def _xml(archive: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(name)) if name in archive.namelist() else None


def _records(rows: list[list[str]]) -> Iterator[dict[str, str]]:
    """Rows as records: the first one names the columns, blank names become col_i."""
    if not rows:
        return
    names = [h or f"col_{i}" for i, h in enumerate(rows[0])]
    for row in rows[1:]:
        yield {n: row[i] if i < len(row) else "" for i, n in enumerate(names)}


def read_xlsx(data: bytes) -> list[dict[str, str]]:
    """The active sheet; every cell is text, an empty one ''."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _xml(z, "xl/workbook.xml")
        links = {r.get("Id"): r.get("Target") for r in _xml(z, "xl/_rels/workbook.xml.rels")}
        view = book.find(f".//{SHEET}workbookView")
        sheets = book.findall(f".//{SHEET}sheet")
        target = links[sheets[int(view.get("activeTab", 0)) if view is not None else 0].get(f"{REL}id")]
        shared = _xml(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in shared.findall(f"{SHEET}si")] if shared is not None else []
        sheet = _xml(z, target.lstrip("/") if target.startswith("/") else f"xl/{target}")
    rows = []
    for row in sheet.iter(f"{SHEET}row"):
        cells: dict[int, str] = {}
        for k, c in enumerate(row.findall(f"{SHEET}c")):
            letters = re.match("[A-Z]*", c.get("r", ""))[0]
            at = sum((ord(x) - 64) * 26**i for i, x in enumerate(reversed(letters))) - 1 if letters else k
            value = c.find(f"{SHEET}v")
            if c.get("t") == "inlineStr":
                cells[at] = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
            elif value is not None and value.text is not None:
                cells[at] = strings[int(value.text)] if c.get("t") == "s" else value.text
        rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
    return list(_records(rows))


def read_ods(data: bytes) -> list[dict[str, str]]:
    """The first table; a cell is the text of its first paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        table = _xml(z, "content.xml").find(f".//{TABLE}table")
    rows = []
    for row in table.iter(f"{TABLE}table-row"):
        cells: list[str] = []
        for c in row:
            p = c.find(f"{TEXT}p")
            times = int(c.get(f"{TABLE}number-columns-repeated", 1))
            cells += ["".join(p.itertext()) if p is not None else ""] * (times if p is not None or times < MOST_REPEATS else 0)
        while cells and not cells[-1]:
            cells.pop()
        times = int(row.get(f"{TABLE}number-rows-repeated", 1))
        rows += [cells] * (times if cells else 0)
    return list(_records(rows))


def _document(paragraphs: Iterator[str]) -> str:
    return "\n".join(p for p in paragraphs if p.strip())


def read_docx(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _xml(z, "word/document.xml").find(f"{WORD}body")
    return _document("".join(t.text or "" for t in p.iter(f"{WORD}t")) for p in body.findall(f"{WORD}p"))


def read_odt(data: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return _document("".join(p.itertext()) for p in _xml(z, "content.xml").iter(f"{TEXT}p"))


def _archive(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _ooxml(main: str, kind: str, parts: dict[str, str]) -> bytes:
    types = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in _TYPES.items() if n in parts)
    return _archive(
        {
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
            "_rels/.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/{kind}" Target="{main}"/></Relationships>',
        }
        | parts
    )


_TYPES = {
    "xl/workbook.xml": "spreadsheetml.sheet.main",
    "xl/worksheets/sheet1.xml": "spreadsheetml.worksheet",
    "word/document.xml": "wordprocessingml.document.main",
}


def write_xlsx(rows: list[dict]) -> bytes:
    names = list(rows[0]) if rows else []
    lines = [names, *([r.get(n) for n in names] for r in rows)]

    def cell(v) -> str:
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'

    sheet = "".join(f"<row>{''.join(map(cell, line))}</row>" for line in lines)
    ns = SHEET.strip("{}")
    return _ooxml(
        "xl/workbook.xml",
        "officeDocument",
        {
            "xl/workbook.xml": f'{_HEAD}<workbook xmlns="{ns}" xmlns:r="{_OFFICE}"><sheets><sheet name="Feuille1" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'{_HEAD}<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>',
        },
    )


def write_docx(text: str) -> bytes:
    lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' for x in text.split("\n") if x.strip())
    return _ooxml("word/document.xml", "officeDocument", {"word/document.xml": f'{_HEAD}<w:document xmlns:w="{WORD.strip("{}")}"><w:body>{lines}</w:body></w:document>'})


def _opendocument(kind: str, body: str) -> bytes:
    media = f"application/vnd.oasis.opendocument.{kind}"
    ns = " ".join(f'xmlns:{k}="urn:oasis:names:tc:opendocument:xmlns:{k}:1.0"' for k in ("office", "text", "table"))
    manifest = "urn:oasis:names:tc:opendocument:xmlns:manifest:1.0"
    return _archive(
        {
            "mimetype": media,
            "META-INF/manifest.xml": f'{_HEAD}<m:manifest xmlns:m="{manifest}" m:version="1.2"><m:file-entry m:full-path="/" m:media-type="{media}"/><m:file-entry m:full-path="content.xml" m:media-type="text/xml"/></m:manifest>',
            "content.xml": f'{_HEAD}<office:document-content {ns} office:version="1.2"><office:body>{body}</office:body></office:document-content>',
        }
    )


def write_odt(text: str) -> bytes:
    lines = "".join(f"<text:p>{escape(x)}</text:p>" for x in text.split("\n") if x.strip())
    return _opendocument("text", f"<office:text>{lines}</office:text>")


def write_ods(rows: list[dict]) -> bytes:
    names = list(rows[0]) if rows else []
    lines = [names, *([r.get(n) for n in names] for r in rows)]
    cells = "".join(
        "<table:table-row>" + "".join(f'<table:table-cell office:value-type="string"><text:p>{escape("" if v is None else str(v))}</text:p></table:table-cell>' for v in line) + "</table:table-row>" for line in lines
    )
    return _opendocument("spreadsheet", f'<office:spreadsheet><table:table table:name="Feuille1">{cells}</table:table></office:spreadsheet>')
