"""Blocks of Word, Excel and PowerPoint packages, without geometry."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET

PART = 128 << 20
CELLS, FLOOR, DIVISOR, COLUMNS = 1 << 20, 4096, 8, 16384


def _local(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attribute(e: ET.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)


def _part(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    entry = next((e for e in z.infolist() if e.filename.lower() == name.lower()), None)
    if entry is None:
        return None
    with z.open(entry) as f:
        raw = f.read(PART + 1)
    if len(raw) > PART:
        raise ValueError(f"{name} is too large")
    return ET.fromstring(raw)


def blocks(data: bytes, kind: str) -> list[dict]:
    """kind, text, level, ordered, marker, header, rows of each block."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {"docx": _document, "xlsx": _workbook, "pptx": _slides}[kind](z)


def _block(kind: str, text: str = "", **more) -> dict:
    return {"kind": kind, "text": text, "level": None, "ordered": None, "marker": None, "header": None, "rows": None} | more


def heading_level(style: str) -> int | None:
    s = style.replace(" ", "").lower()
    m = re.fullmatch(r"heading(\d+)", s)
    return 1 if s == "title" else min(int(m[1]) + 1, 6) if m else None


def _text(e: ET.Element) -> str:
    out = []
    for x in e.iter():
        name = _local(x)
        if name == "t":
            out.append(x.text or "")
        elif name == "tab":
            out.append("\t")
        elif name in ("br", "cr"):
            out.append("\n")
    return "".join(out)


def _paragraph(p: ET.Element) -> dict | None:
    text, style, numbered = _text(p).strip(), "", False
    for x in p.iter():
        if _local(x) == "pStyle":
            style = _attribute(x, "val") or ""
        elif _local(x) == "numPr":
            numbered = True
    if not text:
        return None
    if level := heading_level(style):
        return _block("heading", text, level=level)
    return _block("list_item", text, ordered=False, marker="-") if numbered or style.lower().startswith("list") else _block("paragraph", text)


def _cell(c: ET.Element) -> str:
    out = []
    for x in c:
        if _local(x) == "p":
            out.append(_text(x))
        elif _local(x) == "tbl":
            out += ["\t".join(_cell(d) for d in r if _local(d) == "tc") for r in x if _local(r) == "tr"]
    return "\n".join(x for x in out if x)


def _table(rows: list[list[str]], first_is_header: bool) -> dict:
    head = first_is_header and len(rows) > 1
    return _block("table", header=rows[0] if head else None, rows=rows[1:] if head else rows)


def _document(z: zipfile.ZipFile) -> list[dict]:
    root = _part(z, "word/document.xml")
    if root is None:
        raise ValueError("no word/document.xml")
    body, out = next((x for x in root if _local(x) == "body"), root), []
    for x in body:
        if _local(x) == "p" and (b := _paragraph(x)):
            out.append(b)
        elif _local(x) == "tbl":
            rows = [[_cell(c) for c in r if _local(c) == "tc"] for r in x if _local(r) == "tr"]
            if rows := [r for r in rows if r]:
                out.append(_table(rows, all(c.strip() for c in rows[0])))
    return out


def column(reference: str) -> int:
    m = re.match(r"([A-Za-z]{1,3})(?![A-Za-z])", reference or "")
    n = 0
    for c in m[1].upper() if m else "":
        n = n * 26 + ord(c) - 64
    return n - 1 if 0 < n <= COLUMNS else -1


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, name = posixpath.split(part)
    root = _part(z, f"{folder}/_rels/{name}.rels")
    return {} if root is None else {_attribute(r, "Id"): (t.lstrip("/") if (t := _attribute(r, "Target") or "").startswith("/") else posixpath.normpath(posixpath.join(folder, t))) for r in root}


def grid(rows: list[dict[int, str]]) -> list[list[str]]:
    """Rows of stored cells as a dense table; sparse ones by their used columns, too large ones as they are."""
    if not rows:
        return []
    width, filled = max(max(r) for r in rows) + 1, sum(map(len, rows))
    columns: list[int] = list(range(width)) if width * len(rows) <= CELLS else []
    if width * len(rows) > CELLS or (width * len(rows) > FLOOR and filled * DIVISOR < width * len(rows)):
        columns = sorted({c for r in rows for c in r})
        if len(columns) * len(rows) > CELLS:
            return [[r[c] for c in sorted(r)] for r in rows]
    return [[r.get(c, "") for c in columns] for r in rows]


def _workbook(z: zipfile.ZipFile) -> list[dict]:
    book = _part(z, "xl/workbook.xml")
    if book is None:
        raise ValueError("no xl/workbook.xml")
    shared = [] if (s := _part(z, "xl/sharedStrings.xml")) is None else ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in s if _local(si) == "si"]
    places, out = _relations(z, "xl/workbook.xml"), []
    for sheet in (x for x in book.iter() if _local(x) == "sheet"):
        root = _part(z, places.get(next((v for k, v in sheet.attrib.items() if k.endswith("}id")), ""), ""))
        if root is None:
            continue
        rows = []
        for r in (x for x in root.iter() if _local(x) == "row"):
            cells: dict[int, str] = {}
            following = 0
            for c in (x for x in r if _local(x) == "c"):
                at = column(_attribute(c, "r") or "") if _attribute(c, "r") else following
                if at < 0:
                    continue
                following = at + 1
                value = "".join(x.text or "" for x in c.iter() if _local(x) in ("v", "t"))
                if _attribute(c, "t") == "s" and value.isdigit():
                    value = shared[int(value)] if int(value) < len(shared) else value
                if value:
                    cells[at] = value
            if cells:
                rows.append(cells)
        if rows:
            table = grid(rows)
            out += [_block("heading", _attribute(sheet, "name") or "", level=2), _table(table, sum(bool(c.strip()) for c in table[0]) * 2 >= len(table[0]))]
    return out


def _slides(z: zipfile.ZipFile) -> list[dict]:
    show, names = _part(z, "ppt/presentation.xml"), []
    if show is not None:
        places = _relations(z, "ppt/presentation.xml")
        names = [places[i] for x in show.iter() if _local(x) == "sldId" and (i := next((v for k, v in x.attrib.items() if k.endswith("}id")), "")) in places]
    if not names:
        found = [(int(m[1]), e.filename) for e in z.infolist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", e.filename))]
        names = [n for _, n in sorted(found)]
    out = []
    for name in names:
        root = _part(z, name)
        texts = [] if root is None else [t for p in root.iter() if _local(p) == "p" and (t := _text(p).strip())]
        out += [_block("heading", t, level=2) if k == 0 else _block("paragraph", t) for k, t in enumerate(texts)]
    return out


def text(data: bytes, kind: str) -> str:
    """Blocks by lines; cells of a row by tabs, trailing blank ones cut."""
    lines = []
    for b in blocks(data, kind):
        if b["kind"] == "table":
            lines += ["\t".join(r).rstrip("\t") for r in ([b["header"]] if b["header"] else []) + b["rows"]]
        else:
            lines.append(b["text"])
    return "\n".join(lines)
