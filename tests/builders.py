"""Files built in code, so that their geometry and structure are in sight."""

import io
import struct
import zipfile
import zlib


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
    return out.getvalue()


def pdf(pages: list[list[tuple]], images: list[list[tuple]] | None = None, attachments: dict[str, bytes] | None = None, flate: bool = False) -> bytes:
    """pages: runs (text, x, y, size); images: boxes (x, y, w, h) of each page."""
    objects: list[bytes] = []

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(data: bytes, head: str = "") -> int:
        if flate:
            data, head = zlib.compress(data), head + " /Filter /FlateDecode"
        return add(f"<< /Length {len(data)}{head} >>\nstream\n".encode() + data + b"\nendstream")

    font = add(b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>")
    image = add(b"<< /Type /XObject /Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Length 1 >>\nstream\n0\nendstream")
    kids, tree = [], len(objects) + 1 + 2 * len(pages)
    for k, runs in enumerate(pages):
        content = "".join(f"BT /F1 {size} Tf {x} {y} Td ({t}) Tj ET\n" for t, x, y, size in runs)
        content += "".join(f"q {w} 0 0 {h} {x} {y} cm /Im Do Q\n" for x, y, w, h in (images or [[]] * len(pages))[k])
        c = stream(content.encode("cp1252"))
        kids.append(add(f"<< /Type /Page /Parent {tree} 0 R /MediaBox [0 0 612 792] /Contents {c} 0 R /Resources << /Font << /F1 {font} 0 R >> /XObject << /Im {image} 0 R >> >> >>".encode()))
    assert add(f"<< /Type /Pages /Count {len(kids)} /Kids [{' '.join(f'{k} 0 R' for k in kids)}] >>".encode()) == tree
    names = ""
    if attachments:
        specs = []
        for name, data in attachments.items():
            f = stream(data, " /Type /EmbeddedFile")
            specs.append(f"({name}) {add(f'<< /Type /Filespec /F ({name}) /EF << /F {f} 0 R >> >>'.encode())} 0 R")
        names = f" /Names << /EmbeddedFiles << /Names [{' '.join(specs)}] >> >>"
    root = add(f"<< /Type /Catalog /Pages {tree} 0 R{names} >>".encode())
    out = b"%PDF-1.4\n"
    for k, body in enumerate(objects, 1):
        out += f"{k} 0 obj\n".encode() + body + b"\nendobj\n"
    return out + f"trailer << /Root {root} 0 R /Size {len(objects) + 1} >>\n%%EOF".encode()


def mail(subject: str, body: str, filename: str, attachment: bytes) -> bytes:
    import base64

    return (
        f'From: a@example.com\r\nTo: b@example.com\r\nSubject: {subject}\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary="xx"\r\n\r\n--xx\r\nContent-Type: text/plain\r\n\r\n{body}\r\n'
        f'--xx\r\nContent-Type: application/octet-stream; name="{filename}"\r\nContent-Disposition: attachment; filename="{filename}"\r\nContent-Transfer-Encoding: base64\r\n\r\n{base64.b64encode(attachment).decode()}\r\n--xx--\r\n'
    ).encode()


def compound(tree: dict) -> bytes:
    """A compound file of streams (bytes) and storages (dict); all streams are padded past the mini-stream cutoff by the reader's own rules or kept in it."""
    sector, entries, fat, body = 512, [], [], []

    def chain(data: bytes) -> int:
        if not data:
            return 0xFFFFFFFE
        first = len(fat)
        n = -(-len(data) // sector)
        for k in range(n):
            fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
            body.append(data[k * sector : (k + 1) * sector].ljust(sector, b"\0"))
        return first

    mini, mini_fat = b"", []

    def small(data: bytes) -> int:
        nonlocal mini
        first, n = len(mini) // 64, -(-len(data) // 64)
        for k in range(n):
            mini_fat.append(first + k + 1 if k + 1 < n else 0xFFFFFFFE)
        mini += data.ljust(n * 64, b"\0")
        return first

    def entry(name: str, kind: int, start: int, size: int) -> int:
        entries.append([name, kind, 0xFFFFFFFF, 0xFFFFFFFF, 0xFFFFFFFF, start, size])
        return len(entries) - 1

    def fill(parent: int, items: dict) -> None:
        last = None
        for name, value in items.items():
            k = entry(name, 1, 0, 0) if isinstance(value, dict) else entry(name, 2, chain(value) if len(value) >= 4096 else small(value), len(value))
            if last is None:
                entries[parent][4] = k
            else:
                entries[last][3] = k
            last = k
            if isinstance(value, dict):
                fill(k, value)

    root = entry("Root Entry", 5, 0, 0)
    fill(root, tree)
    entries[root][5], entries[root][6] = chain(mini), len(mini)
    mini_start = chain(struct.pack(f"<{len(mini_fat)}I", *mini_fat).ljust(-(-len(mini_fat) * 4 // 512) * 512, b"\xff")) if mini_fat else 0xFFFFFFFE
    raw = b""
    for name, kind, left, right, child, start, size in entries:
        n = name.encode("utf-16-le") + b"\0\0"
        raw += n.ljust(64, b"\0") + struct.pack("<HBBIII", len(n), kind, 1, left, right, child) + bytes(36) + struct.pack("<IQ", start, size)
    directory = chain(raw.ljust(-(-len(raw) // 512) * 512, b"\0"))
    n_fat = -(-(len(fat) + 1) // 128)
    while n_fat * 128 < len(fat) + n_fat:
        n_fat += 1
    places = list(range(len(fat), len(fat) + n_fat))
    fat += [0xFFFFFFFD] * n_fat
    table = struct.pack(f"<{len(fat)}I", *fat).ljust(n_fat * 512, b"\xff")
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(6) + struct.pack("<IIIIIIIII", 0, n_fat, directory, 0, 4096, mini_start, 1 if mini_fat else 0, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *places, *[0xFFFFFFFF] * (109 - n_fat))
    return head + b"".join(body) + table


def ole10(name: str, payload: bytes) -> bytes:
    n = name.encode() + b"\0"
    rest = struct.pack("<H", 2) + n + n + bytes(8) + n + struct.pack("<I", len(payload)) + payload
    return struct.pack("<I", len(rest)) + rest


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body: str, more: dict[str, bytes] | None = None) -> bytes:
    return zipped({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>".encode()} | (more or {}))


def paragraph(text: str, style: str = "", number: bool = False) -> str:
    props = (f'<w:pStyle w:val="{style}"/>' if style else "") + ("<w:numPr/>" if number else "")
    return f"<w:p><w:pPr>{props}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"


def xlsx(sheets: dict[str, str], shared: list[str]) -> bytes:
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    names = "".join(f'<sheet name="{n}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
    rels = "".join(f'<Relationship Id="rId{k}" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
    parts = {"xl/workbook.xml": f"<workbook {r}><sheets>{names}</sheets></workbook>", "xl/_rels/workbook.xml.rels": f"<Relationships>{rels}</Relationships>", "xl/sharedStrings.xml": "<sst>" + "".join(f"<si><t>{s}</t></si>" for s in shared) + "</sst>"}
    parts |= {f"xl/worksheets/sheet{k}.xml": f"<worksheet><sheetData>{x}</sheetData></worksheet>" for k, x in enumerate(sheets.values(), 1)}
    return zipped({k: v.encode() for k, v in parts.items()})


def pptx(slides: dict[int, list[str]]) -> bytes:
    a = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
    return zipped({f"ppt/slides/slide{k}.xml": f"<sld {a}>{''.join(f'<a:p><a:r><a:t>{t}</a:t></a:r></a:p>' for t in ts)}</sld>".encode() for k, ts in slides.items()})
