"""Formats of bytes in Python, for the walk inside one container (functions.formats has the same rules for columns, but for ZIP directories)."""

from __future__ import annotations

import io
import re
import zipfile

from pagemill.functions.formats import BY_NAME, MAGIC, MAIL_HEADERS

HEADER = re.compile(rb"[A-Za-z0-9-]+:")


def by_name(name: str) -> str:
    m = re.search(r"\.([^./\\]+)$", name or "")
    return BY_NAME.get(m[1].lower(), "") if m else ""


def is_mail(data: bytes) -> bool:
    head = data[:4096]
    if head.startswith(b"From "):
        return HEADER.match(head.partition(b"\n")[2]) is not None
    if b"MIME-Version:" in head or b"Content-Type:" in head:
        return HEADER.match(head) is not None
    return sum(h.encode() in head for h in MAIL_HEADERS) >= 2 and HEADER.match(head) is not None


def is_text(data: bytes) -> bool:
    head = data[:512]
    if not head or b"\0" in head:
        return False
    for cut in range(min(4, len(head) + 1)):
        try:
            head[: len(head) - cut].decode()
            return True
        except UnicodeDecodeError:
            pass
    return False


def zip_kind(data: bytes) -> str:
    """By the first entry, in directory order, that tells; 'zip' where none does or the directory is broken."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for entry in z.infolist():
                for folder, kind in (("word/", "docx"), ("xl/", "xlsx"), ("ppt/", "pptx")):
                    if entry.filename.startswith(folder):
                        return kind
                if entry.filename == "mimetype":
                    with z.open(entry) as f:
                        kind = f.read(128).decode("ascii", "replace")
                    for suffix, found in (("text", "odt"), ("spreadsheet", "ods"), ("presentation", "odp")):
                        if "opendocument." + suffix in kind:
                            return found
    except (zipfile.BadZipFile, OSError, NotImplementedError, RuntimeError, ValueError, EOFError):
        pass
    return "zip"


def sniff(data: bytes) -> str:
    if not data:
        return ""
    for magic, kind in MAGIC:
        if data.startswith(bytes.fromhex(magic)):
            return zip_kind(data) if kind == "zip" else kind
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if len(data) >= 26 and data[:2] == b"BM" and data[6:10] == bytes(4) and 26 <= int.from_bytes(data[10:14], "little") <= 1 << 20 and int.from_bytes(data[14:18], "little") in (12, 16, 40, 52, 56, 64, 108, 124):
        return "bmp"
    if b"%PDF-" in data[:1024]:
        return "pdf"
    return "eml" if is_mail(data) else "txt" if is_text(data) else ""


def detect(data: bytes, name: str) -> str:
    seen, named = sniff(data), by_name(name)
    if (seen == "ole" and named in ("doc", "xls", "ppt", "msg")) or (seen == "txt" and named):
        return named
    return seen or named
