"""E-mail: the readable text, and the attachments of its MIME tree."""

from __future__ import annotations

import base64
import binascii
import quopri
import re
from collections.abc import Iterator
from email.header import decode_header

from pagemill.sources.budget import Budget, Child

PARTS = 256
SHOWN = ("Date", "From", "To", "Cc", "Subject")


def headers(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers by lower-case name, the first of each, unfolded; and what follows the blank line."""
    if data.startswith(b"From "):
        data = data.partition(b"\n")[2]
    m = re.search(rb"\r?\n\r?\n", data)
    head, body = (data[: m.start()], data[m.end() :]) if m else (data, b"")
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head.removeprefix(b"\xef\xbb\xbf")).splitlines():
        name, colon, value = line.partition(b":")
        if colon and re.fullmatch(rb"[A-Za-z0-9-]+", name):
            out.setdefault(name.decode().lower(), value.strip().decode("utf-8", "replace"))
    return out, body


def words(value: str) -> str:
    """A header's encoded words as text."""
    try:
        return "".join(part.decode(charset or "ascii", "replace") if isinstance(part, bytes) else part for part, charset in decode_header(value))
    except (LookupError, ValueError, binascii.Error):
        return value


def media(value: str) -> tuple[str, dict[str, str]]:
    kind, *rest = re.split(r";(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)", value or "text/plain")
    fields = {}
    for r in rest:
        k, eq, v = r.partition("=")
        if eq:
            fields[k.strip().lower()] = v.strip().strip('"')
    return kind.strip().lower(), fields


def transfer(body: bytes, encoding: str) -> bytes:
    encoding = encoding.strip().lower()
    if encoding == "base64":
        packed = b"".join(body.split())
        try:
            return base64.b64decode(packed, validate=True)
        except (binascii.Error, ValueError):
            return body
    return quopri.decodestring(body) if encoding == "quoted-printable" else body


def _parts(body: bytes, boundary: str) -> list[bytes]:
    marks = list(re.finditer(rb"(?m)^--" + re.escape(boundary.encode()) + rb"(--)?[ \t]*\r?$", body))
    out = []
    for a, b in zip(marks, [*marks[1:], None], strict=True):
        if a[1] or len(out) == PARTS:
            break
        piece = body[a.end() : b.start() if b else len(body)].removeprefix(b"\n")
        out.append(piece[:-2] if piece.endswith(b"\r\n") else piece.removesuffix(b"\n"))
    return out


def walk(data: bytes) -> tuple[str | None, list[tuple[str, bytes]]]:
    """The text of a message or part, and its attachments (name, bytes)."""
    head, body = headers(data)
    kind, fields = media(head.get("content-type", ""))
    disposition, extra = media(head.get("content-disposition", "")) if "content-disposition" in head else ("", {})
    name = words(extra.get("filename") or fields.get("name") or "")
    if kind.startswith("multipart/") and "boundary" in fields:
        text, attached, plain = None, [], False
        texts = []
        for part in _parts(body, fields["boundary"]):
            t, more = walk(part)
            attached += more
            if t is None:
                continue
            is_plain = media(headers(part)[0].get("content-type", ""))[0] == "text/plain"
            if kind == "multipart/alternative":
                if text is None or (is_plain and not plain):
                    text, plain = t, is_plain
            else:
                texts.append(t)
        return (text if kind == "multipart/alternative" else "\n".join(texts) if texts else None), attached
    content = transfer(body, head.get("content-transfer-encoding", ""))
    if disposition == "attachment" or name or kind not in ("text/plain", "text/html"):
        return None, [(re.split(r"[/\\]", name)[-1] or "part", content)]
    text = content.decode("utf-8", "replace")
    return (strip_html(text) if kind == "text/html" else text), []


def strip_html(text: str) -> str:
    text = re.sub(r"(?i)<(?:br|/p|/div|/tr)[^<>]*>?", ">\n", text)
    text = re.sub(r"<[^<>]*>?", "", text).replace(">", "")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = text.replace(entity, c)
    return "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)


def text(data: bytes) -> str:
    head, _ = headers(data)
    shown = "".join(f"{k}: {words(head[k.lower()])}\n" for k in SHOWN if head.get(k.lower()))
    return f"{shown}\n{walk(data)[0] or ''}"


def children(data: bytes, budget: Budget) -> Iterator[Child]:
    yield from budget.admit((name, lambda limit, content=content: content) for name, content in walk(data)[1])
