"""Recognition of images: header checks, backends, and the stage that runs them.

A backend takes the bytes of one image and gives words in pixels from the top
left: dicts of text, x0, y0, x1, y1, confidence. Backends call programs or
services outside this package; where they are missing, rows carry the error.
"""

from __future__ import annotations

import json
import os
import shutil
import struct
import subprocess
import tempfile
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.session import ship, spread

Backend = Callable[[bytes], list[dict]]
MOST_PIXELS = 100 << 20
WORD = "text string, x0 double, y0 double, x1 double, y1 double, confidence double, width int, height int, error string"


def image_size(data: bytes) -> tuple[int, int]:
    """Width and height from the header alone, so that a hostile size is refused before anything is decoded."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    if data[:4] == b"GIF8" and len(data) >= 10:
        return struct.unpack("<HH", data[6:10])
    if data[:2] == b"BM" and len(data) >= 26:
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            if 0xC0 <= data[at + 1] <= 0xCF and data[at + 1] not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", data[at + 5 : at + 9])
                return w, h
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        kind = data[12:16]
        if kind == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1
        if kind == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if data[:4] in (b"II*\0", b"MM\0*"):
        order = "<" if data[:1] == b"I" else ">"
        at = struct.unpack(order + "I", data[4:8])[0]
        count = struct.unpack(order + "H", data[at : at + 2])[0]
        tags = {}
        for k in range(min(count, 512)):
            entry = data[at + 2 + 12 * k : at + 14 + 12 * k]
            tag, kind = struct.unpack(order + "HH", entry[:4])
            tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), entry[8:10] if kind == 3 else entry[8:12])[0]
        if 256 in tags and 257 in tags:
            return tags[256], tags[257]
    raise ValueError("unknown image header")


def tesseract(language: str = "eng", mode: int = 3, timeout: float = 60, binary: str = "tesseract") -> Backend:
    def run(image: bytes) -> list[dict]:
        if not shutil.which(binary):
            raise ValueError(f"{binary} is not installed")
        out = subprocess.run([binary, "stdin", "stdout", "-l", language, "--psm", str(mode), "tsv"], input=image, capture_output=True, timeout=timeout, check=True).stdout.decode("utf-8", "replace")
        return tsv_words(out)

    return run


def tsv_words(tsv: str, least: float = 0.0) -> list[dict]:
    words = []
    for r in (line.split("\t") for line in tsv.splitlines()[1:]):
        if len(r) < 12 or r[0] != "5" or not r[11].strip() or float(r[10]) < least:
            continue
        x, y, w, h = map(float, r[6:10])
        words.append({"text": r[11].strip(), "x0": x, "y0": y, "x1": x + w, "y1": y + h, "confidence": min(1.0, max(0.01, float(r[10]) / 100))})
    return words


def http(url: str, language: str = "en", timeout: float = 60, plain: bool = False, headers: dict[str, str] | None = None) -> Backend:
    """A service that takes a form with the fields ``file`` and ``language``, or, ``plain``, the PNG itself; either form of answer is read."""

    def ask(image: bytes) -> list[dict]:
        kind, body = "image/png", image
        if not plain:
            mark = uuid.uuid4().hex
            parts = [b'Content-Disposition: form-data; name="file"; filename="page.png"\r\nContent-Type: image/png\r\n\r\n' + image, b'Content-Disposition: form-data; name="language"\r\n\r\n' + language.encode()]
            kind, body = f"multipart/form-data; boundary={mark}", b"".join(b"--" + mark.encode() + b"\r\n" + p + b"\r\n" for p in parts) + b"--" + mark.encode() + b"--\r\n"
        with urllib.request.urlopen(urllib.request.Request(url, body, {"Content-Type": kind} | (headers or {})), timeout=timeout) as answer:
            return answer_words(json.load(answer))

    return ask


def answer_words(answer: dict) -> list[dict]:
    """Words of a service's answer, with a box, a polygon or plain corners."""
    words = []
    for r in [*answer.get("results", []), *answer.get("words", [])]:
        points = [p for p in r.get("polygon") or [] if len(p) >= 2]
        box = r.get("bbox") or ([min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)] if points else [r.get(k) for k in ("x0", "y0", "x1", "y1")])
        if (r.get("text") or "").strip() and len(box) >= 4 and None not in box[:4]:
            a, b, c, d = map(float, box[:4])
            words.append({"text": r["text"], "x0": min(a, c), "y0": min(b, d), "x1": max(a, c), "y1": max(b, d), "confidence": float(r.get("confidence") or 0.0)})
    return words


def recognise(images: DataFrame, backend: Backend, key: str = "path", content: str = "content") -> DataFrame:
    """Words of every image in pixels from the bottom left; an image that cannot be read gives one row with its error, one without words none."""
    ship(images.sparkSession)
    kind = dict(images.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["key"], b["content"], strict=True):
                try:
                    width, height = image_size(bytes(data))
                    if width <= 0 or height <= 0 or width * height > MOST_PIXELS:
                        raise ValueError(f"image of {width} x {height} pixels is too large")
                    out = [(k, w["text"], w["x0"], height - w["y1"], w["x1"], height - w["y0"], w["confidence"], width, height, None) for w in backend(bytes(data))]
                except Exception as e:
                    out = [(k, *[None] * 8, str(e) or type(e).__name__)]
                yield pd.DataFrame(out, columns=["key", *(c.split()[0] for c in WORD.split(", "))]).astype({"width": "Int32", "height": "Int32"})

    rows = images.where(f"{content} is not null").selectExpr(f"{key} as key", f"{content} as content")
    return spread(rows, "key").mapInPandas(read, f"key {kind}, {WORD}").withColumnRenamed("key", key)


class NoConverter(ValueError):
    """There is no program to convert office files."""


def office_to_pdf(data: bytes, name: str, timeout: float = 120) -> bytes:
    """An office file as PDF by LibreOffice, in a profile of its own in the worker's scratch folder."""
    binary = os.environ.get("LIBREOFFICE") or shutil.which("soffice") or shutil.which("libreoffice")
    if not binary:
        raise NoConverter("LibreOffice is not installed")
    with tempfile.TemporaryDirectory() as folder:
        source = Path(folder, Path(name).name or "document")
        source.write_bytes(data)
        subprocess.run([binary, f"-env:UserInstallation=file://{folder}/profile", "--headless", "--convert-to", "pdf", "--outdir", folder, str(source)], capture_output=True, timeout=timeout, check=True)
        return source.with_suffix(".pdf").read_bytes()
