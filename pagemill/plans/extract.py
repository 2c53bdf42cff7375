"""The recursive walk through containers: every file becomes the rows of its tree.

Depth, file and byte budgets are shared by a whole tree and spent depth first,
so one tree is walked within one task and trees are spread over tasks. Errors
are rows, not failures.
"""

from __future__ import annotations

import hashlib
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.formats import IMAGES, OFFICE, OOXML
from pagemill.session import ship, spread
from pagemill.sources import cfb, detect, mail, ooxml, pdf, zipped
from pagemill.sources.budget import Budget, Child, deadline
from pagemill.sources.pages import Tools, in_points, read_pages
from pagemill.sources.recognise import MOST_PIXELS, NoConverter, image_size

Reader = Callable[[bytes, Budget], Iterator[Child]]
READERS: dict[str, Reader] = {
    "zip": zipped.children, "pdf": pdf.children, "eml": mail.children, "msg": cfb.message_children, "ole": cfb.ole_children, "doc": cfb.ole_children, "xls": cfb.ole_children, "ppt": cfb.ole_children,
    **{k: lambda data, budget: zipped.children(data, budget, embedded_only=True) for k in ("docx", "xlsx", "pptx")},
}
NODE = "node int, parent int, depth int, name string, file_format string, text string, error string, sha256 string, size_bytes bigint"


@dataclass(frozen=True)
class Options:
    """Limits of a walk; None is without limit. texts false lists the tree only."""

    depth: int | None = 8
    files: int | None = 512
    bytes: int | None = 256 << 20
    texts: bool = True


def office_text(data: bytes, kind: str, name: str, tools: Tools) -> str:
    """An office file's text: read natively where that is asked for or nothing converts it, else by way of PDF."""
    if tools.native_office and kind in OOXML:
        return ooxml.text(data, kind)
    try:
        if tools.converter is None:
            raise NoConverter(f"nothing converts {kind} files")
        converted = tools.converter(data, name)
    except NoConverter:
        if kind in OOXML:
            return ooxml.text(data, kind)
        raise
    return pdf_text(converted, tools)


def pdf_text(data: bytes, tools: Tools = Tools()) -> str:
    """Words by lines as they come, recognised ones where a page has no other, pages by form feed."""
    return "\f".join(pdf.text_lines(page.words) for _, page in read_pages(data, tools=tools))


def read_text(data: bytes, kind: str, name: str = "", tools: Tools = Tools()) -> str | None:
    """The text of one file by its format; None where nothing reads it."""
    if kind == "txt":
        return data.decode("utf-8", "replace")
    if kind == "eml":
        return mail.text(data)
    if kind == "msg":
        return cfb.message_text(data)
    if kind in IMAGES and tools.recogniser is not None:
        width, height = image_size(data)
        if width <= 0 or height <= 0 or width * height > MOST_PIXELS:
            raise ValueError(f"image of {width} x {height} pixels is too large")
        return pdf.text_lines(in_points(tools.recogniser(data), 72, height))
    if kind in OOXML or (kind in OFFICE and tools.converter is not None):
        return office_text(data, kind, name, tools)
    return pdf_text(data, tools) if kind == "pdf" else None


def walk(name: str, data: bytes, options: Options = Options(), readers: dict[str, Reader | None] | None = None, tools: Tools = Tools()) -> list[dict]:
    """The nodes of one tree in pre-order. readers adds to, replaces or (None) switches off readers of a format; tools recognise and convert."""
    known = READERS | (readers or {})
    budget, seen, out = Budget(options.files, options.bytes), set(), []
    budget.take(len(data))

    def visit(child: Child, parent: int | None, depth: int) -> None:
        node = {"node": len(out), "parent": parent, "depth": depth, "name": child.name, "file_format": "", "text": None, "error": child.error, "sha256": None, "size_bytes": None}
        out.append(node)
        if child.data is None:
            return
        raw = child.data
        node |= {"size_bytes": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "file_format": detect.detect(raw, child.name)}
        if node["sha256"] in seen:
            node["error"] = "already extracted this file"
            return
        seen.add(node["sha256"])
        kind = node["file_format"]
        if options.texts:
            try:
                node["text"] = read_text(raw, kind, child.name, tools)
            except (ValueError, KeyError, OSError, zipfile.BadZipFile, SyntaxError, StopIteration, RecursionError, NotImplementedError, RuntimeError) as e:
                if isinstance(e, TimeoutError):
                    raise
                node["error"] = str(e) or type(e).__name__
        reader = known.get(kind)
        if reader is None or (options.depth is not None and depth >= options.depth):
            return
        if budget.spent():
            visit(Child(f"{child.name} (contents)", None, "budget exhausted"), node["node"], depth + 1)
            return
        try:
            # A whole level is taken before the walk descends.
            level = list(reader(raw, budget))
        except (ValueError, KeyError, OSError, zipfile.BadZipFile, SyntaxError, RecursionError, NotImplementedError, RuntimeError) as e:
            if isinstance(e, TimeoutError):
                raise
            node["error"] = node["error"] or str(e) or type(e).__name__
            return
        for c in level:
            visit(Child(f"{child.name} (contents)", None, c.error) if c.stop else c, node["node"], depth + 1)

    first = Child(name or "document", data)
    if options.bytes is not None and len(data) > options.bytes:
        first = Child(first.name, None, f"larger than the {options.bytes} bytes allowed")
    visit(first, None, 0)
    return out


def extract(files: DataFrame, key: str = "path", name: str = "name", content: str = "content", options: Options = Options(), readers: dict[str, Reader | None] | None = None, tools: Tools = Tools(), timeout: float | None = None) -> DataFrame:
    """(key, node, parent, depth, name, file_format, text, error, sha256, size_bytes) of every file (key, name, content). A file that takes longer than ``timeout`` seconds is one node with its error. Rows of null content give none."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["key", *(c.split()[0] for c in NODE.split(", "))]
        for b in batches:
            for k, n, data in zip(b["key"], b["name"], b["content"], strict=True):
                try:
                    with deadline(timeout):
                        nodes = walk(n or "", bytes(data), options, readers, tools)
                except TimeoutError as e:
                    nodes = [dict.fromkeys(columns[1:]) | {"node": 0, "depth": 0, "name": n or "document", "file_format": detect.detect(bytes(data), n or ""), "error": str(e), "size_bytes": len(data)}]
                frame = pd.DataFrame([{"key": k} | x for x in nodes], columns=columns)
                frame["parent"] = frame["parent"].astype("Int32")
                frame["size_bytes"] = frame["size_bytes"].astype("Int64")
                yield frame

    rows = files.where(f"{content} is not null").selectExpr(f"{key} as key", f"{name} as name", f"{content} as content")
    return spread(rows, "key").mapInPandas(trees, f"key {kind}, {NODE}").withColumnRenamed("key", key)


def node_json(nodes: DataFrame, key: str = "path") -> DataFrame:
    """(key, node, json): each node of a tree as a JSON object without its empty fields."""
    columns = [c.split()[0] for c in NODE.split(", ")]
    return nodes.select(key, "node", F.to_json(F.struct(*columns)).alias("json"))
