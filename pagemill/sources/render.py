"""Pages as PNG, by a program outside this package."""

from __future__ import annotations

import shutil
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.session import ship, spread
from pagemill.sources import pdf
from pagemill.sources.budget import deadline
from pagemill.sources.pages import pages_selected

#: (file, page from 0, dots an inch, box as left, top, right, bottom in pixels or None for the page) to PNG.
Renderer = Callable[[bytes, int, float, tuple[int, int, int, int] | None], bytes]
#: Dots an inch: what is rendered, and what recognition sees.
DPI, OCR_DPI = 150.0, 200.0


def poppler(binary: str = "pdftoppm", timeout: float = 60) -> Renderer:
    def render(data: bytes, page: int, dpi: float, box: tuple[int, int, int, int] | None = None) -> bytes:
        if not shutil.which(binary):
            raise ValueError(f"{binary} is not installed")
        with tempfile.NamedTemporaryFile(suffix=".pdf") as f:  # the worker's scratch, for this call alone
            f.write(data)
            f.flush()
            part = ["-x", str(box[0]), "-y", str(box[1]), "-W", str(box[2] - box[0]), "-H", str(box[3] - box[1])] if box else []
            return subprocess.run([binary, "-png", "-r", str(dpi), "-f", str(page + 1), "-l", str(page + 1), *part, str(Path(f.name))], capture_output=True, timeout=timeout, check=True).stdout

    return render


def rendered_pages(files: DataFrame, renderer: Renderer, key: str = "path", content: str = "content", pages: str = "", max_pages: int | None = None, dpi: float = DPI, timeout: float | None = None) -> DataFrame:
    """(key, page, png, error): a row for each selected page of PDF files; a file that cannot be read has one row with its error, a null content none."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["key"], b["content"], strict=True):
                raw = bytes(data)
                try:
                    with deadline(timeout):
                        for p in pages_selected(pages, len(pdf.File(raw).pages()), max_pages):
                            yield pd.DataFrame({"key": [k], "page": [p], "png": [renderer(raw, p, dpi, None)], "error": [None]})
                except Exception as e:  # a broken file is a row with its error
                    yield pd.DataFrame({"key": [k], "page": pd.array([None], "Int32"), "png": [None], "error": [str(e) or type(e).__name__]})

    rows = files.where(f"{content} is not null").selectExpr(f"{key} as key", f"{content} as content")
    return spread(rows, "key").mapInPandas(run, f"key {kind}, page int, png binary, error string").withColumnRenamed("key", key)
