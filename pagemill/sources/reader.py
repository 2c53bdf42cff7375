"""Files to rows: binary files, the words and images of PDF pages, the blocks of Office packages."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.formats import detect_format
from pagemill.functions.text import base_name
from pagemill.session import ship, spread
from pagemill.sources import detect, ooxml
from pagemill.sources.budget import deadline
from pagemill.sources.pages import Tools, pages_selected, read_pages  # noqa: F401 - the choice of pages is part of what readers offer

BLOCK = "block_no int, kind string, text string, level int, ordered boolean, marker string, header array<string>, rows array<array<string>>, error string"


def binary_files(spark: SparkSession, folder: str, glob: str | None = None) -> DataFrame:
    """(path, name, content, length, modified, file_format) of all files below a folder; content is only read where it is asked for."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(folder)
    found = rows.select("path", base_name("path").alias("name"), "content", "length", F.col("modificationTime").alias("modified"), detect_format("content", base_name("path")).alias("file_format"))
    ship(spark)
    # Only the directory of a ZIP file tells what package it is, so those alone go through Python.
    package = F.pandas_udf(lambda s: s.map(lambda x: detect.zip_kind(bytes(x)) if x is not None else None), "string")
    return found.withColumn("file_format", F.coalesce(package(F.when(F.col("file_format") == "zip", F.col("content"))), "file_format"))


LAYOUT = "page int, width double, height double, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,confidence:double>>, images array<struct<index:int,x0:double,y0:double,x1:double,y1:double>>, error string"
WORDS = ("text", "x0", "y0", "x1", "y1", "font_size", "confidence")


def pdf_layout(files: DataFrame, key: str = "path", content: str = "content", pages: str = "", max_pages: int | None = None, password: str = "", tools: Tools | None = None, timeout: float | None = None, granularity: str = "word") -> DataFrame:
    """A row for each selected page, from one reading of its file: its size, words and images, those within forms too; an unreadable file, and one that takes longer than ``timeout`` seconds, has one row with its error, a null content none.

    With ``tools``, pages without words are rendered and recognised, and pictures on other pages where it says so.
    """
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["key"], b["content"], strict=True):
                try:
                    raw = bytes(data)
                    if detect.sniff(raw) not in ("pdf", ""):
                        raise ValueError("not a PDF document")
                    with deadline(timeout):
                        out = [
                            (k, p, got.width, got.height, [{c: w[c] for c in WORDS} for w in got.words], [dict(zip(("index", "x0", "y0", "x1", "y1"), (i, *map(float, box)), strict=True)) for i, box in enumerate(got.images)], None)
                            for p, got in read_pages(raw, pages, max_pages, password, tools, granularity)
                        ]
                except Exception as e:  # a broken file is a row with its error
                    out = [(k, None, None, None, None, None, str(e) or type(e).__name__)]
                yield pd.DataFrame(out, columns=["key", "page", "width", "height", "words", "images", "error"]).astype({"page": "Int32"})

    rows = files.where(f"{content} is not null").selectExpr(f"{key} as key", f"{content} as content")
    return spread(rows, "key").mapInPandas(read, f"key {kind}, {LAYOUT}").withColumnRenamed("key", key)


def words_of_pages(layout: DataFrame, key: str = "path") -> DataFrame:
    """A row for each word of pages of pdf_layout; a page without words has one row of null text, a broken file one with its error."""
    return layout.select(key, "page", "width", "height", "error", F.posexplode_outer("words").alias("seq", "w")).select(key, "page", "seq", *(F.col(f"w.{c}").alias(c) for c in WORDS), "width", "height", "error")


def pdf_words(files: DataFrame, key: str = "path", content: str = "content", **options) -> DataFrame:
    """words_of_pages(pdf_layout(...)); options are those of pdf_layout."""
    return words_of_pages(pdf_layout(files, key, content, **options), key)


def pdf_pages(files: DataFrame, key: str = "path", content: str = "content", **options) -> DataFrame:
    """(key, page, width, height, images, error) of pdf_layout(...)."""
    return pdf_layout(files, key, content, **options).drop("words")


def office_blocks(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """Blocks of Word, Excel and PowerPoint packages; other or broken files give one row with an error."""
    ship(files.sparkSession)
    kind = dict(files.dtypes)[key]
    columns = ["key", *(c.split()[0] for c in BLOCK.split(", "))]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, data in zip(b["key"], b["content"], strict=True):
                try:
                    raw = bytes(data)
                    found = detect.sniff(raw)
                    if found not in ("docx", "xlsx", "pptx"):
                        raise ValueError(f"cannot parse {found or 'unknown'} files")
                    out = [(k, i, *(x[c] for c in columns[2:-1]), None) for i, x in enumerate(ooxml.blocks(raw, found))]
                except Exception as e:
                    out = [(k, *[None] * 8, str(e) or type(e).__name__)]
                yield pd.DataFrame(out, columns=columns).astype({"block_no": "Int32", "level": "Int32"})

    rows = files.where(f"{content} is not null").selectExpr(f"{key} as key", f"{content} as content")
    return spread(rows, "key").mapInPandas(read, f"key {kind}, {BLOCK}").withColumnRenamed("key", key)
