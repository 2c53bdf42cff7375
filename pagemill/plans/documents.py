"""Whole chains: files to routing verdicts, and files to Markdown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.formats import IMAGES
from pagemill.functions.text import is_garbled, trim_space
from pagemill.operators import blocks, routing
from pagemill.session import cut
from pagemill.sources.pages import Tools
from pagemill.sources.reader import pdf_layout, words_of_pages


def inspect(files: DataFrame, pages: str = "", max_pages: int | None = None, password: str = "", timeout: float | None = None) -> DataFrame:
    """(path, page, measures..., reasons, needs_ocr, error) of files (path, content, file_format), from their text layer alone: the pages of PDF files; images as one page that needs recognition; one row for any other file.

    Files that cannot be read, and those without pages to look at, have an error.
    """
    read = cut(pdf_layout(files.where("file_format = 'pdf' and content is not null"), pages=pages, max_pages=max_pages, password=password, timeout=timeout).withColumnRenamed("path", "doc_id"))
    sheets = read.where("error is null")
    words = words_of_pages(sheets, "doc_id").where("text is not null")
    text = sheets.select("doc_id", "page", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"))
    measured = routing.page_measures(words.select("doc_id", "page", "x0", "y0", "x1", "y1"), sheets.select("doc_id", "page", F.inline("images")), sheets.select("doc_id", "page", "width", "height"))
    full = measured.join(text, ["doc_id", "page"], "left").select("*", F.coalesce(F.length(trim_space("text")), F.lit(0)).alias("text_length"), F.coalesce(is_garbled("text"), F.lit(False)).alias("garbled")).drop("text")
    full = full.withColumn("reasons", routing.ocr_reasons("text_length", "text_coverage", "image_count", "image_coverage", "full_page_image", "garbled")).withColumn("error", F.lit(None).cast("string"))
    broken = read.where("error is not null").select("doc_id", "error")
    picture = F.col("file_format").isin(IMAGES)
    alone = files.where(picture).select(F.col("path").alias("doc_id"), F.lit(0).alias("page"), F.lit(1).cast("bigint").alias("image_count"), F.lit(1.0).alias("image_coverage"), F.lit(1.0).alias("largest_image_coverage"), F.lit(True).alias("full_page_image"), F.lit(0).alias("text_length"), F.array(F.lit("scanned")).alias("reasons"))
    known = F.coalesce(F.col("file_format"), F.lit(""))
    other = files.where(((known != "pdf") & ~F.coalesce(picture, F.lit(False))) | ((known == "pdf") & F.col("content").isNull())).select(F.col("path").alias("doc_id"), F.concat(F.lit("no pages to inspect in a file of format "), F.when(known == "", "unknown").otherwise(known)).alias("error"))
    rows = full.unionByName(broken, allowMissingColumns=True).unionByName(alone, allowMissingColumns=True).unionByName(other, allowMissingColumns=True)
    return rows.withColumn("needs_ocr", F.coalesce(F.size("reasons") > 0, F.lit(False))).withColumnRenamed("doc_id", "path")


def markdown(files: DataFrame, pages: str = "", max_pages: int | None = None, keep_headers_footers: bool = False, password: str = "", tools: Tools | None = None, timeout: float | None = None) -> DataFrame:
    """(path, markdown, error) of PDF files (path, content), from one reading of each; a file without text has empty Markdown, one that cannot be read its error."""
    read = cut(pdf_layout(files, pages=pages, max_pages=max_pages, password=password, tools=tools, timeout=timeout).withColumnRenamed("path", "doc_id"))
    sheets = read.where("error is null")
    words = words_of_pages(sheets, "doc_id").where("text is not null")
    found = blocks.blocks(words, sheets.select("doc_id", "page", "height"), sheets.select("doc_id", "page", F.inline("images")), keep_headers_footers)
    table = F.when(F.col("kind") == "table", blocks.markdown_table(F.col("header"), F.col("rows")))
    made = blocks.render_markdown(found.withColumn("table", table))
    told = read.groupBy("doc_id").agg(F.max("error").alias("error"))
    return told.join(made, "doc_id", "left").select(F.col("doc_id").alias("path"), F.when(F.col("error").isNull(), F.coalesce("markdown", F.lit(""))).alias("markdown"), "error")
