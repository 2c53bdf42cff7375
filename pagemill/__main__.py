"""Command line: ``python -m pagemill {text,tree,blocks,markdown,route,words} FOLDER OUTPUT``, over all files below a folder.

It ends with 0; with 1 where a file could not be read, which its row tells; route with 2 where pages need recognition.
"""

from __future__ import annotations

import argparse
import sys

from pagemill.plans import documents
from pagemill.plans.extract import Options, extract
from pagemill.session import session
from pagemill.sources import recognise
from pagemill.sources.pages import Tools
from pagemill.sources.reader import binary_files, office_blocks, pdf_words
from pagemill.sources.render import poppler


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser(prog="pagemill", description=__doc__)
    p.add_argument("command", choices=["text", "tree", "blocks", "markdown", "route", "words"])
    p.add_argument("folder")
    p.add_argument("output", help="a folder of files")
    p.add_argument("--format", default="parquet", choices=["parquet", "json"])
    p.add_argument("--pages", default="", help="such as 1-5,10")
    p.add_argument("--max-pages", type=int)
    p.add_argument("--password", default="")
    p.add_argument("--keep-headers-footers", action="store_true")
    p.add_argument("--depth", type=int, default=8)
    p.add_argument("--files", type=int, default=512)
    p.add_argument("--bytes", type=int, default=256 << 20)
    p.add_argument("--glob")
    p.add_argument("--ocr", action="store_true", help="recognise pages without text by Tesseract")
    p.add_argument("--ocr-url", help="recognise them by a service")
    p.add_argument("--lang", default="eng")
    p.add_argument("--image-ocr", action="store_true", help="recognise pictures on pages with text too")
    p.add_argument("--native-office", action="store_true", help="read office packages without LibreOffice")
    p.add_argument("--timeout", type=float, help="seconds for one file")
    a = p.parse_args(argv)
    spark = session()
    files = binary_files(spark, a.folder, a.glob)
    recogniser = recognise.http(a.ocr_url, a.lang) if a.ocr_url else recognise.tesseract(a.lang) if a.ocr else None
    tools = Tools(recogniser, poppler() if recogniser else None, recognise.office_to_pdf, a.image_ocr, a.native_office)
    selected = {"pages": a.pages, "max_pages": a.max_pages, "password": a.password, "timeout": a.timeout}
    if a.command in ("text", "tree"):
        out = extract(files, options=Options(a.depth, a.files, a.bytes, a.command == "text"), tools=tools, timeout=a.timeout)
    elif a.command == "blocks":
        out = office_blocks(files.where("file_format in ('docx', 'xlsx', 'pptx')"))
    elif a.command == "markdown":
        out = documents.markdown(files.where("file_format = 'pdf'"), keep_headers_footers=a.keep_headers_footers, tools=tools, **selected)
    elif a.command == "words":
        out = pdf_words(files.where("file_format = 'pdf'"), tools=tools, **selected)
    else:
        out = documents.inspect(files, **selected)
    out.write.mode("overwrite").format(a.format).save(a.output)
    written = spark.read.format(a.format).load(a.output)
    failed = "error" in written.columns and not written.where("error is not null").isEmpty()
    needs = a.command == "route" and "needs_ocr" in written.columns and not written.where("needs_ocr").isEmpty()
    spark.stop()
    return 1 if failed else 2 if needs else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
