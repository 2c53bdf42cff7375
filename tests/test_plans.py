import hashlib
import struct

import builders as b
import pytest

from pagemill.plans import documents
from pagemill.sources import pdf, recognise
from pagemill.sources.reader import pdf_pages

FILES = "path string, content binary, file_format string"


def encrypted(password: str) -> bytes:
    """A file under the RC4 40-bit handler (V 1, R 2)."""
    pad = lambda s: (s.encode() + pdf.PADDING)[:32]
    owner = pdf.rc4(hashlib.md5(pad("owner")).digest()[:5], pad(password))
    key = hashlib.md5(pad(password) + owner + struct.pack("<i", -4) + b"id").digest()[:5]
    own = lambda n, data: pdf.rc4(hashlib.md5(key + struct.pack("<I", n)[:3] + bytes(2)).digest()[:10], data)
    content = own(4, b"BT /F1 12 Tf 72 700 Td (Secret text) Tj ET")
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Count 1 /Kids [3 0 R] >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 612 792] /Contents 4 0 R /Resources << >> >>", f"<< /Length {len(content)} >>\nstream\n".encode() + content + b"\nendstream", f"<< /Filter /Standard /V 1 /R 2 /P -4 /O <{owner.hex()}> /U <{pdf.rc4(key, pdf.PADDING).hex()}> >>".encode()]
    out = b"%PDF-1.4\n" + b"".join(f"{k} 0 obj\n".encode() + x + b"\nendobj\n" for k, x in enumerate(body, 1))
    return out + f"trailer << /Root 1 0 R /Encrypt 5 0 R /ID [<{b'id'.hex()}> <{b'id'.hex()}>] >>".encode()


def test_encrypted_files():
    assert pdf.text(encrypted("open"), "open") == "Secret text" and pdf.text(encrypted("")) == "Secret text"
    with pytest.raises(ValueError, match="document is encrypted"):
        pdf.text(encrypted("open"))
    with pytest.raises(ValueError, match="wrong password"):
        pdf.text(encrypted("open"), "shut")


def test_inspect(spark):
    text = [("A line of text that fills a good part of the page width here", 40, 760 - 20 * k, 18) for k in range(30)]
    file = b.pdf([text, [], [], [("Caption with some words on it", 72, 700, 12)]], [[], [(0, 0, 612, 792)], [], [(72, 100, 400, 400)]])
    rows = spark.createDataFrame([("a.pdf", bytearray(file), "pdf"), ("b.pdf", bytearray(b"%PDF-1.4"), "pdf"), ("c.png", bytearray(b"\x89PNG"), "png")], FILES)
    got = {(r.path, r.page): r for r in documents.inspect(rows).collect()}
    assert [got["a.pdf", p].reasons for p in range(4)] == [[], ["scanned"], ["no-text"], ["sparse-text", "embedded-images"]]
    assert got["b.pdf", None].error == "not a PDF document" and got["c.png", 0].needs_ocr
    assert pdf_pages(rows.where("path = 'a.pdf'"), pages="2").first().images[0].x1 == 612


def test_markdown_of_files(spark):
    file = b.pdf([[("The Title", 72, 720, 24), ("First line of text in the", 72, 680, 11), ("paragraph goes on.", 72, 666, 11), ("1. One", 72, 630, 11), ("2. Two", 72, 616, 11), ("a", 72, 560, 11), ("b", 200, 560, 11), ("1", 72, 546, 11), ("2", 200, 546, 11)]], [[(72, 100, 100, 100)]])
    rows = spark.createDataFrame([("a.pdf", bytearray(file), "pdf"), ("b.pdf", bytearray(b"x"), "pdf")], FILES)
    got = {r.path: r.markdown for r in documents.markdown(rows).collect()}
    assert got == {"a.pdf": "# The Title\n\nFirst line of text in the paragraph goes on.\n\n1. One\n2. Two\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n![](img_p1_1.png)\n", "b.pdf": None}


def test_recognition(spark):
    png = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 200, 100)
    huge = b"\x89PNG\r\n\x1a\n" + bytes(8) + struct.pack(">II", 1 << 20, 1 << 20)
    rows = spark.createDataFrame([("a", bytearray(png)), ("b", bytearray(huge)), ("c", bytearray(b"?"))], "path string, content binary")
    got = {r.path: r for r in recognise.recognise(rows, lambda image: [{"text": "w", "x0": 10, "y0": 20, "x1": 30, "y1": 40, "confidence": 0.5}]).collect()}
    assert (got["a"].y0, got["a"].y1) == (60.0, 80.0) and "too large" in got["b"].error and got["c"].error == "unknown image header"
    assert recognise.image_size(b"GIF89a" + struct.pack("<HH", 3, 4)) == (3, 4) and recognise.image_size(b"BM" + bytes(16) + struct.pack("<ii", 5, -6)) == (5, 6)
    assert recognise.image_size(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 7, 8) + bytes(9)) == (8, 7)
    assert recognise.recognise(rows.where("path = 'a'"), recognise.tesseract(binary="no-such-program")).first().error == "no-such-program is not installed"
    assert recognise.answer_words({"results": [{"text": "a", "polygon": [[5, 6], [7], [1, 9]]}, {"text": " "}], "words": [{"text": "c", "x0": 1, "y0": 2, "x1": 3, "y1": 4}]})[0] | {} == {"text": "a", "x0": 1.0, "y0": 6.0, "x1": 5.0, "y1": 9.0, "confidence": 0.0}
    assert len(recognise.tsv_words("header\n5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t96\tHello\n4\t")) == 1
