import hashlib

import builders as b
import pytest

from pagemill.plans.extract import Options, extract, walk
from pagemill.sources import cfb, detect, mail, ooxml, pdf
from pagemill.sources.budget import Budget
from pagemill.sources.reader import binary_files, office_blocks, pages_selected, pdf_words

MINIMAL = b.pdf([[("Hello world", 100, 700, 24)]])


def names(nodes):
    return [(x["depth"], x["name"]) for x in nodes]


@pytest.mark.parametrize(
    "data,kind",
    [
        (MINIMAL, "pdf"), (b"\x89PNG\r\n\x1a\n....", "png"), (b"\xff\xd8\xff\xe0", "jpeg"), (b"GIF89a", "gif"), (b"II*\0....", "tiff"), (b"RIFF....WEBPVP8 ", "webp"), (b"{\\rtf1 x}", "rtf"),
        (b.zipped({"a.txt": b"x"}), "zip"), (b.docx(b.paragraph("x")), "docx"), (b.xlsx({"S": ""}, []), "xlsx"), (b.pptx({1: ["x"]}), "pptx"), (b.zipped({"mimetype": b"application/vnd.oasis.opendocument.text"}), "odt"),
        (b.compound({"x": b"y"}), "ole"), (b.mail("s", "b", "f", b"x"), "eml"), (b"BMI,weight\n20,60", "txt"), (b"From the desk of X", "txt"), (b"\0\1\2\3", ""), (b"", ""), ("é".encode() * 400, "txt"), (b"\n\njunk %PDF-1.4", "pdf"),
        (b"BM" + bytes(8) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + bytes(8), "bmp"),
    ],
)
def test_sniff(data, kind):
    assert detect.sniff(data) == kind


def test_detect_by_name_refines():
    ole = b.compound({"x": b"y"})
    assert [detect.detect(ole, n) for n in ("a.doc", "a.msg", "a.bin")] == ["doc", "msg", "ole"]
    assert detect.detect(b.docx(b.paragraph("x")), "wrong.pdf") == "docx"
    assert detect.detect(b"\0\1", "x.rtf") == "rtf"


def test_column_and_python_rules_agree(spark):
    from pagemill.functions.formats import sniff

    cases = [MINIMAL, b"\x89PNG\r\n\x1a\n", b.mail("s", "b", "f", b"x"), b"BMI,weight", b"From the desk", b"From a\nTo: b\n", b"\0\1", "é".encode() * 400, b"x" * 511 + "é".encode(), b"{\\rtf", b"From: a\nhello"]
    rows = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "k int, c binary").select("k", sniff("c").alias("s")).collect()
    assert {r.k: r.s for r in rows} == {k: detect.sniff(c) for k, c in enumerate(cases)}


@pytest.mark.parametrize("flate", [False, True])
def test_pdf_words(flate):
    file = pdf.File(b.pdf([[("Hello world", 100, 700, 24), ("second", 100, 660, 12)], [("next", 72, 72, 12)]], [[(10, 20, 30, 40)], []], flate=flate))
    first, second = (pdf.page(file, n) for n in file.pages())
    assert [w["text"] for w in first.words] == ["Hello", "world", "second"] and [w["text"] for w in second.words] == ["next"]
    w = first.words[0]
    assert w["x0"] == 100 and w["font_size"] == 24 and abs(w["x1"] - (100 + 24 * (722 + 556 + 222 + 222 + 556) / 1000)) < 1e-6
    assert first.images == [(10, 20, 40, 60)] and (first.width, first.height) == (612, 792)
    assert pdf.text(MINIMAL) == "Hello world"


def test_pdf_attachments_and_errors():
    assert [(c.name, c.data) for c in pdf.children(b.pdf([[]], attachments={"a.txt": b"data"}), Budget())] == [("a.txt", b"data")]
    with pytest.raises(ValueError, match="encrypted"):
        pdf.File(MINIMAL.replace(b"trailer <<", b"trailer << /Encrypt << /V 1 >>"))
    with pytest.raises(ValueError, match="not a PDF"):
        pdf.File(b"%PDF-1.4 nothing")


def test_docx_blocks():
    table = "<w:tbl>" + "".join(f"<w:tr>{''.join(f'<w:tc>{b.paragraph(c)}</w:tc>' for c in r)}</w:tr>" for r in (["a", "b"], ["1", "2"])) + "</w:tbl>"
    found = ooxml.blocks(b.docx(b.paragraph("T", "Title") + b.paragraph("H", "Heading 1") + b.paragraph("text") + b.paragraph("item", number=True) + table), "docx")
    assert [(x["kind"], x["level"]) for x in found] == [("heading", 1), ("heading", 2), ("paragraph", None), ("list_item", None), ("table", None)]
    assert found[-1]["header"] == ["a", "b"] and found[-1]["rows"] == [["1", "2"]]


def test_xlsx_blocks_keep_gaps():
    rows = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row/><row><c r="A2"><v>3.50</v></c><c r="C2"><v>x</v></c></row>'
    found = ooxml.blocks(b.xlsx({"Sheet": rows, "Empty": ""}, ["name", "value"]), "xlsx")
    assert [x["kind"] for x in found] == ["heading", "table"]
    assert found[1]["header"] == ["name", "", "value"] and found[1]["rows"] == [["3.50", "", "x"]]


def test_sparse_and_ragged_grids():
    assert len(ooxml.grid([{16383: str(k)} for k in range(20)])[0]) == 1
    ragged = ooxml.grid([{k: "v"} for k in range(1100)])
    assert len(ragged) == 1100 and all(r == ["v"] for r in ragged)
    assert [ooxml.column(x) for x in ("A1", "Z9", "AA1", "XFD1", "XFE1", "ABCD1", "1")] == [0, 25, 26, 16383, -1, -1, -1]


def test_pptx_order_and_text():
    found = ooxml.blocks(b.pptx({10: ["ten"], 2: ["two", "more"], 1: ["one"]}), "pptx")
    assert [x["text"] for x in found] == ["one", "two", "more", "ten"] and found[0]["kind"] == "heading"
    assert ooxml.text(b.docx(b.paragraph("x")), "docx") == "x"


def test_mail():
    data = b.mail("=?utf-8?q?Gr=C3=BC=C3=9Fe?=", "the body", "a\\b.txt", b"attached")
    assert mail.text(data) == "From: a@example.com\nTo: b@example.com\nSubject: Grüße\n\nthe body"
    assert [(c.name, c.data) for c in mail.children(data, Budget())] == [("b.txt", b"attached")]
    assert mail.strip_html("<p>a &amp;lt; b<br>c</p>") == "a &lt; b\nc"
    assert mail.transfer(b"not base64!", "base64") == b"not base64!"


def test_mail_alternative_prefers_plain():
    data = b"Content-Type: multipart/alternative; boundary=q\n\n--q\nContent-Type: text/html\n\n<b>html</b>\n--q\nContent-Type: text/plain\n\nplain\n--q--\n"
    assert mail.walk(data)[0] == "plain"


def test_compound_streams_and_hardening():
    big = bytes(range(256)) * 20
    f = cfb.CompoundFile(b.compound({"s": {"in": b"mini"}, "big": big}))
    assert {p: f.read(e) for p, e in f.streams()} == {("s", "in"): b"mini", ("big",): big}
    broken = bytearray(b.compound({"a": b"x"}))
    broken[30:32] = (40).to_bytes(2, "little")
    with pytest.raises(ValueError):
        cfb.CompoundFile(bytes(broken))
    for cut in (512, 600, 1024):
        try:
            cfb.CompoundFile(b.compound({"a": b"x" * 5000})[:cut]).streams()
        except ValueError:
            pass


def test_ole_and_message():
    data = b.compound({"Pool": {"\x01Ole10Native": b.ole10("C:\\x\\doc.pdf", MINIMAL)}, "raw": MINIMAL + b" "})
    assert sorted(c.name for c in cfb.ole_children(data, Budget())) == ["doc.pdf", "raw"]
    u = lambda s: s.encode("utf-16-le")
    msg = b.compound({
        "__substg1.0_0037001F": u("Subject"), "__substg1.0_1000001F": u("Body"),
        "__attach_version1.0_#00000001": {"__substg1.0_3707001F": u("b.txt"), "__substg1.0_37010102": b"data"},
        "__attach_version1.0_#00000000": {"__substg1.0_3707001F": u("in.msg"), "__substg1.0_3701000D": {"__substg1.0_0037001F": u("Inner"), "__substg1.0_1000001F": u("deep")}},
    })
    assert cfb.message_text(msg) == "Subject: Subject\n\nBody"
    assert [(c.name, c.data) for c in cfb.message_children(msg, Budget())] == [("b.txt", b"data"), ("in.txt", b"Subject: Inner\n\ndeep")]


def test_walk_depth_duplicates_and_names():
    inner = b.zipped({"deep.pdf": MINIMAL})
    outer = b.zipped({"inner.zip": inner})
    assert names(walk("outer.zip", outer)) == [(0, "outer.zip"), (1, "inner.zip"), (2, "deep.pdf")]
    assert names(walk("outer.zip", outer, Options(depth=1))) == [(0, "outer.zip"), (1, "inner.zip")]
    twice = walk("", b.zipped({"a.pdf": MINIMAL, "b.pdf": MINIMAL}))
    assert [x["error"] for x in twice] == [None, None, "already extracted this file"] and twice[0]["name"] == "document" and twice[1]["text"] == "Hello world"
    assert twice[1]["sha256"] == hashlib.sha256(MINIMAL).hexdigest()


def test_walk_budgets():
    data = b.zipped({"a.txt": b"1111", "b.txt": b"2222"})
    spent = walk("z.zip", data, Options(bytes=len(data) + 4))
    assert [x["name"] for x in spent] == ["z.zip", "a.txt", "z.zip (contents)"] and spent[2]["file_format"] == ""
    assert len(walk("z.zip", data, Options(files=2))) == 3
    refused = walk("z.zip", data, Options(bytes=len(data) + 2))
    assert [x["error"] is None for x in refused] == [True, False, False]
    assert walk("z.zip", data, Options(bytes=3))[0]["error"].startswith("larger")


def test_walk_errors_are_nodes():
    assert walk("x.zip", b"PK\x03\x04broken")[0]["error"]
    assert walk("x.pdf", b"%PDF-1.4")[0]["error"] == "not a PDF document"
    assert [x["name"] for x in walk("m.zip", b.zipped({"m": b"x"}), readers={"zip": None})] == ["m.zip"]


def test_extract_and_readers_on_spark(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.pdf").write_bytes(b.pdf([[("One", 72, 700, 12)], [("Two", 72, 700, 12)]]))
    (tmp_path / "sub" / "b.zip").write_bytes(b.zipped({"x.eml": b.mail("s", "hi", "c.txt", b"inside")}))
    (tmp_path / "c.docx").write_bytes(b.docx(b.paragraph("Para")))
    files = binary_files(spark, str(tmp_path))
    assert {r.name: r.file_format for r in files.select("name", "file_format").collect()} == {"a.pdf": "pdf", "b.zip": "zip", "c.docx": "docx"}
    tree = extract(files).collect()
    assert sorted(r.name for r in tree) == ["a.pdf", "b.zip", "c.docx", "c.txt", "x.eml"]
    assert next(r.text for r in tree if r.name == "a.pdf") == "One\fTwo"
    words = pdf_words(files, pages="2,1").orderBy("path", "page").collect()
    assert [(r.page, r.text) for r in words if r.error is None] == [(0, "One"), (1, "Two")] and sum(r.error is not None for r in words) == 2
    blocks = {r.path.rpartition("/")[2]: r for r in office_blocks(files).collect()}
    assert blocks["c.docx"].text == "Para" and blocks["a.pdf"].error == "cannot parse pdf files"
    assert extract(files.limit(0)).count() == 0


def test_stream_reads_each_file_once(spark, tmp_path):
    from pagemill.streaming.ingest import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"one")
    run = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert run()
    (tmp_path / "in" / "b.txt").write_bytes(b"two")
    assert run()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["one", "two"]


def test_page_lists():
    assert pages_selected("", 3) == [0, 1, 2] and pages_selected("2,1", 3) == [1, 0] and pages_selected("2-9", 3, 1) == [1] and pages_selected("9", 5) == []
    for bad in ("0", "3-1", "-2", "abc", "1-x"):
        with pytest.raises(ValueError):
            pages_selected(bad, 5)


def document(objects, root=1):
    """A file of the given objects, numbered from 1."""
    out = b"%PDF-1.6\n"
    for k, o in enumerate(objects, 1):
        out += b"%d 0 obj\n" % k + o + b"\nendobj\n"
    return out + b"trailer\n<< /Root %d 0 R >>\n" % root


def stream(data, head=b""):
    return b"<< " + head + b" /Length %d >>\nstream\n" % len(data) + data + b"\nendstream"


def one_page(content, fonts=b"", more=(), head=b""):
    return document([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 400 300] /Contents 4 0 R /Resources << /Font << " + fonts + b" >> >> >>", stream(content, head), *more])


def test_composite_font_with_unicode_map():
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange\n2 beginbfchar <0001> <0416> <0002> <00660069> endbfchar\n2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<0031> <0032>] endbfrange"
    fonts = [b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [6 0 R] /ToUnicode 7 0 R >>", b"<< /Subtype /CIDFontType2 /DW 500 /W [16 [700 700] 32 33 400] >>", stream(cmap)]
    data = one_page(b"BT /F 10 Tf 50 200 Td <00010002001000110012> Tj 100 0 Td <00200021> Tj 0 -40 Td <00990099> Tj ET", b"/F 5 0 R", fonts)
    words = pdf.page(f := pdf.File(data), f.pages()[0]).words
    assert [w["text"] for w in words] == ["ЖfiABC", "12", "��"]
    assert words[0]["x1"] == pytest.approx(50 + 5 + 5 + 7 + 7 + 5) and words[1]["x1"] - words[1]["x0"] == pytest.approx(8)


def test_simple_font_with_differences():
    font = b"<< /Type /Font /Subtype /Type1 /BaseFont /Abc /Encoding << /BaseEncoding /MacRomanEncoding /Differences [1 /eacute /ff /Scaron /uni20AC 66 /Zcaron.alt] >> >>"
    data = one_page(b"BT /F 10 Tf 50 200 Td (A\\001\\002\\003\\004B\\216) Tj ET", b"/F 5 0 R", [font])
    assert pdf.text(data) == "AéffŠ€Žé"


def lzw(data):
    """Literal codes alone, the table cleared before the width grows."""
    codes = [256]
    for k, c in enumerate(data):
        codes += [256] * (k > 0 and k % 200 == 0) + [c]
    bits = "".join(f"{c:09b}" for c in [*codes, 257])
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big")


def test_stream_filters():
    import base64
    import zlib

    content = b"BT /F 10 Tf 50 200 Td (Kept words) Tj ET"
    lengths = bytes([len(content) - 1]) + content + b"\x80"
    rows = b"".join(bytes([kind]) + row for kind, row in [(0, b"ab"), (1, b"c\x01"), (2, b"\x01\x01"), (3, b"\x00\x00"), (4, b"\x00\x01")])
    for name, raw in [(b"/ASCII85Decode", base64.a85encode(content) + b"~>"), (b"/ASCIIHexDecode", content.hex().encode() + b">"), (b"/RunLengthDecode", lengths), (b"/LZWDecode", lzw(content)), (b"[/ASCIIHexDecode /FlateDecode]", zlib.compress(content).hex().encode() + b">")]:
        assert pdf.text(one_page(raw, head=b"/Filter " + name)) == "Kept words", name
    assert pdf.unpredicted(rows, {"Predictor": 15, "Columns": 2}) == b"ab" + b"cd" + b"de" + b"2K" + b"2L"
    assert pdf.unpredicted(bytes([1, 2, 3, 10, 1, 1]), {"Predictor": 2, "Columns": 3}) == bytes([1, 3, 6, 10, 11, 12])


def test_streams_are_not_cut(monkeypatch):
    import zlib

    monkeypatch.setattr(pdf, "LARGEST_STREAM", 1000)
    with pytest.raises(ValueError, match="larger than"):
        pdf.text(one_page(zlib.compress(b" " * 5000), head=b"/Filter /FlateDecode"))


def seeing():
    """A recogniser of one word and a renderer, made here so that workers get them by value."""

    def recogniser(image):
        return [{"text": "seen", "x0": 100.0, "y0": 50.0, "x1": 180.0, "y1": 80.0, "confidence": 0.8}, {"text": " ", "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "confidence": 0.5}] if image.startswith(b"png") else []

    return recogniser, lambda data, page, dpi, box: b"png%r" % (box,)


def test_pages_without_text_are_recognised(spark):
    from pagemill.plans.extract import extract
    from pagemill.sources.pages import Tools
    from pagemill.sources.reader import pdf_layout

    tools = Tools(*seeing(), dpi=144)
    files = spark.createDataFrame([("empty", "a.pdf", one_page(b"")), ("text", "b.pdf", one_page(b"BT /F 10 Tf 50 200 Td (Own words) Tj ET")), ("bad", "c.pdf", b"%PDF-1.4 nothing"), ("none", "d.pdf", None)], "path string, name string, content binary")
    got = {r.path: r for r in pdf_layout(files, tools=tools).collect()}
    w = got["empty"].words[0]
    assert set(got) == {"empty", "text", "bad"} and got["bad"].error
    assert (w.text, w.x0, w.y0, w.x1, w.y1, w.confidence) == ("seen", 50, 260, 90, 275, 0.8)
    assert [x.text for x in got["text"].words] == ["Own", "words"]
    assert pdf_layout(files).where("path = 'empty'").first().words == []
    texts = {r.path: r.text for r in extract(files, tools=tools).collect()}
    assert texts["empty"].startswith("seen") and texts["text"] == "Own words"


def test_pictures_are_recognised_where_asked():
    from pagemill.sources.pages import Tools, read_pages

    image = stream(b"x", b"/Type /XObject /Subtype /Image /Width 1 /Height 1")
    content = b"BT /F 10 Tf 50 200 Td (Own) Tj ET q 200 0 0 100 100 100 cm /I Do Q q 10 0 0 10 0 0 cm /I Do Q"
    data = document([b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 400 300] /Contents 4 0 R /Resources << /XObject << /I 5 0 R >> >> >>", stream(content), image])
    boxes = []

    def render(data, page, dpi, box):
        boxes.append(box)
        return b"png"

    ((_, plain),) = read_pages(data, tools=Tools(seeing()[0], render, dpi=144))
    ((_, page),) = read_pages(data, tools=Tools(seeing()[0], render, dpi=144, figures=True))
    assert [w["text"] for w in plain.words] == ["Own"] and [w["text"] for w in page.words] == ["Own", "seen"]
    assert boxes == [(200, 200, 601, 401)]
    assert (page.words[1]["x0"], page.words[1]["y1"]) == (150, 300 - (50 + 200) / 2)


def test_recognised_words_on_native_ones_go():
    from pagemill.sources.pages import covered

    box = lambda x0, x1: {"x0": x0, "y0": 0.0, "x1": x1, "y1": 10.0}
    assert covered(box(0, 10), [box(5, 20)]) and not covered(box(0, 10), [box(5.1, 20)]) and covered(box(0, 10), [box(0, 3), box(7, 10)]) and not covered(box(5, 5), [box(0, 10)])


def test_office_route():
    from pagemill.plans.extract import office_text
    from pagemill.sources.pages import Tools
    from pagemill.sources.recognise import NoConverter

    package = b.docx(b.paragraph("Para"))
    converted = one_page(b"BT /F 10 Tf 50 200 Td (Printed) Tj ET")
    via = Tools(converter=lambda data, name: converted, native_office=False)
    assert office_text(b"old", "doc", "a.doc", via) == "Printed"
    with pytest.raises(NoConverter):
        office_text(b"old", "doc", "a.doc", Tools())
    assert office_text(package, "docx", "a.docx", via) == "Printed"
    assert office_text(package, "docx", "a.docx", Tools(native_office=False)) == office_text(package, "docx", "a.docx", Tools())


def test_a_file_may_take_so_long(spark):
    import time as clock

    from pagemill.plans.extract import extract

    def slow(data, budget):
        clock.sleep(20)
        yield

    files = spark.createDataFrame([("a", "a.txt", b"some text"), ("b", "b.zip", b"PK\x05\x06" + bytes(18))], "path string, name string, content binary")
    began = clock.time()
    got = {r.path: r for r in extract(files, readers={"txt": slow}, timeout=0.5).collect()}
    assert "took longer" in got["a"].error and got["b"].error is None and clock.time() - began < 15


def test_service_gets_a_form():
    import http.server
    import json
    import threading

    from pagemill.sources import recognise

    seen = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.headers["Content-Type"], self.rfile.read(int(self.headers["Content-Length"]))))
            body = json.dumps({"results": [{"text": "word", "bbox": [30, 40, 10, 20], "confidence": 0.5}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    assert recognise.http(url, "de")(b"PNG") == [{"text": "word", "x0": 10, "y0": 20, "x1": 30, "y1": 40, "confidence": 0.5}]
    recognise.http(url, plain=True)(b"PNG")
    server.shutdown()
    assert seen[0][0].startswith("multipart/form-data") and b'name="language"\r\n\r\nde\r\n' in seen[0][1] and b'name="file"' in seen[0][1]
    assert seen[1] == ("image/png", b"PNG")


def test_image_sizes():
    import struct

    from pagemill.sources.recognise import image_size

    tiff = b"II*\0" + struct.pack("<IH", 8, 2) + struct.pack("<HHII", 256, 4, 1, 640) + struct.pack("<HHIHH", 257, 3, 1, 480, 0)
    big = b"MM\0*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 300, 0) + struct.pack(">HHII", 257, 4, 1, 200)
    assert image_size(tiff) == (640, 480) and image_size(big) == (300, 200)
    webp = b"RIFF" + bytes(4) + b"WEBPVP8X" + bytes(8) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert image_size(webp) == (100, 50)
    assert image_size(b"RIFF" + bytes(4) + b"WEBPVP8L" + bytes(4) + b"\x2f" + (199 | 99 << 14).to_bytes(4, "little") + bytes(8)) == (200, 100)


def test_lines_as_words(spark):
    from pagemill.sources.reader import pdf_layout

    file = b.pdf([[("Some words here", 72, 700, 12), ("far off", 400, 700, 12), ("below them", 72, 680, 12)]])
    rows = spark.createDataFrame([("a", file)], "path string, content binary")
    words = pdf_layout(rows, granularity="line").first().words
    assert [w.text for w in words] == ["Some words here", "far off", "below them"]
    assert words[0].x0 == 72 and words[0].x1 == pdf_layout(rows).first().words[2].x1
