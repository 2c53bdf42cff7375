import pytest
from pyspark.sql import functions as F

from pagemill.functions import text as t
from pagemill.operators import blocks, layout, pages, routing, trees
from pagemill.operators.pages import Line, Word

WORDS = "doc_id bigint, page int, seq int, text string, x0 double, y0 double, x1 double, y1 double, font_size double, confidence double"


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("r")).first().r


def line(text, x, y, size=11.0, gap=6.0):
    words, at = [], x
    for w in text.split(" "):
        words.append(Word(w, at, y, at + 6.0 * len(w), y + size, size))
        at += 6.0 * len(w) + gap
    return Line(words)


def words(spark, placed):
    """placed: (text, page, x, y, size) runs, one word each blank-separated part."""
    rows, seq = [], 0
    for text, page, x, y, size in placed:
        for w in text.split(" "):
            rows.append((1, page, seq, w, float(x), float(y), float(x) + 6.0 * len(w), float(y) + size, float(size), 0.0))
            x, seq = x + 6 * len(w) + 6, seq + 1
    return spark.createDataFrame(rows, WORDS)


@pytest.mark.parametrize(
    "text,marker,rest,ordered",
    [("- item", "-", "item", False), ("• item", "•", "item", False), ("1. First", "1.", "First", True), ("12) x", "12)", "x", True), ("a) x", "a)", "x", True), ("1.5 million", "1.", "5 million", True), ("e.g. x", "e.", "g. x", True)],
)
def test_list_markers(spark, text, marker, rest, ordered):
    r = one(spark, t.list_marker("s"), s=text)
    assert (r.marker, r.rest, r.ordered) == (marker, rest, ordered)
    assert pages.list_marker(text) == (marker, rest, ordered)


@pytest.mark.parametrize("text", ["•item", "-", "1234. x", "word", "", "é) x"])
def test_no_list_marker(spark, text):
    assert one(spark, t.list_marker("s"), s=text) is None and pages.list_marker(text) is None


@pytest.mark.parametrize("a,b,joined", [("agai-", "nst", "against"), ("co-", "Op", "co- Op"), ("end", "next", "end next"), ("x-", "état", "x- état"), ("x-", "•", "x•")])
def test_join_wrapped(spark, a, b, joined):
    assert one(spark, t.join_wrapped("a", "b"), a=a, b=b) == joined == pages.join_wrapped(a, b)


@pytest.mark.parametrize("text,bad", [("plain text of a page here", False), ("x (cid:12) y", True), ("�" * 16, True), ("short", False), ("" * 40, True)])
def test_garbled(spark, text, bad):
    assert one(spark, t.is_garbled("s"), s=text) is bad


def test_scalar_rules(spark):
    assert one(spark, t.furniture_key("s"), s="Page 3 of 12") == "page#of##"
    assert one(spark, t.escape_cell("s"), s="a|b\r\nc") == "a\\|b<br>c"
    assert [one(spark, t.column_index("s"), s=x) for x in ("A1", "AA1", "XFD1", "XFE1", "ABCD1", "7")] == [0, 26, 16383, -1, -1, -1]
    assert [one(spark, t.heading_style("s"), s=x) for x in ("Title", "Heading 1", "HEADING9", "Body")] == [1, 2, 6, None]
    assert one(spark, t.strip_html("s"), s="<p>a &amp;lt; b</p>x<br>y<script>z</script>") == "a &lt; b\nx\nyz"
    assert one(spark, t.base_name("s"), s="a\\b/c.txt") == "c.txt"
    assert [one(spark, t.clamp_confidence("s"), s=x) for x in (0.0, -1.0, 87.0, 250.0)] == [0.01, 0.01, 0.87, 1.0]


def test_lines(spark):
    got = layout.group_lines(words(spark, [("second line", 0, 72, 600, 12), ("Hello world", 0, 72, 650, 12)])).orderBy("line_no").collect()
    assert [r.text for r in got] == ["Hello world", "second line"]
    lifted = spark.createDataFrame([(1, 0, 0, "cost", 72.0, 600.0, 96.0, 612.0, 0.0, 0.0), (1, 0, 1, "1", 98.0, 606.0, 104.0, 614.0, 0.0, 0.0), (1, 0, 2, None, 1.0, 1.0, 1.0, 1.0, 0.0, 0.0)], WORDS)
    assert [r.text for r in layout.group_lines(lifted).collect()] == ["cost 1"]
    assert layout.group_lines(lifted.limit(0)).count() == 0


def test_classify_kinds(spark):
    placed = [("The Title", 0, 72, 720, 24), ("First line of the text", 0, 72, 680, 11), ("second line of it.", 0, 72, 666, 11), ("Section two", 0, 72, 630, 16), ("- one", 0, 72, 600, 11), ("- two", 0, 72, 586, 11)]
    heights = spark.createDataFrame([(1, 0, 792.0)], "doc_id bigint, page int, height double")
    got = blocks.blocks(words(spark, placed), heights).orderBy("block_no").collect()
    assert [r.kind for r in got] == ["heading", "paragraph", "heading", "list_item", "list_item"]
    assert got[0].level == 1 and got[1].text == "First line of the text second line of it." and got[3].text == "one"


def test_borderless_table():
    rows = [("Region", "Sales", "Growth"), ("North", "10", "5%"), ("South", "12", "7%")]
    lines = [Line([Word(c, x, 700.0 - 16 * k, x + 6 * len(c), 711.0 - 16 * k, 11.0) for c, x in zip(r, (72.0, 220.0, 380.0), strict=True)]) for k, r in enumerate(rows)]
    (table,) = pages.page_blocks(lines)
    assert table.kind == "table" and table.header == list(rows[0]) and table.rows[1][2] == "7%"


def test_columns_read_left_then_right():
    lines = [line("A headline that runs across the whole width of the page up here", 72, 740, 20.0)]
    for k in range(6):
        left, right = line(f"left column text {k} here", 72, 700 - 14 * k), line(f"right column text {k} here", 330, 700 - 14 * k)
        lines.append(Line(left.words + right.words))
    regions = pages.reading_order(lines)
    assert len(regions) == 3 and all(x.text.startswith("left") for x in regions[1]) and all(x.text.startswith("right") for x in regions[2])
    assert pages.reading_order([]) == [] and pages.page_blocks([]) == []


def test_figures_before_lower_blocks():
    found = pages.page_blocks([line("Above the figure.", 72, 700), line("Below the figure.", 72, 300)])
    placed = pages.place_figures(found, [{"index": 0, "x0": 72, "y0": 400, "x1": 300, "y1": 600}], 1)
    assert [b.kind for b in placed] == ["paragraph", "figure", "paragraph"] and placed[1].figure_id == "img_p2_1"


def test_furniture(spark):
    placed = [x for p in range(4) for x in ((f"Page {p} of 4", p, 72, 30, 9), ("Running title", p, 72, 770, 9), (f"Body text number {p}", p, 72, 400, 11))]
    heights = spark.createDataFrame([(1, p, 792.0) for p in range(4)], "doc_id bigint, page int, height double")
    w = words(spark, placed)
    assert sorted(r.key for r in layout.repeated_edge_lines(layout.group_lines(w), heights).collect()) == ["page#of#", "runningtitle"]
    assert sorted(r.text for r in blocks.blocks(w, heights).collect()) == [f"Body text number {p}" for p in range(4)]
    assert blocks.blocks(w, heights, keep_headers_footers=True).count() == 12


def test_markdown(spark):
    rows = spark.createDataFrame(
        [(1, 0, 0, "heading", "Title", 1, None, None, None, None), (1, 0, 1, "list_item", "one", None, True, "1.", None, None), (1, 0, 2, "list_item", "two", None, True, "2.", None, None), (1, 0, 3, "paragraph", " ", None, None, None, None, None), (1, 0, 4, "figure", None, None, None, None, None, "img_p1_1")],
        "doc_id bigint, page int, block_no int, kind string, text string, level int, ordered boolean, marker string, table string, figure_id string",
    )
    assert blocks.render_markdown(rows).first().markdown == "# Title\n\n1. one\n2. two\n\n![](img_p1_1.png)\n"
    md = blocks.markdown_table(F.lit(None).cast("array<string>"), F.array(F.array(F.lit("a"), F.lit("b|")), F.array(F.lit("c"))))
    assert spark.range(1).select(md.alias("m")).first().m == "|  |  |\n| --- | --- |\n| a | b\\| |\n| c |"


def test_dense_grid(spark):
    rows = [("s", 0, 0, "a"), ("s", 0, 2, "c"), ("s", 1, 1, "b"), ("s", 1, 1, "a"), ("s", None, 1, "x"), *[("wide", k, 16383, str(k)) for k in range(20)]]
    got = {(r.sheet, r.row_no): r.cells for r in blocks.dense_grid(spark.createDataFrame(rows, "sheet string, r int, c int, t string"), "sheet", "r", "c", "t").collect()}
    assert got["s", 0] == ["a", "", "c"] and got["s", 1] == ["", "b", ""] and got["wide", 3] == ["3"]


def test_merge_recognised_words(spark):
    s = "doc_id bigint, page int, word_id bigint, text string, x0 double, y0 double, x1 double, y1 double"
    native = spark.createDataFrame([(1, 0, 1, "Total", 100.0, 100.0, 140.0, 112.0)], s)
    seen = spark.createDataFrame([(1, 0, 7, "Total", 102.0, 101.0, 141.0, 112.0), (1, 0, 8, "42", 300.0, 100.0, 320.0, 112.0), (1, 0, 9, " ", 1.0, 1.0, 2.0, 2.0), (1, 0, 10, "flat", 101.0, 105.0, 101.0, 105.0)], s)
    assert sorted(r.text for r in routing.merge_ocr_words(native, seen).collect()) == ["42", "flat"]


def test_routing_reasons(spark):
    rows = [(500, 0.3, 0, 0.0, False, False), (0, 0.0, 1, 1.0, True, False), (0, 0.0, 0, 0.0, False, False), (40, 0.01, 1, 0.4, False, True), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "n int, c double, i int, ic double, f boolean, g boolean")
    got = [r.r for r in df.select(routing.ocr_reasons("n", "c", "i", "ic", "f", "g").alias("r")).collect()]
    assert got == [[], ["scanned"], ["no-text"], ["sparse-text", "embedded-images", "garbled"], ["no-text"]]


def test_recognition_answers(spark):
    tsv = "level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext\n5\t1\t1\t1\t1\t1\t10\t20\t30\t10\t96.5\tHello\n5\t1\t1\t1\t1\t2\t50\t20\t30\t10\t0\tx\n4\t1\t1\t1\t1\t0\t0\t0\t0\t0\t-1\t\n5\t1\t1\t1\t1\t3\t0\t0\t0\t0\t90\t "
    got = one(spark, routing.tesseract_words(F.col("s")), s=tsv)
    assert [(w.text, w.x1, w.confidence) for w in got] == [("Hello", 40.0, 0.965), ("x", 80.0, 0.01)]
    answer = '{"results":[{"text":"a","bbox":[1,2,3,4],"confidence":0.9},{"text":"b","polygon":[[5,6],[7],[1,9]]},{"text":""}],"words":[{"text":"c","x0":1,"y0":2,"x1":3,"y1":4}]}'
    got = one(spark, routing.ocr_json_words(F.col("s")), s=answer)
    assert [(w.text, w.x0, w.y1) for w in got] == [("a", 1.0, 4.0), ("b", 1.0, 9.0), ("c", 1.0, 4.0)]


@pytest.mark.parametrize("spec,count,want", [("2,1", 3, [1, 0]), ("1-3,2", 5, [0, 1, 2]), ("9", 5, []), ("4-9", 5, [3, 4]), (" , ", 5, []), ("0", 5, None), ("3-1", 5, None), ("-2", 5, None), ("abc", 5, None)])
def test_page_list(spark, spec, count, want):
    assert one(spark, trees.page_list(F.col("s"), F.col("n")), s=spec, n=count) == want


def test_budget_fold(spark):
    kids = spark.createDataFrame([(1, k, k, s) for k, s in enumerate([4, 100, 3, 3, 1])], "doc bigint, child bigint, ord int, size bigint")
    got = [r.outcome for r in trees.admit(kids, "doc", "ord", "size", "child", None, 10).orderBy("child").collect()]
    assert got == ["accepted", "refused", "accepted", "accepted", "stopped"]


def test_outputs_are_unique(spark):
    files = spark.createDataFrame([(1, "report.pdf"), (2, "report.docx"), (3, "sub/report.pdf"), (4, "report.pdf"), (5, None)], "id bigint, path string")
    got = {r.id: r.output for r in trees.plan_outputs(files, "id", "path", ".txt").collect()}
    assert got == {1: "report.pdf.txt", 2: "report.docx.txt", 3: "sub/report.txt", 4: "report.pdf-2.txt"}
