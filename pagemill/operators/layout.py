"""Words to lines, and what is measured of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Thresholds of the layout rules (fixed values).
BAND_OVERLAP = 0.4
PARAGRAPH_GAP = 1.8
INDENT = 14.0
SIZE_TOLERANCE = 0.5
CELL_GAP, CELL_FACTOR = 18.0, 1.5
ANCHOR = 12.0
GUTTER, BUCKET = 24.0, 4.0
FULL_WIDTH = 0.7
COLUMN_LINES, COLUMN_WORDS = 4, 3.0
EDGE, REPEATED = 0.12, 0.6

WORD = "struct<text:string,x0:double,y0:double,x1:double,y1:double,font_size:double,seq:int>"


def distinct_words(words: DataFrame) -> DataFrame:
    """Re-sent rows once, those without a box or text left out."""
    return words.where("text is not null and x0 is not null and y0 is not null and x1 is not null and y1 is not null").dropDuplicates(["doc_id", "page", "seq"])


def group_lines(words: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, x0, y0, x1, y1, words, text, n_words) of words (doc_id, page, seq, text, x0..y1, font_size).

    The words of a page are taken from top to bottom and left to right; one
    joins the open line when it overlaps the line's growing band by at least
    0.4 of the lower of both heights, else it opens the next. Words of a line
    are then read from left to right. A page is one group; it is as large as a
    printed page, and the fold over it stays in the JVM.
    """
    w = F.struct((-F.col("y1")).alias("k"), "x0", "seq", F.struct("text", "x0", "y0", "x1", "y1", F.coalesce("font_size", F.lit(0.0)).alias("font_size"), "seq").alias("w"))
    pages = distinct_words(words).groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(w)).alias("ws"))
    state = f"struct<n:int,low:double,high:double,out:array<struct<n:int,w:{WORD}>>>"

    def add(acc: Column, x: Column) -> Column:
        word = x["w"]
        overlap = F.least(acc["high"], word["y1"]) - F.greatest(acc["low"], word["y0"])
        shorter = F.least(acc["high"] - acc["low"], word["y1"] - word["y0"])
        joins = (acc["n"] >= 0) & (overlap > 0) & (overlap >= BAND_OVERLAP * shorter)
        n = F.when(joins, acc["n"]).otherwise(acc["n"] + 1)
        low, high = F.when(joins, F.least(acc["low"], word["y0"])).otherwise(word["y0"]), F.when(joins, F.greatest(acc["high"], word["y1"])).otherwise(word["y1"])
        return F.struct(n.alias("n"), low.alias("low"), high.alias("high"), F.concat(acc["out"], F.array(F.struct(n.alias("n"), word.alias("w")))).alias("out")).cast(state)

    start = F.struct(F.lit(-1).alias("n"), F.lit(0.0).alias("low"), F.lit(0.0).alias("high"), F.array().alias("out")).cast(state)
    placed = pages.select("doc_id", "page", F.explode(F.aggregate("ws", start, add, lambda acc: acc["out"])).alias("p")).select("doc_id", "page", F.col("p.n").alias("line_no"), "p.w")
    return lines_of(placed)


def lines_of(placed: DataFrame) -> DataFrame:
    """Lines of words that know their line: (doc_id, page, line_no, w)."""
    lines = placed.groupBy("doc_id", "page", "line_no").agg(
        F.min("w.x0").alias("x0"), F.min("w.y0").alias("y0"), F.max("w.x1").alias("x1"), F.max("w.y1").alias("y1"),
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("w.x0").alias("a"), F.col("w.seq").alias("b"), "w"))), lambda x: x["w"]).alias("words"),
    )
    return lines.withColumn("text", F.array_join(F.transform("words", lambda x: x["text"]), " ")).withColumn("n_words", F.size("words"))


def line_size(line_words: Column, y0: Column, y1: Column) -> Column:
    """The commonest font size of a line's words, of equally common the larger; the line's height where none was collected."""
    sizes = F.filter(F.transform(line_words, lambda x: x["font_size"]), lambda x: x > 0)
    counted = F.transform(F.array_distinct(sizes), lambda s: F.struct(F.size(F.filter(sizes, lambda x: x == s)).alias("n"), s.alias("size")))
    return F.coalesce(F.array_max(counted)["size"], y1 - y0)


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, page, body): the upper median of line sizes, each line counted by its words."""
    sized = lines.select("doc_id", "page", "n_words", line_size(F.col("words"), F.col("y0"), F.col("y1")).alias("size"))
    all_sizes = F.flatten(F.collect_list(F.array_repeat("size", F.col("n_words").cast("int"))))
    return sized.groupBy("doc_id", "page").agg(F.array_sort(all_sizes).alias("s")).select("doc_id", "page", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1).alias("body"))


def document_text(lines: DataFrame) -> DataFrame:
    """(doc_id, text): lines by newline, pages by form feed."""
    pages = lines.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "\f").alias("text"))


def split_cells(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, cell_no, text, x0, x1): a gap to the word before of 18 points, or 1.5 times the line's size if more, begins a cell, which ends where its last word does."""
    size = line_size(F.col("words"), F.col("y0"), F.col("y1"))
    cells = cell_arrays(F.col("words"), size)
    return lines.select("doc_id", "page", "line_no", F.posexplode(cells).alias("cell_no", "c")).select("doc_id", "page", "line_no", "cell_no", "c.*")


def cell_arrays(line_words: Column, size: Column) -> Column:
    cell = "struct<text:string,x0:double,x1:double>"

    def add(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        new = F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["x1"].alias("x1")).cast(cell)
        grown = F.struct(F.concat(last["text"], F.lit(" "), w["text"]).alias("text"), last["x0"].alias("x0"), w["x1"].alias("x1")).cast(cell)
        opens = (F.size(acc) == 0) | (w["x0"] - last["x1"] >= F.greatest(F.lit(CELL_GAP), CELL_FACTOR * size))
        return F.when(opens, F.concat(acc, F.array(new))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown)))

    return F.aggregate(line_words, F.array().cast(f"array<{cell}>"), add)


def paragraph_breaks(lines: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, breaks): whether a line starts a paragraph of its own, by the gap to, indent from and size of the line before."""
    from pyspark.sql import Window as W

    page = W.partitionBy("doc_id", "page").orderBy("line_no")
    size = line_size(F.col("words"), F.col("y0"), F.col("y1"))
    s = lines.select("doc_id", "page", "line_no", "x0", "y0", "y1", size.alias("size"))
    p = s.select("*", *(F.lag(c).over(page).alias(f"p_{c}") for c in ("x0", "y0", "y1", "size")))
    gap = F.col("p_y0") - F.col("y1")
    goes_on = gap.between(0, PARAGRAPH_GAP * (F.col("p_y1") - F.col("p_y0"))) & ~((F.abs(F.col("x0") - F.col("p_x0")) > INDENT) & (F.col("x0") < F.col("p_x0"))) & (F.abs(F.col("size") - F.col("p_size")) <= SIZE_TOLERANCE)
    return p.select("doc_id", "page", "line_no", (~F.coalesce(goes_on, F.lit(False))).alias("breaks"))


def repeated_edge_lines(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """(doc_id, key, n_pages): keys of lines in the top or bottom 0.12 that recur on 0.6 of the pages of a document of three pages or more. heights: doc_id, page, height."""
    from pagemill.functions.text import furniture_key

    pages = heights.dropDuplicates(["doc_id", "page"])
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    edge = lines.join(pages.select("doc_id", "page", "height"), ["doc_id", "page"]).where(in_edge(F.col("y0"), F.col("y1"), F.col("height")))
    keys = edge.select("doc_id", "page", furniture_key("text").alias("key")).where("key <> ''").distinct().groupBy("doc_id", "key").agg(F.count("*").alias("n_pages"))
    return keys.join(counts, "doc_id").where((F.col("pages") >= 3) & (F.col("n_pages") >= F.ceil(F.col("pages") * REPEATED))).select("doc_id", "key", "n_pages")


def in_edge(y0: Column, y1: Column, height: Column) -> Column:
    return (height > 0) & ((y0 >= height - EDGE * height) | (y1 <= EDGE * height))


def find_gutter(lines: DataFrame) -> DataFrame:
    """(doc_id, page, start, stop): the widest blank vertical run of 24 points or more in the middle 0.2 to 0.8 of the text's extent, the leftmost of equals; pages without one have no row.

    Ink is kept in 4-point buckets; each word inks those from its left to its right edge.
    """
    extent = lines.groupBy("doc_id", "page").agg(F.min("x0").alias("l"), F.max("x1").alias("r"), F.flatten(F.collect_list("words")).alias("ws"))
    n = (F.floor((F.col("r") - F.col("l")) / BUCKET) + 1).cast("int")
    s = extent.select("doc_id", "page", "l", n.alias("n"), F.transform("ws", lambda w: F.struct(F.floor((w["x0"] - F.col("l")) / BUCKET).cast("int").alias("a"), F.floor((w["x1"] - F.col("l")) / BUCKET).cast("int").alias("b"))).alias("ink"))
    s = s.withColumn("inked", F.array_distinct(F.flatten(F.transform("ink", lambda i: F.sequence(i["a"], F.greatest(i["a"], i["b"]))))))
    first, last = F.floor(F.col("n") * 0.2).cast("int"), F.floor(F.col("n") * 0.8).cast("int")
    blank = F.array_except(F.sequence(first, F.greatest(first, last)), "inked")  # once a page, not once a bucket
    run = "struct<a:int,b:int>"

    def add(acc: Column, b: Column) -> Column:
        e = F.element_at(acc, -1)
        return F.when((F.size(acc) > 0) & (e["b"] == b - 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(e["a"].alias("a"), b.alias("b")).cast(run)))).otherwise(F.concat(acc, F.array(F.struct(b.alias("a"), b.alias("b")).cast(run))))

    runs = F.aggregate(blank, F.array().cast(f"array<{run}>"), add)
    best = F.array_max(F.transform(runs, lambda x: F.struct((x["b"] - x["a"] + 1).alias("n"), (-x["a"]).alias("a"))))
    s = s.select("doc_id", "page", "l", best.alias("best")).where(F.col("best.n") * BUCKET >= GUTTER)
    return s.select("doc_id", "page", (F.col("l") - F.col("best.a") * BUCKET).alias("start"), (F.col("l") + (-F.col("best.a") + F.col("best.n")) * BUCKET).alias("stop"))


def nearest_anchor(anchors: Column, x: Column) -> Column:
    """The position of the anchor closest to x, the lowest of equals."""
    return F.array_min(F.transform(anchors, lambda a, i: F.struct(F.abs(a - x).alias("d"), i.alias("i"))))["i"]
