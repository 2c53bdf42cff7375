"""Lines to blocks: reading order, tables, lists, headings, paragraphs, figures; Markdown and plain text.

Everything that one line or its neighbour decides is a Column expression. The
classification of a page consumes lines as it goes, which no window frame can
say; it runs on the lines of one page at a time, Arrow batches in and out, so
pages stay spread over the cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import escape_cell, furniture_key, trim_space
from pagemill.operators import layout, pages
from pagemill.session import ship

BLOCK = "page int, block_no int, kind string, text string, level int, ordered boolean, marker string, rows array<array<string>>, header array<string>, figure_id string, x0 double, y0 double, x1 double, y1 double"


def drop_furniture(lines: DataFrame, heights: DataFrame) -> DataFrame:
    """Lines without those in the edge zone whose key recurs over the document."""
    repeated = layout.repeated_edge_lines(lines, heights).select("doc_id", "key")
    keyed = lines.join(heights.dropDuplicates(["doc_id", "page"]).select("doc_id", "page", "height"), ["doc_id", "page"], "left").withColumn("key", furniture_key("text"))
    edge = F.coalesce(layout.in_edge(F.col("y0"), F.col("y1"), F.col("height")), F.lit(False))
    hit = keyed.join(repeated.withColumn("again", F.lit(True)), ["doc_id", "key"], "left")
    return hit.where(~(edge & F.coalesce("again", F.lit(False)))).select(*lines.columns)


def blocks(words: DataFrame, heights: DataFrame, images: DataFrame | None = None, keep_headers_footers: bool = False) -> DataFrame:
    """Blocks of every page of words (doc_id, page, seq, text, x0..y1, font_size); images (doc_id, page, index, x0..y1) become figure blocks.

    Pages without words or images give no row.
    """
    ship(words.sparkSession)
    lines = layout.group_lines(words)
    if not keep_headers_footers:
        lines = drop_furniture(lines, heights)
    size = layout.line_size(F.col("words"), F.col("y0"), F.col("y1"))
    line = F.struct("line_no", "x0", "y0", "x1", "y1", "text", size.alias("size"), F.transform("words", lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), w["font_size"].alias("font_size"))).alias("words"))
    per_page = lines.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    if images is not None:
        figures = images.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("index", "x0", "y0", "x1", "y1"))).alias("figures"))
        per_page = per_page.join(figures, ["doc_id", "page"], "full_outer")
    else:
        per_page = per_page.withColumn("figures", F.lit(None).cast("array<struct<index:int,x0:double,y0:double,x1:double,y1:double>>"))

    def classify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                found = pages.page_blocks([pages.Line.of(x) for x in (r.lines if r.lines is not None else [])])
                found = pages.place_figures(found, [] if r.figures is None else list(r.figures), int(r.page))
                out += [(r.doc_id, r.page, k, x.kind, x.text, x.level, x.ordered, x.marker, x.rows, x.header, x.figure_id, *x.box) for k, x in enumerate(found)]
            frame = pd.DataFrame(out, columns=["doc_id", *(c.split()[0] for c in BLOCK.split(", "))])
            frame["level"] = frame["level"].astype("Int32")
            yield frame

    return per_page.select("doc_id", F.col("page").cast("int").alias("page"), "lines", "figures").mapInPandas(classify, f"doc_id {dict(words.dtypes)['doc_id']}, {BLOCK}")


def markdown_table(header: Column, rows: Column) -> Column:
    """Header, rule and rows; an absent header has as many empty cells as the widest row, a short one is padded, rows keep their own width."""
    width = F.greatest(F.coalesce(F.size(header), F.lit(0)), F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0)))
    padded = F.concat(F.coalesce(header, F.array().cast("array<string>")), F.array_repeat(F.lit(""), width - F.greatest(F.coalesce(F.size(header), F.lit(0)), F.lit(0))))
    row = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: escape_cell(trim_space(F.coalesce(c, F.lit(""))))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(row(padded), rule), F.transform(rows, row)), "\n")


def block_markdown(kind: Column, text: Column, level: Column, ordered: Column, marker: Column, table: Column, figure_id: Column) -> Column:
    t = trim_space(F.coalesce(text, F.lit("")))
    return (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(1))))), F.lit(" "), t))
        .when((kind == "list_item") & F.coalesce(ordered, F.lit(False)), F.concat(F.coalesce(marker, F.lit("1.")), F.lit(" "), t))
        .when(kind == "list_item", F.concat(F.lit("- "), t))
        .when(kind == "figure", F.concat(F.lit("![]("), F.coalesce(figure_id, F.lit("")), F.lit(".png)")))
        .when(kind == "table", table)
        .otherwise(t)
    )


def render_markdown(rows: DataFrame) -> DataFrame:
    """(doc_id, markdown) of blocks with page, block_no, kind, text, level, ordered, marker, table (its Markdown) and figure_id.

    Blank lines part blocks, list entries after one another are on consecutive
    lines, blocks without text (other than tables and figures) are skipped, and
    the end is a newline.
    """
    full = rows.where(F.col("kind").isin("table", "figure") | (trim_space(F.coalesce("text", F.lit(""))) != ""))
    md = block_markdown(F.col("kind"), F.col("text"), F.col("level"), F.col("ordered"), F.col("marker"), F.col("table"), F.col("figure_id"))
    # A document's blocks are as large as the document.
    all_ = full.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "block_no", md.alias("md"), (F.col("kind") == "list_item").alias("item")))).alias("b"))
    # What parts a block from the one before is known from both; the whole is joined once.
    parts = F.transform("b", lambda x, i: F.concat(F.when(i == 0, "").when(x["item"] & F.try_element_at("b", i)["item"], "\n").otherwise("\n\n"), x["md"]))
    return all_.select("doc_id", F.concat(F.array_join(parts, ""), F.lit("\n")).alias("markdown"))


def office_row(cells: Column) -> Column:
    """Cells by tabs, inner blanks kept, trailing ones cut."""
    return F.regexp_replace(F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), "\t"), "\t+$", "")


def row_fill(cells: Column) -> Column:
    """struct(filled, complete, mostly): how many cells of a row have text, whether all do, and whether at least half do."""
    filled = F.size(F.filter(cells, lambda c: trim_space(F.coalesce(c, F.lit(""))) != ""))
    return F.struct(filled.alias("filled"), (filled == F.size(cells)).alias("complete"), (filled * 2 >= F.size(cells)).alias("mostly"))


def dense_grid(cells: DataFrame, key: str, row: str, column: str, text: str, most: int = 1 << 20, floor: int = 4096, divisor: int = 8) -> DataFrame:
    """(key, row_no, cells) of stored cells: a dense grid; over ``floor`` places of which less than an eighth are filled, or over ``most``, only used columns; still over ``most``, each row's own cells.

    Cells without text, row or column are left out; of repeated places the greatest text holds.
    """
    c = cells.where(F.col(text).isNotNull() & F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(key, F.col(row).alias("r"), F.col(column).alias("c")).agg(F.max(text).alias("t"))
    shape = c.groupBy(key).agg((F.max("c") + 1).alias("width"), F.countDistinct("r").alias("n_rows"), F.count("*").alias("filled"), F.array_sort(F.collect_set("c")).alias("used"))
    total = F.col("width").cast("bigint") * F.col("n_rows")
    compact = (total > most) | ((total > floor) & (F.col("filled") * divisor < total))
    columns = F.when(compact, F.col("used")).otherwise(F.sequence(F.lit(0), F.col("width") - 1))
    ragged = compact & (F.size("used").cast("bigint") * F.col("n_rows") > most)
    rows = c.groupBy(key, "r").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "t")))).alias("m"))
    grid = F.transform(columns, lambda k: F.coalesce(F.try_element_at("m", k), F.lit("")))
    return rows.join(shape, key).select(key, F.col("r").alias("row_no"), F.when(ragged, F.map_values("m")).otherwise(grid).alias("cells"))
