"""Which pages need recognition, and merging recognised words with native ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import trim_space

# Thresholds of the routing rules (fixed values).
FULL_PAGE, SCANNED, SPARSE, SUBSTANTIAL, MEANINGFUL = 0.75, 0.02, 0.03, 0.15, 16
FIGURE_SHARE, FIGURE_SIDE, COVERED = 0.02, 24.0, 0.5


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def page_measures(rects: DataFrame, images: DataFrame, pages: DataFrame) -> DataFrame:
    """pages (doc_id, page, width, height) with text_coverage, image_count, image_coverage, largest_image_coverage and full_page_image, from rectangles x0..y1 of text and of images."""
    area = lambda: F.greatest(F.lit(0.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    text = rects.groupBy("doc_id", "page").agg(F.sum(area()).alias("text_area"))
    image = images.groupBy("doc_id", "page").agg(F.sum(area()).alias("image_area"), F.max(area()).alias("largest"), F.count("*").alias("image_count"))
    page = F.col("width") * F.col("height")
    share = lambda c: F.when(page > 0, clamp01(F.coalesce(c, F.lit(0.0)) / page)).otherwise(0.0)
    out = pages.join(text, ["doc_id", "page"], "left").join(image, ["doc_id", "page"], "left")
    out = out.select("doc_id", "page", "width", "height", share("text_area").alias("text_coverage"), F.coalesce("image_count", F.lit(0)).alias("image_count"), share("image_area").alias("image_coverage"), share("largest").alias("largest_image_coverage"))
    return out.withColumn("full_page_image", F.col("largest_image_coverage") >= FULL_PAGE)


def ocr_reasons(text_length: str, text_coverage: str, image_count: str, image_coverage: str, full_page_image: str, garbled: str) -> Column:
    """The ordered reasons for recognition, empty for a page that needs none; a null measure counts as absent."""
    n, cover = F.coalesce(text_length, F.lit(0)), F.coalesce(text_coverage, F.lit(0.0))
    scanned = F.coalesce(full_page_image, F.lit(False)) & (cover < SCANNED)
    text = F.when(scanned, "scanned").when(n < MEANINGFUL, "no-text").when((cover < SPARSE) & (F.coalesce(image_count, F.lit(0)) > 0), "sparse-text")
    embedded = F.when(~scanned & (F.coalesce(image_coverage, F.lit(0.0)) >= SUBSTANTIAL), "embedded-images")
    return F.array_compact(F.array(text, embedded, F.when(F.coalesce(garbled, F.lit(False)), "garbled")))


def with_fallback(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Native words, and recognised ones of the pages (doc_id, page) that have no native word."""
    rest = recognised.join(native.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_anti")
    return native.unionByName(rest)


def pages_to_recognise(pages: DataFrame) -> DataFrame:
    """(doc_id, needs_ocr, pages) of pages (doc_id, page, reasons): which pages of a document have reasons, in order."""
    hit = F.size("reasons") > 0
    return pages.groupBy("doc_id").agg(F.bool_or(hit).alias("needs_ocr"), F.array_sort(F.collect_list(F.when(hit, F.col("page")))).alias("pages"))


def merge_ocr_words(native: DataFrame, recognised: DataFrame) -> DataFrame:
    """Recognised words (doc_id, page, word_id, text, x0..y1) that native words do not already cover by half of their area.

    The overlaps with native words are summed. Words without text go, words
    without area stay. Candidate pairs come from 64-point tiles of the page, so
    that each word meets its neighbours alone; a pair that shares several tiles is counted in the first.
    """
    tile = 64.0

    def tiled(df: DataFrame) -> DataFrame:
        span = lambda a, b: F.sequence(F.floor(F.col(a) / tile).cast("int"), F.greatest(F.floor(F.col(a) / tile), F.floor(F.col(b) / tile)).cast("int"))
        return df.select("*", F.explode(span("x0", "x1")).alias("tx")).select("*", F.explode(span("y0", "y1")).alias("ty"))

    ocr = recognised.where(F.trim("text") != "")
    n = tiled(native.select("doc_id", "page", "x0", "y0", "x1", "y1")).select("doc_id", "page", "tx", "ty", *(F.col(c).alias(f"n_{c}") for c in ("x0", "y0", "x1", "y1")))
    w, h = F.least("x1", "n_x1") - F.greatest("x0", "n_x0"), F.least("y1", "n_y1") - F.greatest("y0", "n_y0")
    first = (F.col("tx") == F.floor(F.greatest("x0", "n_x0") / tile)) & (F.col("ty") == F.floor(F.greatest("y0", "n_y0") / tile))
    met = tiled(ocr.select("doc_id", "page", "word_id", "x0", "y0", "x1", "y1")).join(n, ["doc_id", "page", "tx", "ty"]).where((w > 0) & (h > 0) & first)
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    covered = met.groupBy("word_id", area.alias("area")).agg(F.sum(w * h).alias("over")).where((F.col("area") > 0) & (F.col("over") >= COVERED * F.col("area")))
    return ocr.join(covered.select("word_id"), "word_id", "left_anti")


def figure_candidates(images: DataFrame, pages: DataFrame) -> DataFrame:
    """Images worth recognising: both sides of 24 points and 2 % of the page's area or more."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return images.join(pages.select("doc_id", "page", "width", "height"), ["doc_id", "page"]).where((w >= FIGURE_SIDE) & (h >= FIGURE_SIDE) & (w * h >= FIGURE_SHARE * F.col("width") * F.col("height")))


def pixels_to_points(x: Column, ratio: Column) -> Column:
    return F.when(ratio > 0, x / ratio).otherwise(x)


def pixel_rect(x0: Column, y0: Column, x1: Column, y1: Column, ratio: Column, height: Column) -> Column:
    """A page box in pixels from the top left: struct(left, top, right, bottom), the far sides one more."""
    whole = lambda v: F.floor(v).cast("int")
    return F.struct(whole(x0 * ratio).alias("left"), whole((height - y1) * ratio).alias("top"), (whole(x1 * ratio) + 1).alias("right"), (whole((height - y0) * ratio) + 1).alias("bottom"))


def matrix_apply(m: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The bounds of a box under the affine matrix struct(a, b, c, d, e, f)."""
    xs = [m["a"] * x + m["c"] * y + m["e"] for x in (x0, x1) for y in (y0, y1)]
    ys = [m["b"] * x + m["d"] * y + m["f"] for x in (x0, x1) for y in (y0, y1)]
    return F.struct(F.least(*xs).alias("x0"), F.least(*ys).alias("y0"), F.greatest(*xs).alias("x1"), F.greatest(*ys).alias("y1"))


def matrix_multiply(m: Column, n: Column) -> Column:
    """m, then n."""
    return F.struct(
        (m["a"] * n["a"] + m["b"] * n["c"]).alias("a"), (m["a"] * n["b"] + m["b"] * n["d"]).alias("b"), (m["c"] * n["a"] + m["d"] * n["c"]).alias("c"),
        (m["c"] * n["b"] + m["d"] * n["d"]).alias("d"), (m["e"] * n["a"] + m["f"] * n["c"] + n["e"]).alias("e"), (m["e"] * n["b"] + m["f"] * n["d"] + n["f"]).alias("f"),
    )


def tesseract_words(tsv: Column, least: float = 0.0) -> Column:
    """Words of a recogniser's TSV: array<struct(text, x0, y0, x1, y1, confidence)> in pixels from the top left, rows of level 5 with text and a percentage of ``least`` or more."""
    rows = F.transform(F.split(tsv, "\r?\n"), lambda r: F.split(r, "\t"))
    words = F.filter(rows, lambda r: (F.size(r) >= 12) & (r[0] == "5") & (trim_space(r[11]) != "") & (r[10].try_cast("double") >= least))
    c = lambda r: r[10].try_cast("double") / 100
    return F.transform(words, lambda r: F.struct(trim_space(r[11]).alias("text"), r[6].try_cast("double").alias("x0"), r[7].try_cast("double").alias("y0"), (r[6].try_cast("double") + r[8].try_cast("double")).alias("x1"), (r[7].try_cast("double") + r[9].try_cast("double")).alias("y1"), F.when(c(r) <= 0, 0.01).when(c(r) > 1, 1.0).otherwise(c(r)).alias("confidence")))


def polygon_box(points: Column) -> Column:
    """Bounds of array<array<double>>; points of fewer than two coordinates are skipped."""
    good = F.filter(points, lambda p: F.size(p) >= 2)
    xs, ys = F.transform(good, lambda p: p[0]), F.transform(good, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


OCR_JSON = "results array<struct<text:string,bbox:array<double>,polygon:array<array<double>>,confidence:double>>, words array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>"


def ocr_json_words(answer: Column) -> Column:
    """Words of a recognition service's JSON answer, of either of its two forms; entries without text or box are left out."""
    a = F.from_json(answer, OCR_JSON)

    def word(r: Column) -> Column:
        box, poly = r["bbox"], polygon_box(r["polygon"])
        has = F.size(box) >= 4
        return F.struct(r["text"].alias("text"), *(F.when(has, side(box[i], box[(i + 2) % 4])).otherwise(poly[n]).alias(n) for i, (n, side) in enumerate(zip(("x0", "y0", "x1", "y1"), (F.least, F.least, F.greatest, F.greatest), strict=True))), F.coalesce(r["confidence"], F.lit(0.0)).alias("confidence"))

    from_results = F.transform(F.coalesce(a["results"], F.array()), word)
    plain = F.transform(F.coalesce(a["words"], F.array()), lambda w: F.struct(w["text"].alias("text"), w["x0"].alias("x0"), w["y0"].alias("y0"), w["x1"].alias("x1"), w["y1"].alias("y1"), F.coalesce(w["confidence"], F.lit(0.0)).alias("confidence")))
    return F.filter(F.concat(from_results, plain), lambda w: w["text"].isNotNull() & (F.trim(w["text"]) != "") & w["x0"].isNotNull())
