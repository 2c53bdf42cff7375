"""Repairing the text of scanned pages.

Lines come from the words' boxes. Words cut at a line end are found by the
hyphen that ends the line, running headers, footers and page numbers by their
place at the edge of the page. Misread words are found by anagram hashing: a
hash that adds up over characters changes by a fixed amount for each confusion
of characters, so a rare word meets the frequent words it may stand for in one
equi-join, and the closest and commonest of these corrects it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.session import cut

#: What scanners make of characters (fixed values): the right ones and what is read, in lower case.
CONFUSIONS = [
    ("o", "0"), ("l", "1"), ("i", "1"), ("l", "|"), ("i", "|"), ("l", "i"), ("i", "l"), ("t", "+"), ("a", "@"), ("c", "("), ("e", "c"), ("c", "e"), ("b", "6"), ("g", "9"), ("q", "9"), ("s", "5"), ("z", "2"), ("b", "8"),
    ("n", "ri"), ("m", "rn"), ("d", "cl"), ("h", "li"), ("h", "b"), ("b", "h"), ("u", "ii"), ("w", "vv"), ("rn", "m"), ("cl", "d"), ("ri", "n"), ("li", "h"), ("ii", "u"), ("vv", "w"), ("f", "t"), ("t", "f"), ("u", "v"), ("v", "u"), ("y", "v"), ("g", "q"), ("s", "8"), ("fi", "h"), ("in", "m"), ("m", "in"), ("k", "lc"), ("t", "7"),
]
#: A lower-cased word without the marks around it. Marks that a misread letter may have become stay.
OUTER = r"^[\s\"'`“”‘’«»„\[{]+|[\s.,;:!?…\"'`“”‘’«»)\]}*]+$"
INVISIBLE = "­​‌‍⁠﻿"
SPACES = "\u00a0\u2002\u2003\u2007\u2008\u2009\u200a\u202f\u3000"
HYPHENS = "-¬­‐"


def _fold(text: Column | str) -> Column:
    """Lower case in ordinary characters: no invisible ones, full-width ones narrowed, look-alikes in words with Latin letters turned Latin."""
    c = F.translate(text, SPACES + INVISIBLE, " " * len(SPACES))
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F))
    c = F.when(c.rlike("[！-～]"), F.translate(c, wide, "".join(chr(x - 0xFEE0) for x in range(0xFF01, 0xFF5F)))).otherwise(c)
    c = F.when(c.rlike("[A-Za-z]") & c.rlike("[Ͱ-џ]"), F.translate(c, "АВЕЅІЈКМНОРСТХУаеѕіјорсхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTXYaesijopcxyABEZHIKMNOPTYXoav")).otherwise(c)
    return F.lower(c)


def core(text: Column | str) -> Column:
    plain = text.rlike(r"^[A-Za-z]+$") if isinstance(text, Column) else F.col(text).rlike(r"^[A-Za-z]+$")
    return F.when(plain, F.lower(text)).otherwise(F.regexp_replace(_fold(text), OUTER, ""))


def anagram(word: Column) -> Column:
    """The sum of the fifth powers of the ten low bits of a word's code points (after Reynaert 2004), the same for all orders of its characters."""
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda a, c: a + _fifth(F.ascii(c).cast("bigint").bitwiseAND(1023)))


def _fifth(x: Column) -> Column:
    return x * x * x * x * x


def _value(s: str) -> int:
    return sum(ord(c) ** 5 for c in s)


def vocabulary(words: DataFrame) -> DataFrame:
    """(w, n, native): how often each core occurs, in all and among native words, over the whole table."""
    rows = words.where("text is not null").select("text", (F.col("confidence") == 0).alias("native"))
    # Equal texts are counted before their cores are taken.
    counted = rows.groupBy("text").agg(F.count("*").alias("n"), F.sum(F.col("native").cast("bigint")).alias("native"))
    return counted.select(core("text").alias("w"), "n", F.coalesce("native", F.lit(0)).alias("native")).where("w <> ''").groupBy("w").agg(F.sum("n").alias("n"), F.sum("native").alias("native"))


def corrections(known: DataFrame, frequent: int = 5, ratio: int = 8) -> DataFrame:
    """(w, right): rare words of scanned pages and the frequent word that one or two confusions make of them.

    A frequent word occurs at least ``frequent`` times, ``ratio`` times as often as
    the rare one, and on native pages too, where nothing is misread (in a collection
    without native pages, four times as often). Of several the one with the fewest
    confusions, then the commonest, then the first in order holds.
    """
    texts = known.where(F.col("w").rlike(r"[\p{IsLatin}@+|(]"))
    sure = F.col("n") >= 4 * frequent if known.where("native > 0").isEmpty() else F.col("native") > 0
    often = texts.where((F.col("n") >= frequent) & F.col("w").rlike(r"^[\p{IsLatin}\p{M}'’-]+$") & sure).select(F.col("w").alias("right"), F.col("n").alias("right_n"), F.col("native").alias("right_native"), anagram(F.col("w")).alias("h"))
    step = "struct<d:bigint,cost:int>"
    fits = F.filter(
        F.array(*(F.when(F.instr("right", a) > 0, F.struct(F.lit(_value(b) - _value(a)).cast("bigint").alias("d"), F.lit(max(len(a), len(b))).alias("cost"))).cast(step) for a, b in CONFUSIONS)),
        lambda x: x.isNotNull(),
    )
    often = often.withColumn("one", fits)
    twice = F.flatten(F.transform("one", lambda x: F.transform("one", lambda y: F.struct((x["d"] + y["d"]).alias("d"), (x["cost"] + y["cost"]).alias("cost"), F.lit(2).alias("steps")))))
    once = F.transform("one", lambda x: F.struct(x["d"].alias("d"), x["cost"].alias("cost"), F.lit(1).alias("steps")))
    reach = often.select("right", "right_n", "right_native", "h", F.explode(F.filter(F.array_distinct(F.concat(once, twice)), lambda x: x["d"] != 0)).alias("x"))
    reach = reach.select("right", "right_n", "right_native", (F.col("h") + F.col("x.d")).alias("h"), "x.cost", "x.steps")  # the same letters in another order are no misreading
    rare = texts.where("n > native").select("w", "n", "native", anagram(F.col("w")).alias("h"))
    met = rare.join(reach, "h").where((F.col("w") != F.col("right")) & (F.col("right_n") >= ratio * F.col("n")) & (F.col("native") * ratio <= F.col("right_native")) & ((F.col("native") == 0) | (F.col("n") >= 4 * F.col("native"))))
    met = met.where(F.levenshtein("w", "right") <= F.col("cost"))
    best = F.min(F.struct("steps", (-F.col("right_n")).alias("n"), "right"))
    return met.groupBy("w").agg(best.alias("b")).select("w", F.col("b.right").alias("right"))


#: Shapes that only a misread character gives: digits with letters among them, and letters with a digit or sign between them.
NUMBER = r"^[#§(]?(?=.*[0-9])(?=.*[OoIl|S])[0-9OoIl|S]+(?:[.,:/-][0-9OoIl|S]+)*[%.,;:!?)`]*$"
CODE = r"^[A-Z]{1,2}-?[A-Z]?[0-9OIl|]*[0-9][OIl|][0-9OIl|]*[.,;:!?]*$|^[A-Z]{1,2}-?[A-Z]?-?[OIl|][0-9]{2,}[.,;:!?]*$"
INSIDE = r"\p{Ll}[@+|0-9(]\p{Ll}|^[\"'`(]?[+|]\p{Ll}{2,}"
#: What has signs within a word by itself: addresses of mails and the web, with tags or written out, file names, calls, hexadecimal numbers, factors.
NOT_INSIDE = r"@[\w-]+[.(\[]|\((?:at|dot)\)|\+\w+(?:@|\()|https?:|\(\)|\.[a-z]{2,4}\b|^[0-9a-f]{8,}\W*$|[a-z@][0-9]x\b"
#: What a sign within a word was, among those of CONFUSIONS the likeliest.
SIGNS = {"@": "a", "+": "t", "(": "c", "0": "o", "1": "l", "2": "z", "5": "s", "6": "b", "7": "t", "8": "b", "9": "g", "|": "l"}


def reshaped(text: Column | str) -> Column:
    """The text of a word of an impossible shape with each misread character set right by the characters beside it: letters among digits become digits, signs and digits among letters become letters."""
    c = F.col(text) if isinstance(text, str) else text
    digits = F.translate(c, "OoIl|S", "001115")
    prefix = F.regexp_extract(c, r"^([A-Z]{1,2}-?[A-HJ-NP-Z]?-?(?=[0-9OIl|]))", 1)
    code = F.concat(prefix, F.translate(F.substring(c, F.length(prefix) + 1, F.length(c)), "OIl|", "0111"))
    inside = F.regexp_replace(F.regexp_replace(c, r"^([\"'`(]?)\+(?=\p{Ll})", "$1t"), r"^([\"'`(]?)\|(?=\p{Ll})", "$1I")
    for sign, letter in SIGNS.items():
        inside = F.regexp_replace(inside, rf"(?<=\p{{Ll}})[{sign}](?=\p{{Ll}})", letter)
    return F.when(c == "@", "a").when(c.rlike(NUMBER), digits).when(c.rlike(CODE), code).otherwise(inside)


def scanned_words(words: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """The words of pages with recognised text, once each, in lines: key columns, text, core, line, first, last (of the line), before and after (the texts next to it), running.

    A word of unknown confidence belongs to its page. Lines follow the boxes from
    top to bottom; a box without coordinates stands at the page's top. A line is
    running when it lies within 0.12 of the height at the page's top or bottom,
    a line's height or more apart from the next line inwards. The height is that of
    sizes (doc_id, page, height), PAGE_HEIGHT where it has none above 0.
    """
    page = W.partitionBy("doc_id", "page")
    rows = words.where("confidence is null or isnan(confidence) or confidence > 0").where("text is not null").select("word_id", "doc_id", "page", "text", "x0", "y0", "y1", "confidence")
    down = page.orderBy(F.desc_nulls_first("y0"), "x0", "word_id")
    height = F.col("y1") - F.col("y0")
    rows = rows.select("*", F.lag("word_id").over(down).alias("again"), F.max(F.when(~F.isnan("confidence"), F.col("confidence"))).over(page).alias("best"), F.lag("y0").over(down).alias("above"))
    rows = rows.where((F.col("best") > 0) & (F.col("again").isNull() | (F.col("again") != F.col("word_id"))))
    starts = F.col("above").isNull() | (F.col("above") - F.col("y0") > F.lit(0.5) * height)
    rows = rows.withColumn("line", F.sum(starts.cast("int")).over(down))
    across = page.orderBy("line", "x0", "word_id")
    of = page.orderBy("line").rangeBetween(-1, -1)
    under = page.orderBy("line").rangeBetween(1, 1)
    rows = rows.select(
        "word_id", "doc_id", "page", "text", "line", "y0", "y1", "x0",
        F.lag("line").over(across).alias("p_line"), F.lead("line").over(across).alias("n_line"), F.lag("text").over(across).alias("before"), F.lead("text").over(across).alias("after"), F.lead("text", 2).over(across).alias("after2"),
        F.min("y0").over(of).alias("upper"), F.max("y1").over(under).alias("lower"),
    )
    if sizes is None:
        tall = F.lit(PAGE_HEIGHT)
    else:
        heights = sizes.where("height > 0 and not isnan(height)").groupBy("doc_id", "page").agg(F.max("height").alias("tall"))
        rows, tall = rows.join(heights, ["doc_id", "page"], "left"), F.coalesce("tall", F.lit(PAGE_HEIGHT))
    top = (F.col("y0") >= tall * 0.88) & (F.col("lower").isNull() | (F.col("y0") - F.col("lower") >= height))
    bottom = (F.col("y1") <= tall * 0.12) & (F.col("upper").isNull() | (F.col("upper") - F.col("y1") >= height))
    return rows.select(
        "word_id", "doc_id", "page", "text", "line", "x0", "before", "after", "after2",
        (F.col("p_line").isNull() | (F.col("p_line") != F.col("line"))).alias("first"), (F.col("n_line").isNull() | (F.col("n_line") != F.col("line"))).alias("last"), F.coalesce(top | bottom, F.lit(False)).alias("running"),
    )


#: Points; the height of a page whose own height is not at hand.
PAGE_HEIGHT = 792.0


def damaged_words(words: DataFrame, broadcast_rows: int = 500_000, sizes: DataFrame | None = None) -> DataFrame:
    """scanned_words() with broken (null, 'head' or 'tail'), joined (head and tail as one word), right (the core's correction by the collection, or null), shaped (where that is null and the word has an impossible shape: the word by its own characters), misread and running.

    The corrections are shipped to all executors only while there are at most
    ``broadcast_rows``; beyond that both sides are shuffled.
    """
    known = cut(vocabulary(words))
    right = cut(corrections(known))
    on_native = known.where("native > 0").select("w", F.lit(True).alias("native"))
    rows = scanned_words(words, sizes).withColumn("core", core("text"))
    small = right.count() <= broadcast_rows
    rows = rows.join(F.broadcast(right) if small else right, rows.core == right.w, "left").drop("w")
    hyphen = F.col("text").rlike(rf"[^\s{HYPHENS}][{HYPHENS}]$")
    goes_on = F.col("last") & hyphen & F.col("after").rlike(r"^[\p{L}\p{Nd}(@+|]") & ~F.col("running")
    ended = F.col("first") & F.col("before").rlike(rf"[^\s{HYPHENS}][{HYPHENS}]$") & F.col("text").rlike(r"^[\p{L}\p{Nd}(@+|]") & ~F.col("running")
    soft = F.col("text").rlike("­$")
    sign = (F.col("text") == "@") & F.col("after").rlike(r"^\p{L}") & ~F.coalesce(F.col("after2").rlike("^[0-9]"), F.lit(False))
    odd = F.col("text").rlike(NUMBER) | F.col("text").rlike(CODE) | (F.col("text").rlike(INSIDE) & ~F.col("text").rlike(NOT_INSIDE)) | sign
    return rows.select(
        "word_id", "doc_id", "page", "text", "line", "x0", "core", "running",
        F.when(goes_on & ~soft, F.lit("head")).when(ended & ~F.col("before").rlike("­$"), F.lit("tail")).alias("broken"),
        F.when(goes_on & ~soft, F.col("after")).alias("tail"), "right", F.when(F.col("right").isNull() & odd, reshaped("text")).alias("shaped"), (F.col("right").isNotNull() | odd).alias("misread"),
    )


def damaged(words: DataFrame, blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(tab, rec_id) of the words that are broken, misread or running, and of the blocks of the same pages whose text holds such a word, a broken line end or a running line."""
    rows = cut(damaged_words(words, sizes=sizes).where("broken is not null or misread or running"))
    hit = rows.select(F.lit("words").alias("tab"), F.col("word_id").alias("rec_id"))
    return hit.unionByName(damaged_blocks(rows, blocks, scanned_pages(words))).distinct()


def scanned_pages(words: DataFrame) -> DataFrame:
    return words.where("confidence > 0 and not isnan(confidence)").select("doc_id", "page").distinct()


def damaged_blocks(rows: DataFrame, blocks: DataFrame, pages: DataFrame) -> DataFrame:
    # The sets are as large as a page.
    misread = rows.where("misread").groupBy("doc_id", "page").agg(F.collect_set("text").alias("misread"))
    lines = rows.where("running").groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("l")).groupBy("doc_id", "page").agg(F.collect_set(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("lines"))
    text = blocks.where("text is not null").select("block_id", "doc_id", "page", "text").join(pages, ["doc_id", "page"], "left_semi")
    text = text.join(misread, ["doc_id", "page"], "left").join(lines, ["doc_id", "page"], "left")
    broken = F.col("text").rlike(r"[^\s\-¬‐][\-¬‐][ \t]*\r?\n[ \t]*[\p{L}\p{Nd}(@+|]")
    read = F.arrays_overlap(F.split("text", r"[ \t\r\n]+"), "misread")
    runs = F.exists("lines", lambda x: F.concat(F.lit("\n"), F.col("text"), F.lit("\n")).contains(F.concat(F.lit("\n"), x, F.lit("\n"))))
    hit = broken | F.coalesce(read, F.lit(False)) | F.coalesce(runs, F.lit(False))
    return text.where(hit).select(F.lit("blocks").alias("tab"), F.col("block_id").alias("rec_id"))


def repaired_paragraphs(words: DataFrame, blocks: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """(doc_id, page, block_no, kind, text) of the text blocks of scanned pages: running lines left out, line ends healed, misread words corrected.

    Where a word is broken the hyphen stays if the collection has the word with
    it more often than without. A block of running lines alone gives no row.
    Tables keep their lines.
    """
    rows = cut(damaged_words(words, sizes=sizes).where("broken is not null or misread or running"))
    known = vocabulary(words).select("w", "n")
    head = F.regexp_replace("text", f"[{HYPHENS}]$", "")
    pairs = rows.where("broken = 'head'").select("doc_id", "page", F.concat_ws(" ", "text", "tail").alias("k"), F.concat(head, "tail").alias("without"), F.concat(head, F.lit("-"), "tail").alias("with"))
    pairs = pairs.join(known.select(F.col("w").alias("a"), F.col("n").alias("a_n")), core("without") == F.col("a"), "left").join(known.select(F.col("w").alias("b"), F.col("n").alias("b_n")), core("with") == F.col("b"), "left")
    healed = pairs.select("doc_id", "page", "k", F.when(F.coalesce("b_n", F.lit(0)) > F.coalesce("a_n", F.lit(0)), F.col("with")).otherwise(F.col("without")).alias("v"))
    # A correction keeps what stands around the word, and its capital.
    marks = F.regexp_extract("text", r"^([\s\"'`“‘«„(\[{]*).*?([\s.,;:!?…\"'`”’»)\]}]*)$", 1), F.regexp_extract("text", r"([\s.,;:!?…\"'`”’»)\]}]*)$", 1)
    capital = F.substring(F.regexp_replace("text", r"^[\s\"'`“‘«„(\[{]+", ""), 1, 1)
    right = F.when(capital == F.upper(capital), F.when(F.lower(capital) != capital, F.concat(F.upper(F.substring("right", 1, 1)), F.expr("substring(right, 2)"))).otherwise(F.col("right"))).otherwise(F.col("right"))
    fixed = rows.where("right is not null").select("doc_id", "page", F.col("text").alias("k"), F.concat(marks[0], right, marks[1]).alias("v"))
    shaped = rows.where("shaped <> text").select("doc_id", "page", F.col("text").alias("k"), F.col("shaped").alias("v"))
    per_page = healed.unionByName(fixed).unionByName(shaped).groupBy("doc_id", "page").agg(F.collect_set(F.struct("k", "v")).alias("kv"))
    lines = rows.where("running").groupBy("doc_id", "page", "line").agg(F.array_sort(F.collect_list(F.struct("x0", "text"))).alias("l")).groupBy("doc_id", "page").agg(F.collect_set(F.array_join(F.transform("l", lambda x: x["text"]), " ")).alias("lines"))
    text = blocks.where("text is not null").select("doc_id", "page", "block_no", "kind", "text").distinct().join(scanned_pages(words), ["doc_id", "page"], "left_semi").join(per_page, ["doc_id", "page"], "left").join(lines, ["doc_id", "page"], "left")
    kept = F.filter(F.split("text", r"\r?\n"), lambda x: ~F.coalesce(F.array_contains("lines", x), F.lit(False)))
    tokens = F.filter(F.split(F.when(F.col("kind") == "table", F.array_join(kept, " \n ")).otherwise(F.array_join(kept, " ")), "[ ]+"), lambda x: x != "")

    def look(k: Column) -> Column:
        return F.try_element_at(F.filter("kv", lambda x: x["k"] == k), F.lit(1))["v"]

    def add(acc: Column, x: Column) -> Column:
        joined = look(F.concat_ws(" ", F.element_at(acc, -1), x))
        return F.when((F.size(acc) > 0) & joined.isNotNull(), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    whole = F.aggregate(tokens, F.array().cast("array<string>"), add)
    done = F.transform(whole, lambda x: F.coalesce(look(x), x))
    out = text.select("doc_id", "page", "block_no", "kind", F.regexp_replace(F.array_join(done, " "), " ?\n ?", "\n").alias("text"))
    return out.where("text <> ''")
