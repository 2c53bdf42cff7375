"""One form for text that looks the same but is written with different characters.

Texts that need it are exploded into positioned code points; a broadcast table
gives each its decomposition (canonical, and by width, spacing or ligature) or
drops it (invisible characters); a second one gives look-alike letters. Marks
are put in the order of their combining classes, composed again, and the
strings rebuilt. Other compatibility characters (superscripts, fractions,
signs) are ordinary and stay.
"""

from __future__ import annotations

import json
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.session import cut

SCRIPTS = ("latin", "cyrillic", "greek")

# Look-alike letters (fixed values): Cyrillic or Greek letter and the Latin one of the same look.
CYRILLIC = "АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵӏ"
CYRILLIC_LATIN = "ABESIJKMHOPCTYXaesijopcyxhdqwvl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανιρυχϳκ"
GREEK_LATIN = "ABEZHIKMNOPTYXoavipuxjk"
#: Latin letters that stand in for Cyrillic ones in a Cyrillic word, by look.
LATIN_CYRILLIC = dict(zip("ABEKMHOPCTYXaeopcyxSIJsij", "АВЕКМНОРСТУХаеорсухЅІЈѕіј", strict=True))
LATIN_GREEK = dict(zip("ABEZHIKMNOPTYXov", "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧον", strict=True))
#: Invisible characters that are dropped: zero-width, joiners, soft hyphen, byte-order mark, direction marks, variation selectors.
INVISIBLE = [0xAD, 0x34F, 0x61C, 0x180E, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), *range(0x2066, 0x206A), *range(0xFE00, 0xFE10), 0xFEFF]
WIDTH_TAGS = ("<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>")


def _steps(c: str) -> str:
    """The full decomposition of a character, through width, spacing, ligature and font variants as well as canonical ones."""
    out = ""
    for x in c:
        d = unicodedata.decomposition(x)
        tag, _, rest = d.partition(" ") if d.startswith("<") else ("", "", d)
        if not d or (tag and not (tag in WIDTH_TAGS and _plain(x, tag))):
            out += x
            continue
        out += _steps("".join(chr(int(p, 16)) for p in rest.split()))
    return out


def _plain(c: str, tag: str) -> bool:
    """Whether a compatibility character differs only in width, spacing or as a ligature."""
    code = ord(c)
    return tag in ("<wide>", "<narrow>", "<noBreak>", "<font>") or 0xFB00 <= code <= 0xFB06 or unicodedata.category(c) == "Zs"


def decompositions(spark: SparkSession) -> DataFrame:
    """(cp, parts): what each character becomes that does not stay as it is; some 4,000 rows whatever the data. Hangul syllables stay whole."""
    rows = []
    for code in [*range(0xA0, 0x3400), *range(0xF900, 0xFAE0), *range(0xFB00, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        parts = "" if code in INVISIBLE else " " if unicodedata.category(c) == "Zs" else _steps(c)
        if parts != c:
            rows.append((code, [ord(x) for x in parts]))
    return spark.createDataFrame(rows, "cp int, parts array<int>")


def letters(spark: SparkSession) -> DataFrame:
    """(cp, ccc, script, latin, cyrillic, greek): class of a combining mark; script of a letter and its look-alike in the others, itself in its own."""
    rows: dict[int, list] = {c: [unicodedata.combining(chr(c)), None, None, None, None] for c in range(0x300, 0x3100) if unicodedata.combining(chr(c))}
    for script, (first, last) in {"latin": (0x41, 0x250), "greek": (0x370, 0x400), "cyrillic": (0x400, 0x530)}.items():
        for c in range(first, last):
            if chr(c).isalpha() and not unicodedata.combining(chr(c)) and c not in (0xAA, 0xB5, 0xBA):
                rows[c] = [0, script, None, None, None]
                rows[c][2 + ("latin", "cyrillic", "greek").index(script)] = c
    for own, latin in ((CYRILLIC, CYRILLIC_LATIN), (GREEK, GREEK_LATIN)):
        for a, b in zip(own, latin, strict=True):
            rows[ord(a)][2] = ord(b)
    for at, table in ((3, LATIN_CYRILLIC), (4, LATIN_GREEK)):
        for a, b in table.items():
            rows[ord(a)][at] = ord(b)
    return spark.createDataFrame([(c, *v) for c, v in rows.items()], "cp int, ccc int, script string, latin int, cyrillic int, greek int")


def compositions() -> Column:
    """Canonical composites by "starter,mark"."""
    out = {}
    for code in [*range(0xC0, 0x3400), *range(0xF900, 0x10000)]:
        d = unicodedata.decomposition(chr(code))
        if d and not d.startswith("<") and len(d.split()) == 2 and unicodedata.normalize("NFC", chr(code)) == chr(code):
            a, b = (int(x, 16) for x in d.split())
            out[f"{a},{b}"] = code
    return F.from_json(F.lit(json.dumps(out)), "map<string,int>")


def _compose(points: Column) -> Column:
    """Code points of a starter and its ordered marks (arrays of struct(ccc, cp)), composed."""
    state = "struct<cur:int,out:array<int>,last:int>"
    pairs = compositions()

    def add(acc: Column, x: Column) -> Column:
        cp, ccc, cur = x["cp"], x["ccc"], acc["cur"]
        lead, vowel, tail, syllable = cur - 0x1100, cp - 0x1161, cp - 0x11A7, cur - 0xAC00
        hangul = F.when(lead.between(0, 18) & vowel.between(0, 20), F.lit(0xAC00) + (lead * 21 + vowel) * 28).when(syllable.between(0, 11171) & (syllable % 28 == 0) & tail.between(1, 27), cur + tail)
        free = F.when((F.size(acc["out"]) == 0) | (acc["last"] < ccc), F.try_element_at(pairs, F.concat_ws(",", cur, cp)))
        joined = F.coalesce(hangul, free)
        return (
            F.when(cur.isNull(), F.struct(cp.alias("cur"), acc["out"].alias("out"), F.lit(0).alias("last")))
            .when(joined.isNotNull(), F.struct(joined.alias("cur"), acc["out"].alias("out"), acc["last"].alias("last")))
            .otherwise(F.struct(cur.alias("cur"), F.concat(acc["out"], F.array(cp)).alias("out"), ccc.alias("last")))
            .cast(state)
        )

    start = F.struct(F.lit(None).alias("cur"), F.array().alias("out"), F.lit(0).alias("last")).cast(state)
    return F.aggregate(points, start, add, lambda acc: F.concat(F.array(acc["cur"]), acc["out"]))


#: A text of these characters alone, single spaces between words, is its own canonical form.
SIMPLE = r"^[!-~]+(?: [!-~]+)*$"
SPACES = r"[\t\n\x0B\f\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def canonical_texts(texts: DataFrame) -> DataFrame:
    """(text, canonical, alike) for the distinct texts of a one-column table ``text``.

    Spaces of every kind become one ordinary space; outer ones are dropped. In a
    word of several scripts all letters go to the one that has a look-alike for
    every foreign letter; of several such, the one with most letters there, and
    Latin where even. ``alike`` is true for a text with a word that is wholly
    Cyrillic or Greek and wholly of Latin look-alikes; ``latin_form`` has the text
    with such words in Latin. Only the collection can tell which was meant.
    A null text is left out; a text of nothing visible has the canonical form ''.
    """
    spark = texts.sparkSession
    word = texts.where("text is not null").repartition("text").select("text", F.posexplode(F.split("text", SPACES)).alias("w", "word")).where("word <> ''")
    cps = F.transform(F.split("word", ""), F.ascii)
    points = word.select("text", "w", F.posexplode(cps).alias("pos", "cp"))
    # Both tables have a fixed size, whatever the data.
    parts = points.join(F.broadcast(decompositions(spark)), "cp", "left").select("text", "w", "pos", F.posexplode(F.coalesce("parts", F.array("cp"))).alias("sub", "cp"))
    known = parts.join(F.broadcast(letters(spark)), "cp", "left").withColumn("ccc", F.coalesce("ccc", F.lit(0)))
    own = W.partitionBy("text", "w")
    n = {s: F.sum((F.col("script") == s).cast("int")).over(own) for s in SCRIPTS}
    fits = {s: F.sum((F.col("script").isNotNull() & F.col(s).isNull()).cast("int")).over(own) == 0 for s in SCRIPTS}
    begins = (F.col("ccc") == 0) & ~F.col("cp").between(0x1161, 0x1175) & ~F.col("cp").between(0x11A8, 0x11C2)
    judged = known.select("*", *(n[s].alias(f"n_{s}") for s in SCRIPTS), *(fits[s].alias(f"fits_{s}") for s in SCRIPTS), F.sum(begins.cast("int")).over(own.orderBy("pos", "sub")).alias("cluster"))
    score = {s: F.when(F.col(f"fits_{s}") & (F.col(f"n_{s}") > 0), F.col(f"n_{s}")).otherwise(0) for s in SCRIPTS}
    best = F.greatest(*score.values())
    target = F.when(best == 0, None).when(score["latin"] == best, F.lit("latin")).when(score["cyrillic"] == best, F.lit("cyrillic")).otherwise(F.lit("greek"))
    total = sum(F.coalesce(f"n_{s}", F.lit(0)) for s in SCRIPTS)
    mixed = best != total
    judged = judged.withColumn("target", F.when(mixed, target))
    letter = F.coalesce(*(F.when(F.col("target") == s, F.col(s)) for s in SCRIPTS), "cp")
    wholly = (F.coalesce("n_latin", F.lit(0)) == 0) & (total > 0) & F.col("fits_latin")
    point = F.struct("ccc", "pos", "sub", letter.alias("cp"))
    latin = F.struct("ccc", "pos", "sub", F.coalesce("latin", "cp").alias("cp"))
    cluster = judged.groupBy("text", "w", "cluster").agg(F.array_sort(F.collect_list(point)).alias("p"), F.array_sort(F.collect_list(latin)).alias("q"), F.first(wholly).alias("wholly"))

    def built(p: str) -> Column:
        return F.when(F.size(p) == 1, F.transform(p, lambda x: x["cp"])).otherwise(_compose(F.col(p)))

    string = lambda c: F.decode(F.unhex(F.array_join(F.transform(F.flatten(c), lambda x: F.lpad(F.hex(x), 8, "0")), "")), "UTF-32")
    in_order = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    clusters = cluster.select("text", "w", "cluster", "wholly", built("p").alias("own"), F.when(F.col("wholly"), built("q")).alias("as_latin"))
    words = clusters.groupBy("text", "w").agg(string(in_order("cluster", "own")).alias("own"), string(in_order("cluster", "as_latin")).alias("as_latin"), F.first("wholly").alias("wholly"))
    words = words.select("text", "w", "own", F.when(F.col("wholly"), F.col("as_latin")).otherwise(F.col("own")).alias("as_latin"), "wholly")
    found = words.groupBy("text").agg(F.array_join(in_order("w", "own"), " ").alias("canonical"), F.array_join(in_order("w", "as_latin"), " ").alias("latin_form"), F.max("wholly").alias("alike"))
    # Texts of nothing visible have no code points left.
    return texts.where("text is not null").select("text").distinct().join(found, "text", "left").select("text", F.coalesce("canonical", F.lit("")).alias("canonical"), F.coalesce("latin_form", F.lit("")).alias("latin_form"), F.coalesce("alike", F.lit(False)).alias("alike"))


def canonical_rows(rows: DataFrame, key: str = "rec_id") -> DataFrame:
    """(tab, key, text, canonical) of every row whose text is not in its one form; rows has tab, key, doc_id and text.

    Texts of plain characters are in their form already and are not touched.
    A text with words wholly of look-alikes goes to Latin when its Latin form is
    a text of the collection at least three times, and more often than it stands,
    and its file has more Latin than other words. Re-sent rows count once.
    """
    odd = rows.where("text is not null").where(~F.col("text").rlike(SIMPLE)).select("tab", key, "doc_id", "text")
    forms = cut(canonical_texts(odd.select("text").distinct()))  # read by several steps
    found = odd.join(forms, "text")
    alike = cut(odd.join(forms.where("alike and latin_form <> text"), "text").select("doc_id", "text", "canonical", "latin_form").distinct())
    if alike.isEmpty():
        return found.where("canonical <> text").select("tab", key, "text", "canonical").dropDuplicates(["tab", key])
    asked = alike.select(F.lower("latin_form").alias("t")).union(alike.select(F.lower("canonical"))).distinct()
    counts = rows.select(F.lower("text").alias("t")).join(asked, "t", "left_semi").groupBy("t").agg(F.count("*").alias("n"))
    scripts = (
        rows.join(alike.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.sum(F.col("text").rlike(r"^\W*[A-Za-z]").cast("int")).alias("latin"), F.sum(F.col("text").rlike("[\u0400-\u04FF\u0370-\u03FF]").cast("int")).alias("other"))
    )
    meant = (
        alike.withColumn("t", F.lower("latin_form")).withColumn("o", F.lower("canonical"))
        .join(counts.withColumnRenamed("n", "n_latin"), "t").join(counts.select(F.col("t").alias("o"), F.col("n").alias("n_own")), "o", "left").join(scripts, "doc_id")
        .where("n_latin >= 3 and n_latin > coalesce(n_own, 0) and latin > other")
        .select("doc_id", "text", F.col("latin_form").alias("chosen"))
    )
    done = found.join(meant, ["doc_id", "text"], "left").withColumn("canonical", F.coalesce("chosen", "canonical"))
    return done.where("canonical <> text").select("tab", key, "text", "canonical").dropDuplicates(["tab", key])
