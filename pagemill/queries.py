"""The queries of the core operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.functions import formats, text
from pagemill.operators import blocks as block_ops
from pagemill.operators import layout, routing, trees
from pagemill.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
SPACE = text.SPACE


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


# --- text -----------------------------------------------------------------

LINES = "SELECT DISTINCT block_id, i AS line_no, string_split(text, chr(10))[i] AS line, string_split(text, chr(10))[i + 1] AS following FROM (SELECT DISTINCT block_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM blocks WHERE text IS NOT NULL)"
MARKED = "SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM (SELECT doc_id, array_to_string([text, '1.', 'a)', '  2)x', '- ', '12. y', '1234. z', 'ab. q'], chr(10)) AS text FROM documents WHERE text IS NOT NULL))"
DOC_LINES = "SELECT doc_id, i AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)"


def _trimmed(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def _block_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "blocks").where("text is not null").select("block_id", "text").distinct()
    parts = F.split("text", "\n")
    following = F.try_element_at(parts, F.col("pos") + 2)
    return rows.select("block_id", parts.alias("parts"), F.posexplode(parts).alias("pos", "line")).select("block_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line", F.try_element_at("parts", F.col("pos") + 2).alias("following"))


@query(f"SELECT block_id, line_no, regexp_replace(regexp_replace(lower(line), '\\p{{Nd}}', '#', 'g'), '{SPACE}+', '', 'g') AS key FROM ({LINES})")
def furniture_key(spark: SparkSession, folder: str) -> DataFrame:
    return _block_lines(spark, folder).select("block_id", "line_no", text.furniture_key("line").alias("key"))


@query(
    f"WITH t AS (SELECT doc_id, line_no, {_trimmed('line')} AS t FROM ({MARKED})), m AS (SELECT *, regexp_extract(t, '^([-*•◦▪·–—]) ', 1) AS b, regexp_extract(t, '^([0-9]{{1,3}}[.)]|[A-Za-z][.)])', 1) AS e FROM t)"
    f" SELECT doc_id, line_no, CASE WHEN b <> '' THEN b ELSE e END AS marker, CASE WHEN b <> '' THEN {_trimmed('substr(t, 2)')} ELSE {_trimmed('substr(t, length(e) + 1)')} END AS rest, b = '' AS ordered FROM m WHERE b <> '' OR (e <> '' AND {_trimmed('substr(t, length(e) + 1)')} <> '')"
)
def list_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Of the lines of each document, and of some more after its end."""
    lines = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\n1.\na)\n  2)x\n- \n12. y\n1234. z\nab. q")), "\n")).alias("pos", "line")).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")
    return lines.select("doc_id", "line_no", text.list_marker("line").alias("m")).where("m is not null").select("doc_id", "line_no", "m.*")


@query(f"SELECT block_id, line_no, CASE WHEN line LIKE '%-' AND regexp_matches(following, '^[a-z\\x{{800}}-\\x{{10FFFF}}]') THEN substr(line, 1, length(line) - 1) || following ELSE line || ' ' || following END AS joined FROM ({LINES}) WHERE following IS NOT NULL")
def join_wrapped(spark: SparkSession, folder: str) -> DataFrame:
    return _block_lines(spark, folder).where("following is not null").select("block_id", "line_no", text.join_wrapped("line", "following").alias("joined"))


GARBLED = f"contains(text, '(cid:') OR (length(regexp_replace(text, '{SPACE}', '', 'g')) >= 16 AND length(regexp_replace(text, '{SPACE}', '', 'g')) - length(regexp_replace(regexp_replace(text, '{SPACE}', '', 'g'), '[\\x{{FFFD}}\\x{{E000}}-\\x{{F8FF}}\\p{{Cc}}]', '', 'g')) >= 0.2 * length(regexp_replace(text, '{SPACE}', '', 'g')))"


@query(f"SELECT doc_id, page, {GARBLED} AS garbled FROM (SELECT doc_id, page, string_agg(text, ' ' ORDER BY seq) AS text FROM (SELECT DISTINCT doc_id, page, seq, text FROM words WHERE text IS NOT NULL) GROUP BY ALL)")
def garbled_text(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "words").where("text is not null").select("doc_id", "page", "seq", "text").distinct()
    pages = words.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), " ").alias("text"))
    return pages.select("doc_id", "page", text.is_garbled("text").alias("garbled"))


@query(
    "WITH t AS (SELECT DISTINCT doc_id, replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace('<p>' || replace(text, chr(10), '</p><div>&nbsp;&amp;lt;') || '</div>', '(?i)<(?:br|/p|/div|/tr)[^<>]*>?', '>' || chr(10), 'g'), '<[^<>]*>?', '', 'g'), '>', '', 'g'),"
    f" '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS t FROM documents WHERE text IS NOT NULL)"
    f" SELECT doc_id, array_to_string(list_filter(list_transform(string_split(t, chr(10)), lambda x: {_trimmed('x')}), lambda x: x <> ''), chr(10)) AS text FROM t"
)
def strip_html(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.concat(F.lit("<p>"), F.replace("text", F.lit("\n"), F.lit("</p><div>&nbsp;&amp;lt;")), F.lit("</div>")).alias("html")).distinct()
    return rows.select("doc_id", text.strip_html("html").alias("text"))


@query("SELECT DISTINCT cell_id, replace(replace(replace(text, '|', '\\|'), chr(13) || chr(10), chr(10)), chr(10), '<br>') AS escaped FROM cells")
def escape_cell(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "cells").select("cell_id", text.escape_cell("text").alias("escaped")).distinct()


@query("SELECT DISTINCT cell_id, ref, col_no AS column_no FROM (SELECT *, CASE WHEN col_no < 26 THEN chr(65 + col_no) ELSE chr(64 + col_no // 26) || chr(65 + col_no % 26) END || (row_no + 1) AS ref FROM cells WHERE col_no IS NOT NULL AND row_no IS NOT NULL)")
def column_index(spark: SparkSession, folder: str) -> DataFrame:
    letter = lambda n: F.char(n + 65)
    ref = F.concat(F.when(F.col("col_no") < 26, letter(F.col("col_no"))).otherwise(F.concat(F.char(F.floor(F.col("col_no") / 26) + 64), letter(F.col("col_no") % 26))), (F.col("row_no") + 1).cast("string"))
    return table(spark, folder, "cells").where("col_no is not null and row_no is not null").select("cell_id", ref.alias("ref")).distinct().select("cell_id", "ref", text.column_index("ref").alias("column_no"))


# --- formats --------------------------------------------------------------

# Written out once more, so that a wrong entry of the operator's table shows (fixed values).
NAMED = """CASE lower(regexp_extract({0}, '\\.([^./\\\\]+)$', 1))
 WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'docm' THEN 'docx' WHEN 'xlsx' THEN 'xlsx' WHEN 'xlsm' THEN 'xlsx' WHEN 'pptx' THEN 'pptx' WHEN 'pptm' THEN 'pptx' WHEN 'odt' THEN 'odt' WHEN 'ods' THEN 'ods' WHEN 'odp' THEN 'odp'
 WHEN 'rtf' THEN 'rtf' WHEN 'doc' THEN 'doc' WHEN 'xls' THEN 'xls' WHEN 'ppt' THEN 'ppt' WHEN 'msg' THEN 'msg' WHEN 'png' THEN 'png' WHEN 'jpg' THEN 'jpeg' WHEN 'jpeg' THEN 'jpeg' WHEN 'gif' THEN 'gif' WHEN 'tif' THEN 'tiff' WHEN 'tiff' THEN 'tiff'
 WHEN 'bmp' THEN 'bmp' WHEN 'webp' THEN 'webp' WHEN 'zip' THEN 'zip' WHEN 'eml' THEN 'eml' WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'txt' WHEN 'csv' THEN 'txt' WHEN 'tsv' THEN 'txt' WHEN 'json' THEN 'txt' WHEN 'log' THEN 'txt' ELSE '' END"""


def _named(column: str) -> str:
    return NAMED.replace("{0}", column)


#: Suffixes that are given to the names of the roots in turn, known ones and others.
SUFFIXES = "docm XLSM pptm text xml html htm Md json log tif jpeg JPG webp ods odp rtf msg eml bin pdf gz none".split()
SUFFIXED = "SELECT DISTINCT root_id, name, CASE WHEN root_id % 2 = 0 THEN name ELSE name || '.' || [" + ", ".join(f"'{x}'" for x in SUFFIXES) + f"][(root_id // 2) % {len(SUFFIXES)} + 1] END AS given FROM roots"


@query(f"SELECT root_id AS id, given, {_named('given')} AS by_name FROM ({SUFFIXED})")
def format_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Every other root's name with one more suffix."""
    n = F.col("root_id")
    given = F.when(n % 2 == 0, F.col("name")).otherwise(F.concat("name", F.lit("."), F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.floor(n / 2) % len(SUFFIXES) + 1).cast("int"))))
    rows = table(spark, folder, "roots").select("root_id", "name").distinct()
    return rows.select(F.col("root_id").alias("id"), given.alias("given")).withColumn("by_name", formats.format_by_name("given"))


SNIFF = (
    "CASE WHEN data IS NULL OR octet_length(data) = 0 THEN '' WHEN hex(data) LIKE '255044462D%' THEN 'pdf' WHEN hex(data) LIKE '89504E470D0A1A0A%' THEN 'png' WHEN hex(data) LIKE 'FFD8FF%' THEN 'jpeg' WHEN hex(data) LIKE '47494638__61%' THEN 'gif' WHEN hex(data) LIKE '49492A00%' OR hex(data) LIKE '4D4D002A%' THEN 'tiff' WHEN hex(data) LIKE '7B5C727466%' THEN 'rtf'"
    " WHEN hex(data) LIKE 'D0CF11E0A1B11AE1%' THEN 'ole' WHEN hex(data) LIKE '504B0304%' THEN 'zip' WHEN contains(hex(data[1:1024]), '255044462D') THEN 'pdf' WHEN mail THEN 'eml' WHEN NOT regexp_matches(hex(data[1:512]), '^(?:..)*00') THEN 'txt' ELSE '' END"
)
MAIL = (
    "SELECT DISTINCT child_id, name, data, CASE WHEN head LIKE 'From %' THEN regexp_matches(string_split(head, chr(10))[2], '^[A-Za-z0-9-]+:') WHEN contains(head, 'MIME-Version:') OR contains(head, 'Content-Type:') THEN regexp_matches(head, '^[A-Za-z0-9-]+:')"
    " ELSE contains(head, 'From:')::INT + contains(head, 'To:')::INT + contains(head, 'Subject:')::INT + contains(head, 'Message-ID:')::INT + contains(head, 'Date:')::INT + contains(head, 'Received:')::INT >= 2 AND regexp_matches(head, '^[A-Za-z0-9-]+:') END AS mail FROM (SELECT *, CASE WHEN hex(data) LIKE '255044462D%' OR hex(data) LIKE '89504E47%' THEN '' ELSE left(decode(data), 4096) END AS head FROM children)"
)


@query(f"SELECT child_id, sniffed, CASE WHEN sniffed = 'txt' AND named <> '' THEN named WHEN sniffed <> '' THEN sniffed ELSE named END AS detected FROM (SELECT child_id, {SNIFF} AS sniffed, {_named('name')} AS named FROM ({MAIL}))")
def detect_format(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "children").select("child_id", "name", "data").dropDuplicates(["child_id"])
    return rows.select("child_id", formats.sniff("data").alias("sniffed"), formats.detect_format("data", "name").alias("detected"))


#: Bytes (hexadecimal), a name, and what they are by content, and by content and name: cases that the tables do not have.
EDGES = [
    ("504B0506" + "00" * 18, "empty.zip", "", "zip"), ("504B0304", "a.docx", "zip", "zip"), ("424D" + "46000000" + "00000000" + "36000000" + "28000000" + "00" * 8, "x", "bmp", "bmp"), ("424D" + "46000000" + "00000000" + "36000000" + "28000000", "x", "", ""),
    ("424D" + "46000000" + "01000000" + "36000000" + "28000000" + "00" * 8, "x.bmp", "", "bmp"), ("424D492C68656967687420696E20636D2C6E616D650A", "bmi.csv", "txt", "txt"), ("C3", "cut", "txt", "txt"), ("61E282", "cut", "txt", "txt"), ("61FF626364", "bad", "", ""), ("61FF6263", "bad", "txt", "txt"), ("61FF62", "short", "txt", "txt"),
    ("6100", "nul.txt", "", "txt"), ("68656C6C6F", "letter.docx", "txt", "docx"), ("68656C6C6F", "scan.pdf", "txt", "pdf"), ("68656C6C6F", "page.html", "txt", "txt"), ("68656C6C6F", "note.rtf", "txt", "rtf"), ("7B5C72746631", "a.doc", "rtf", "rtf"), ("D0CF11E0A1B11AE1", "a.XLS", "ole", "xls"), ("D0CF11E0A1B11AE1", "a.msg", "ole", "msg"),
    ("D0CF11E0A1B11AE1", "a.docx", "ole", "ole"), ("0A0A255044462D", "x", "pdf", "pdf"), ("52494646" + "00000000" + "57454250", "x", "webp", "webp"), ("52494646" + "00000000" + "57415645", "x.webp", "", "webp"), ("", "a.pptm", "", "pptx"), ("46726F6D206D650A583A2079", "box", "eml", "eml"), ("46726F6D206D650A78", "memo", "txt", "txt"),
    ("546F3A20610A446174653A20620A", "x", "eml", "eml"), ("546F3A20610A", "x", "txt", "txt"), ("782D793A20610A4D494D452D56657273696F6E3A20312E30", "x", "eml", "eml"), ("20546F3A20610A446174653A20620A", "x.eml", "txt", "eml"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{h}', '{n}', '{s}', '{d}')" for h, n, s, d in EDGES) + ") AS t(bytes, name, sniffed, detected)")
def detect_edges(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.createDataFrame([(h, n) for h, n, _, _ in EDGES], "bytes string, name string").withColumn("data", F.unhex("bytes"))
    return rows.select("bytes", "name", formats.sniff("data").alias("sniffed"), formats.detect_format("data", "name").alias("detected"))


@query("SELECT DISTINCT doc_id, file_format, file_format IN ('png', 'jpeg', 'gif', 'tiff', 'bmp', 'webp') AS is_image, file_format IN ('docx', 'xlsx', 'pptx', 'odt', 'ods', 'odp', 'rtf', 'doc', 'xls', 'ppt') AS is_office, CASE file_format WHEN '' THEN '' WHEN 'jpeg' THEN '.jpg' WHEN 'ole' THEN '.bin' ELSE '.' || file_format END AS ext FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'ole' ELSE file_format END AS file_format FROM files WHERE file_format IS NOT NULL)")
def format_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Three files in four as unknown, jpeg and ole files, which the table has few of."""
    n = F.col("doc_id") % 4
    rows = table(spark, folder, "files").where("file_format is not null").select("doc_id", F.when(n == 0, "").when(n == 1, "jpeg").when(n == 2, "ole").otherwise(F.col("file_format")).alias("file_format")).distinct()
    return rows.select("doc_id", "file_format", F.col("file_format").isin(formats.IMAGES).alias("is_image"), F.col("file_format").isin(formats.OFFICE).alias("is_office"), formats.extension("file_format").alias("ext"))


# --- layout ---------------------------------------------------------------

WORDS = "SELECT doc_id, page, seq, text, x0, y0, x1, y1, coalesce(font_size, 0) AS font_size, confidence FROM words WHERE text IS NOT NULL AND x0 IS NOT NULL AND y0 IS NOT NULL AND x1 IS NOT NULL AND y1 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id, page, seq) = 1"
# Lines of the test pages are farther apart than half a line, so that a gap alone tells them.
PLACED = f"SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, x0, seq) - 1 AS line_no FROM (SELECT *, CASE WHEN lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, x0, seq) - y0 > 5 OR lag(y0) OVER (PARTITION BY doc_id, page ORDER BY y1 DESC, x0, seq) IS NULL THEN 1 ELSE 0 END AS s FROM ({WORDS}))"
SIZES = f"SELECT doc_id, page, line_no, coalesce((SELECT max(struct_pack(n := n, size := size)).size FROM (SELECT count(*) AS n, size FROM (SELECT unnest(sizes) AS size) WHERE size > 0 GROUP BY size)), y1 - y0) AS size, n_words, x0, y0, x1, y1, text FROM (SELECT doc_id, page, line_no, list(font_size) AS sizes, count(*) AS n_words, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, ' ' ORDER BY x0, seq) AS text FROM ({PLACED}) GROUP BY ALL)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.group_lines(table(spark, folder, "words"))


def _size() -> Column:
    return layout.line_size(F.col("words"), F.col("y0"), F.col("y1"))


@query(f"SELECT doc_id, page, line_no::INT AS line_no, count(*)::INT AS n_words, string_agg(text, ' ' ORDER BY x0, seq) AS text FROM ({PLACED}) GROUP BY ALL")
def group_lines(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "page", "line_no", "n_words", "text")


@query(f"SELECT doc_id, page, line_no::INT AS line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({PLACED}) GROUP BY ALL")
def line_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "page", "line_no", "x0", "y0", "x1", "y1")


@query(f"SELECT doc_id, page, line_no::INT AS line_no, round(size, 6) AS size FROM ({SIZES})")
def line_font_mode(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "page", "line_no", F.round(_size(), 6).alias("size"))


@query(f"SELECT doc_id, page, round(s[len(s) // 2 + 1], 6) AS body FROM (SELECT doc_id, page, list(size ORDER BY size) AS s FROM (SELECT doc_id, page, size, unnest(range(n_words)) FROM ({SIZES})) GROUP BY ALL)")
def body_text_size(spark: SparkSession, folder: str) -> DataFrame:
    return layout.body_size(_lines(spark, folder)).select("doc_id", "page", F.round("body", 6).alias("body"))


@query(f"SELECT doc_id, string_agg(t, chr(12) ORDER BY page) AS text FROM (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY line_no) AS t FROM ({SIZES}) GROUP BY ALL) GROUP BY ALL")
def document_text(spark: SparkSession, folder: str) -> DataFrame:
    return layout.document_text(_lines(spark, folder))


BODY = f"SELECT doc_id, page, s[len(s) // 2 + 1] AS body FROM (SELECT doc_id, page, list(size ORDER BY size) AS s FROM (SELECT doc_id, page, size, unnest(range(n_words)) FROM ({SIZES})) GROUP BY ALL)"


@query(f"SELECT * FROM (SELECT doc_id, page, line_no::INT AS line_no, CASE WHEN n_words > 14 OR text LIKE '%.' OR body <= 0 THEN NULL WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.45 THEN 2 WHEN size / body >= 1.25 THEN 3 WHEN size / body >= 1.15 THEN 4 END AS level FROM (SELECT * REPLACE ({_trimmed('text')} AS text) FROM ({SIZES})) JOIN ({BODY}) USING (doc_id, page) WHERE text <> '') WHERE level IS NOT NULL")
def heading_levels(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder)
    sized = lines.select("doc_id", "page", "line_no", "n_words", "text", _size().alias("size"))
    return sized.join(layout.body_size(lines), ["doc_id", "page"]).select("doc_id", "page", "line_no", text.heading_level("n_words", "text", "size", "body").alias("level")).where("level is not null")


@query(
    f"WITH s AS (SELECT * FROM ({SIZES})), p AS (SELECT *, lag(x0) OVER w AS px0, lag(y0) OVER w AS py0, lag(y1) OVER w AS py1, lag(size) OVER w AS psize FROM s WINDOW w AS (PARTITION BY doc_id, page ORDER BY line_no))"
    " SELECT doc_id, page, line_no::INT AS line_no, NOT coalesce(py0 - y1 >= 0 AND py0 - y1 <= 1.8::DOUBLE * (py1 - py0) AND NOT (abs(x0 - px0) > 14 AND x0 < px0) AND abs(size - psize) <= 0.5::DOUBLE, false) AS breaks FROM p"
)
def paragraph_breaks(spark: SparkSession, folder: str) -> DataFrame:
    return layout.paragraph_breaks(_lines(spark, folder))


@query(
    f"WITH s AS (SELECT p.*, z.size FROM ({PLACED}) p JOIN ({SIZES}) z USING (doc_id, page, line_no)), g AS (SELECT *, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc_id, page, line_no ORDER BY x0, seq) >= greatest(18, 1.5::DOUBLE * size) THEN 1 ELSE 0 END AS s2 FROM s),"
    " c AS (SELECT *, sum(s2) OVER (PARTITION BY doc_id, page, line_no ORDER BY x0, seq) AS cell_no FROM g) SELECT doc_id, page, line_no::INT AS line_no, cell_no::INT AS cell_no, string_agg(text, ' ' ORDER BY x0, seq) AS text, min(x0) AS x0, max(struct_pack(a := x0, b := seq, c := x1)).c AS x1 FROM c GROUP BY ALL"
)
def split_cells(spark: SparkSession, folder: str) -> DataFrame:
    return layout.split_cells(_lines(spark, folder))


@query(
    f"WITH p AS (SELECT DISTINCT doc_id, page, height FROM page_complexity), n AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY ALL), k AS (SELECT DISTINCT doc_id, page, regexp_replace(regexp_replace(lower(text), '\\p{{Nd}}', '#', 'g'), '{SPACE}+', '', 'g') AS key FROM ({SIZES}) JOIN p USING (doc_id, page)"
    " WHERE height > 0 AND (y0 >= height - 0.12::DOUBLE * height OR y1 <= 0.12::DOUBLE * height)) SELECT doc_id, key, count(*) AS n_pages FROM k JOIN n USING (doc_id) WHERE key <> '' AND pages >= 3 GROUP BY doc_id, key, pages HAVING count(*) >= ceil(pages * 0.6::DOUBLE)"
)
def repeated_edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return layout.repeated_edge_lines(_lines(spark, folder), table(spark, folder, "page_complexity"))


TWO = f"SELECT * REPLACE (x0 + CASE WHEN x0 > 300 THEN 110 ELSE 0 END AS x0, x1 + CASE WHEN x0 > 300 THEN 110 ELSE 0 END AS x1) FROM ({WORDS})"


@query(
    f"WITH e AS (SELECT doc_id, page, min(x0) AS l, max(x1) AS r FROM ({TWO}) GROUP BY ALL), n AS (SELECT *, floor((r - l) / 4)::INT + 1 AS n FROM e), ink AS (SELECT DISTINCT doc_id, page, unnest(range(floor((x0 - l) / 4)::INT, floor((x1 - l) / 4)::INT + 1)) AS b FROM ({TWO}) JOIN n USING (doc_id, page)),"
    " mid AS (SELECT doc_id, page, l, unnest(range(floor(0.2::DOUBLE * n)::INT, floor(0.8::DOUBLE * n)::INT + 1)) AS b FROM n), blank AS (SELECT * FROM mid ANTI JOIN ink USING (doc_id, page, b)), isl AS (SELECT *, b - row_number() OVER (PARTITION BY doc_id, page ORDER BY b) AS g FROM blank),"
    " runs AS (SELECT doc_id, page, l, min(b) AS a, count(*) AS c FROM isl GROUP BY doc_id, page, l, g) SELECT doc_id, page, l + a * 4 AS start, l + (a + c) * 4 AS stop FROM runs WHERE c * 4 >= 24 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY c DESC, a) = 1"
)
def find_gutter(spark: SparkSession, folder: str) -> DataFrame:
    """The words right of 300 points moved 110 to the right, as a second column."""
    right = F.when(F.col("x0") > 300, 110.0).otherwise(0.0)
    words = table(spark, folder, "words").withColumns({"x0": F.col("x0") + right, "x1": F.col("x1") + right})
    return layout.find_gutter(layout.group_lines(words))


@query(f"WITH s AS (SELECT * FROM ({WORDS})) SELECT doc_id, page, seq, (SELECT i FROM (SELECT unnest(range(0, 5)) AS i) ORDER BY abs(72 + 110 * i - x0), i LIMIT 1)::INT AS anchor FROM s")
def nearest_anchor(spark: SparkSession, folder: str) -> DataFrame:
    anchors = F.array(*(F.lit(72.0 + 110 * i) for i in range(5)))
    return layout.distinct_words(table(spark, folder, "words")).select("doc_id", "page", "seq", layout.nearest_anchor(anchors, F.col("x0")).alias("anchor"))


@query()
def blocks_of_words(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain: lines, furniture, reading order, classification."""
    return block_ops.blocks(table(spark, folder, "words"), table(spark, folder, "page_complexity")).select("doc_id", "page", "block_no", "kind", "text", "level", "ordered", "marker")


# Lines without running ones, with what each says by itself.
KEPT = (
    "WITH p AS (SELECT DISTINCT doc_id, page, height FROM page_complexity), np AS (SELECT doc_id, count(*) AS pages FROM p GROUP BY ALL), s AS (SELECT * FROM (" + SIZES + ") LEFT JOIN p USING (doc_id, page)), k AS (SELECT *, regexp_replace(regexp_replace(lower(text), '\\p{Nd}', '#', 'g'), '" + SPACE + "+', '', 'g') AS key, coalesce(height > 0 AND (y0 >= height - 0.12::DOUBLE * height OR y1 <= 0.12::DOUBLE * height), false) AS edge FROM s),"
    " again AS (SELECT doc_id, key FROM (SELECT DISTINCT doc_id, page, key FROM k WHERE edge AND key <> '') JOIN np USING (doc_id) WHERE pages >= 3 GROUP BY doc_id, key, pages HAVING count(*) >= ceil(pages * 0.6::DOUBLE)),"
    " l AS (SELECT * FROM k WHERE NOT (edge AND EXISTS (SELECT 1 FROM again WHERE again.doc_id = k.doc_id AND again.key = k.key)))"
)


@query(
    KEPT.replace("WITH p AS", "WITH RECURSIVE p AS", 1)
    + f", wide AS (SELECT DISTINCT doc_id, page FROM (SELECT w.doc_id, w.page, w.line_no, x0 - lag(x1) OVER (PARTITION BY w.doc_id, w.page, w.line_no ORDER BY w.x0, w.seq) AS gap, l.size FROM ({PLACED}) w JOIN (SELECT doc_id, page, line_no, size FROM l) l USING (doc_id, page, line_no)) WHERE gap >= least(24, greatest(18, 1.5::DOUBLE * size))),"
    " b AS (SELECT doc_id, page, z[len(z) // 2 + 1] AS body FROM (SELECT doc_id, page, list(size ORDER BY size) AS z FROM (SELECT doc_id, page, size, unnest(range(n_words)) FROM l) GROUP BY ALL)),"
    f" m AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS n, x0, y0, y1, size, text, regexp_extract({_trimmed('text')}, '^([-*•◦▪·–—]) ', 1) AS bullet, regexp_extract({_trimmed('text')}, '^([0-9]{{1,3}}[.)]|[A-Za-z][.)])', 1) AS number, {_trimmed('text')} AS t, CASE WHEN n_words > 14 OR {_trimmed('text')} LIKE '%.' OR body <= 0 THEN NULL WHEN size / body >= 1.8 THEN 1 WHEN size / body >= 1.45 THEN 2 WHEN size / body >= 1.25 THEN 3 WHEN size / body >= 1.15 THEN 4 END AS lvl FROM l JOIN b USING (doc_id, page) ANTI JOIN wide USING (doc_id, page)),"
    f" q AS (SELECT doc_id, page, n, x0, y0, y1, size, text, lvl, CASE WHEN bullet <> '' THEN bullet WHEN number <> '' AND {_trimmed('substr(t, length(number) + 1)')} <> '' THEN number END AS marker, {_trimmed('substr(t, length(bullet || number) + 1)')} AS rest, bullet = '' AS ordered FROM m),"
    " r AS (SELECT *, 0 AS block_no, CASE WHEN marker IS NOT NULL THEN 'list_item' WHEN lvl IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN marker IS NOT NULL THEN rest ELSE text END AS so_far, marker AS bm, CASE WHEN marker IS NOT NULL THEN ordered END AS bo, CASE WHEN marker IS NULL THEN lvl END AS bl, x0 AS bx FROM q WHERE n = 1 UNION ALL"
    " SELECT doc_id, page, n, x0, y0, y1, size, text, lvl, marker, rest, ordered, CASE WHEN goes THEN block_no ELSE block_no + 1 END, CASE WHEN goes THEN kind WHEN marker IS NOT NULL THEN 'list_item' WHEN lvl IS NOT NULL THEN 'heading' ELSE 'paragraph' END,"
    " CASE WHEN NOT goes THEN CASE WHEN marker IS NOT NULL THEN rest ELSE text END WHEN so_far LIKE '%-' AND regexp_matches(text, '^[a-z\\x{800}-\\x{10FFFF}]') THEN substr(so_far, 1, length(so_far) - 1) || text ELSE so_far || ' ' || text END,"
    " CASE WHEN goes THEN bm ELSE marker END, CASE WHEN goes THEN bo WHEN marker IS NOT NULL THEN ordered END, CASE WHEN goes THEN bl WHEN marker IS NULL THEN lvl END, CASE WHEN goes THEN bx ELSE x0 END FROM (SELECT q.*, block_no, kind, so_far, bm, bo, bl, bx, r.kind <> 'heading' AND r.y0 - q.y1 >= 0 AND r.y0 - q.y1 <= 1.8::DOUBLE * (r.y1 - r.y0) AND NOT (abs(q.x0 - r.x0) > 14 AND q.x0 < r.x0) AND abs(q.size - r.size) <= 0.5::DOUBLE"
    " AND q.marker IS NULL AND CASE WHEN r.kind = 'list_item' THEN q.x0 > bx ELSE q.lvl IS NULL END AS goes FROM r JOIN q ON q.doc_id = r.doc_id AND q.page = r.page AND q.n = r.n + 1))"
    " SELECT doc_id, page, block_no, kind, text, level, ordered, marker FROM (SELECT doc_id, page, block_no, kind, so_far AS text, bl AS level, bo AS ordered, bm AS marker, n FROM r) QUALIFY row_number() OVER (PARTITION BY doc_id, page, block_no ORDER BY n DESC) = 1"
)
def blocks_of_plain_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The whole chain on pages of which no line has a gap as wide as between cells or columns."""
    words, heights = table(spark, folder, "words"), table(spark, folder, "page_complexity")
    lines = block_ops.drop_furniture(layout.group_lines(words), heights)
    gaps = F.transform("words", lambda w, i: w["x0"] - F.when(i > 0, F.try_element_at("words", i)["x1"]))
    wide = lines.where(F.exists(gaps, lambda g: g >= F.least(F.lit(24.0), F.greatest(F.lit(18.0), 1.5 * _size())))).select("doc_id", "page").distinct()
    return block_ops.blocks(words, heights).join(wide, ["doc_id", "page"], "left_anti").select("doc_id", "page", "block_no", "kind", "text", "level", "ordered", "marker")


# --- routing and recognition -----------------------------------------------

PAGES = "SELECT * FROM page_complexity QUALIFY row_number() OVER (PARTITION BY doc_id, page) = 1"
REASONS = (
    "list_filter([CASE WHEN coalesce(full_page_image, false) AND coalesce(text_coverage, 0) < 0.02 THEN 'scanned' WHEN coalesce(text_length, 0) < 16 THEN 'no-text' WHEN coalesce(text_coverage, 0) < 0.03 AND coalesce(image_count, 0) > 0 THEN 'sparse-text' END,"
    " CASE WHEN NOT (coalesce(full_page_image, false) AND coalesce(text_coverage, 0) < 0.02) AND coalesce(image_coverage, 0) >= 0.15 THEN 'embedded-images' END, CASE WHEN coalesce(garbled, false) THEN 'garbled' END], lambda x: x IS NOT NULL)"
)


def _routed(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "page_complexity").dropDuplicates(["doc_id", "page"]).withColumn("why", routing.ocr_reasons("text_length", "text_coverage", "image_count", "image_coverage", "full_page_image", "garbled"))


@query(f"SELECT doc_id, page, array_to_string({REASONS}, ',') AS reasons, len({REASONS}) > 0 AS needs_ocr FROM ({PAGES})")
def ocr_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _routed(spark, folder).select("doc_id", "page", F.array_join("why", ",").alias("reasons"), (F.size("why") > 0).alias("needs_ocr"))


@query(f"SELECT doc_id, bool_or(len(r) > 0) AS needs_ocr, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (len(r) > 0), '') AS pages FROM (SELECT doc_id, page, {REASONS} AS r FROM ({PAGES})) GROUP BY ALL")
def ocr_pages(spark: SparkSession, folder: str) -> DataFrame:
    found = routing.pages_to_recognise(_routed(spark, folder).withColumn("reasons", F.col("why")))
    return found.select("doc_id", "needs_ocr", F.array_join("pages", ",").alias("pages"))


SIZED = f"SELECT doc_id, page, width, height FROM ({PAGES}) WHERE width * height > 0"
PICTURES = "SELECT DISTINCT block_id, doc_id, page, x0, y0, x1, y1 FROM blocks WHERE kind = 'figure' AND x0 IS NOT NULL"


@query(
    f"WITH p AS ({SIZED}), t AS (SELECT doc_id, page, sum(greatest(0, (x1 - x0) * (y1 - y0))) AS a FROM ({WORDS}) GROUP BY ALL), i AS (SELECT doc_id, page, sum((x1 - x0) * (y1 - y0)) AS a, max((x1 - x0) * (y1 - y0)) AS l, count(*) AS n FROM ({PICTURES}) GROUP BY ALL)"
    " SELECT doc_id, page, round(least(1, coalesce(t.a, 0) / (width * height)), 6) AS text_coverage, coalesce(n, 0) AS image_count, round(least(1, coalesce(i.a, 0) / (width * height)), 6) AS image_coverage, round(least(1, coalesce(l, 0) / (width * height)), 6) AS largest_image_coverage, least(1, coalesce(l, 0) / (width * height)) >= 0.75::DOUBLE AS full_page_image FROM p LEFT JOIN t USING (doc_id, page) LEFT JOIN i USING (doc_id, page)"
)
def page_complexity(spark: SparkSession, folder: str) -> DataFrame:
    """Words as text, figure blocks as images."""
    pages = table(spark, folder, "page_complexity").where("width * height > 0").select("doc_id", "page", "width", "height").dropDuplicates(["doc_id", "page"])
    images = table(spark, folder, "blocks").where("kind = 'figure' and x0 is not null").select("block_id", "doc_id", "page", "x0", "y0", "x1", "y1").distinct()
    m = routing.page_measures(layout.distinct_words(table(spark, folder, "words")), images, pages)
    return m.select("doc_id", "page", *(F.round(c, 6).alias(c) for c in ("text_coverage", "image_coverage", "largest_image_coverage")), "image_count", "full_page_image")


SHIFTED = f"SELECT doc_id, page, seq AS word_seq, text, x0 + (seq % 4) * (x1 - x0) * 0.3::DOUBLE AS x0, y0, x1 + (seq % 4) * (x1 - x0) * 0.3::DOUBLE AS x1, y1 FROM ({WORDS})"


@query(
    f"WITH n AS (SELECT * FROM ({WORDS}) WHERE seq % 5 < 3), o AS ({SHIFTED}), c AS (SELECT o.doc_id, o.page, o.word_seq FROM o JOIN n ON o.doc_id = n.doc_id AND o.page = n.page AND least(o.x1, n.x1) > greatest(o.x0, n.x0) AND least(o.y1, n.y1) > greatest(o.y0, n.y0) WHERE (o.x1 - o.x0) * (o.y1 - o.y0) > 0"
    " GROUP BY ALL HAVING sum((least(o.x1, n.x1) - greatest(o.x0, n.x0)) * (least(o.y1, n.y1) - greatest(o.y0, n.y0))) >= 0.5::DOUBLE * any_value((o.x1 - o.x0) * (o.y1 - o.y0))) SELECT doc_id, page, word_seq, text FROM o ANTI JOIN c USING (doc_id, page, word_seq)"
)
def merge_ocr_words(spark: SparkSession, folder: str) -> DataFrame:
    """Native words kept from three in five, all words shifted sideways by up to nine tenths as recognised ones."""
    w = layout.distinct_words(table(spark, folder, "words"))
    shift = (F.col("seq") % 4) * (F.col("x1") - F.col("x0")) * 0.3
    shifted = w.select(F.struct("doc_id", "page", "seq").alias("word_id"), "doc_id", "page", F.col("seq").alias("word_seq"), "text", (F.col("x0") + shift).alias("x0"), "y0", (F.col("x1") + shift).alias("x1"), "y1")
    return routing.merge_ocr_words(w.where("seq % 5 < 3"), shifted).select("doc_id", "page", "word_seq", "text")


@query(f"SELECT doc_id, page, seq, floor(x0 * 2)::INT AS \"left\", floor((height - y1) * 2)::INT AS \"top\", floor(x1 * 2)::INT + 1 AS \"right\", floor((height - y0) * 2)::INT + 1 AS \"bottom\", x0 / 2 AS point_x FROM ({WORDS}) JOIN ({SIZED}) USING (doc_id, page)")
def pixel_rect(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "page_complexity").where("width * height > 0").select("doc_id", "page", "height").dropDuplicates(["doc_id", "page"])
    w = layout.distinct_words(table(spark, folder, "words")).join(pages, ["doc_id", "page"])
    c = [F.col(x) for x in ("x0", "y0", "x1", "y1")]
    return w.select("doc_id", "page", "seq", routing.pixel_rect(*c, F.lit(2.0), F.col("height")).alias("r"), routing.pixels_to_points(F.col("x0"), F.lit(2.0)).alias("point_x")).select("doc_id", "page", "seq", "r.*", "point_x")


@query(f"SELECT doc_id, page, seq, -y1 + 8 AS x0, 2 * x0 - 4 AS y0, -y0 + 8 AS x1, 2 * x1 - 4 AS y1 FROM ({WORDS})")
def matrix_apply(spark: SparkSession, folder: str) -> DataFrame:
    m = F.struct(F.lit(0.0).alias("a"), F.lit(2.0).alias("b"), F.lit(-1.0).alias("c"), F.lit(0.0).alias("d"), F.lit(8.0).alias("e"), F.lit(-4.0).alias("f"))
    return layout.distinct_words(table(spark, folder, "words")).select("doc_id", "page", "seq", routing.matrix_apply(m, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("r")).select("doc_id", "page", "seq", "r.*")


@query(f"SELECT doc_id, page, {_trimmed('text')} AS text, floor(x0)::DOUBLE AS x0, floor(y0)::DOUBLE AS y0, floor(x1)::DOUBLE AS x1, floor(y1)::DOUBLE AS y1, greatest(0.01, least(1, (seq % 103) / 100::DOUBLE)) AS confidence FROM ({WORDS}) WHERE trim(text) <> '' AND NOT contains(text, chr(9)) AND NOT contains(text, chr(10)) AND NOT contains(text, chr(13))")
def tesseract_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's words written as a recogniser's table and read back."""
    w = layout.distinct_words(table(spark, folder, "words")).where(r"trim(text) <> '' and not text rlike '[\\t\\n\\r]'")
    n = lambda c: F.floor(c).cast("int")
    row = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), F.lit("1"), F.col("seq"), n("x0"), n("y0"), n("x1") - n("x0"), n("y1") - n("y0"), F.col("seq") % 103, "text")
    header = "\t".join("level page_num block_num par_num line_num word_num left top width height conf text".split())
    pages = w.groupBy("doc_id", "page").agg(F.concat(F.lit(header + "\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", row.alias("r")))), lambda x: x["r"]), "\n")).alias("tsv"))
    return pages.select("doc_id", "page", F.inline(routing.tesseract_words(F.col("tsv"))))


@query(f"SELECT doc_id, page, text, floor(x0) AS x0, floor(y0) AS y0, floor(x1) AS x1, floor(y1) AS y1 FROM ({WORDS}) WHERE trim(text) <> ''")
def ocr_json_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's words as a recognition service's answer, every other one with a polygon for a box, and read back."""
    w = layout.distinct_words(table(spark, folder, "words")).where("trim(text) <> ''")
    x0, y0, x1, y1 = (F.floor(c).cast("double") for c in ("x0", "y0", "x1", "y1"))
    odd = F.col("seq") % 2 == 1
    r = F.struct("text", F.when(~odd, F.array(x0, y0, x1, y1)).alias("bbox"), F.when(odd, F.array(F.array(x1, y1), F.array(x0, y0), F.array(x0))).alias("polygon"), F.lit(0.5).alias("confidence"))
    pages = w.groupBy("doc_id", "page").agg(F.to_json(F.struct(F.collect_list(r).alias("results"))).alias("answer"))
    return pages.select("doc_id", "page", F.inline(routing.ocr_json_words(F.col("answer")))).drop("confidence")


@query("SELECT vec_id, list_min(list_transform(range(1, len(embedding), 2), lambda i: embedding[i]::DOUBLE)) AS x0, list_min(list_transform(range(1, len(embedding), 2), lambda i: embedding[i + 1]::DOUBLE)) AS y0, list_max(list_transform(range(1, len(embedding), 2), lambda i: embedding[i]::DOUBLE)) AS x1, list_max(list_transform(range(1, len(embedding), 2), lambda i: embedding[i + 1]::DOUBLE)) AS y1 FROM embeddings")
def polygon_bbox(spark: SparkSession, folder: str) -> DataFrame:
    e = F.transform("embedding", lambda x: x.cast("double"))
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size("embedding") / 2).cast("int") - 1), lambda i: F.slice(e, i * 2 + 1, 2))
    return table(spark, folder, "embeddings").select("vec_id", routing.polygon_box(points).alias("b")).select("vec_id", "b.*")


FIGURES = "SELECT DISTINCT block_id, doc_id, page, x0, y0, x1, y1 FROM blocks WHERE kind = 'figure' AND x0 IS NOT NULL"


@query(f"SELECT block_id FROM ({FIGURES}) JOIN ({SIZED}) USING (doc_id, page) WHERE x1 - x0 >= 24 AND y1 - y0 >= 24 AND (x1 - x0) * (y1 - y0) >= 0.02::DOUBLE * width * height")
def ocr_figure_candidates(spark: SparkSession, folder: str) -> DataFrame:
    figures = table(spark, folder, "blocks").where("kind = 'figure' and x0 is not null").select("block_id", "doc_id", "page", "x0", "y0", "x1", "y1").distinct()
    pages = table(spark, folder, "page_complexity").where("width * height > 0").select("doc_id", "page", "width", "height").dropDuplicates(["doc_id", "page"])
    return routing.figure_candidates(figures, pages).select("block_id")


@query(f"SELECT doc_id, page, seq, text FROM ({WORDS}) WHERE confidence = 0 OR (doc_id, page) NOT IN (SELECT doc_id, page FROM ({WORDS}) WHERE confidence = 0)")
def ocr_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Native words; recognised ones on pages that have none."""
    w = layout.distinct_words(table(spark, folder, "words"))
    return routing.with_fallback(w.where("confidence = 0"), w.where("confidence is null or confidence <> 0")).select("doc_id", "page", "seq", "text")


@query(f"SELECT doc_id, page, seq, CASE WHEN confidence * 120 <= 0 THEN 0.01 WHEN confidence * 120 / 100 > 1 THEN 1 ELSE confidence * 120 / 100 END::DOUBLE AS confidence FROM ({WORDS}) WHERE confidence IS NOT NULL")
def clamp_confidence(spark: SparkSession, folder: str) -> DataFrame:
    w = layout.distinct_words(table(spark, folder, "words")).where("confidence is not null")
    return w.select("doc_id", "page", "seq", text.clamp_confidence(F.col("confidence") * 120).alias("confidence"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CASE WHEN p_size % 12 + 1 > 6 THEN 6 ELSE p_size % 12 + 1 END WHEN 1 THEN 1 END::INT AS level FROM part")
def heading_style_level(spark: SparkSession, folder: str) -> DataFrame:
    """Part sizes as paragraph styles: headings, titles and others."""
    n = F.col("p_size")
    style = F.when(n % 3 == 0, F.concat(F.lit("Heading "), (n % 12).cast("string"))).when(n % 3 == 1, "TITLE").otherwise("Body Text")
    return table(spark, folder, "part").select("p_partkey", text.heading_style(style).alias("level"))


@query(f"SELECT doc_id, regexp_extract(path, '([^/\\\\]*)$', 1) AS name FROM (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY doc_id) = 1) WHERE path IS NOT NULL")
def child_basename(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").dropDuplicates(["doc_id"]).where("path is not null").select("doc_id", text.base_name("path").alias("name"))


@query("SELECT DISTINCT doc_id, CASE doc_id % 5 WHEN 2 THEN to_base64(encode(text)) WHEN 4 THEN text || '=Z' ELSE text END AS decoded FROM documents WHERE text IS NOT NULL")
def transfer_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies in base64, with line breaks; as they are; in base64 of base64; quoted-printable with soft breaks; and badly quoted."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text").distinct()
    n = F.col("doc_id") % 5
    packed = F.base64(F.encode("text", "UTF-8"))
    # Each byte as an escape, sixteen a line.
    quoted = F.regexp_replace(F.regexp_replace(F.hex(F.encode("text", "UTF-8")), "(..)", "=$1"), "((?:=..){16})", "$1=\r\n")
    body = F.when(n == 0, F.regexp_replace(packed, "(.{60})", "$1\r\n")).when(n == 1, F.col("text")).when(n == 2, F.base64(F.encode(F.regexp_replace(packed, "\\s", ""), "UTF-8"))).when(n == 3, quoted).otherwise(F.concat("text", F.lit("=Z")))
    encoding = F.when(n == 1, "8bit").when(n >= 3, " Quoted-Printable").otherwise("Base64")
    return rows.select("doc_id", text.transfer_decode(body, encoding).alias("decoded"))


# --- tables and Markdown ----------------------------------------------------

CELLS = "SELECT block_id, row_no, col_no, max(coalesce(text, '')) AS text FROM cells WHERE row_no IS NOT NULL AND col_no IS NOT NULL GROUP BY ALL"
ESCAPED = f"replace(replace(replace({_trimmed('text')}, '|', '\\|'), chr(13) || chr(10), chr(10)), chr(10), '<br>')"


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "cells").where("row_no is not null and col_no is not null").groupBy("block_id", "row_no", "col_no").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    return c.groupBy("block_id", "row_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_no", "text"))), lambda x: x["text"]).alias("cells"))


@query(
    f"WITH r AS (SELECT block_id, row_no, string_agg({ESCAPED}, ' | ' ORDER BY col_no) AS line, count(*) AS n FROM ({CELLS}) GROUP BY ALL), w AS (SELECT block_id, max(n) AS width FROM r GROUP BY ALL)"
    " SELECT block_id, string_agg('| ' || line || CASE WHEN row_no = 0 THEN repeat(' | ', width - n) || ' |' || chr(10) || '| ' || array_to_string(list_transform(range(width), lambda i: '---'), ' | ') || ' |' ELSE ' |' END, chr(10) ORDER BY row_no) AS markdown FROM r JOIN w USING (block_id) WHERE block_id IN (SELECT block_id FROM r WHERE row_no = 0) GROUP BY ALL"
)
def markdown_table(spark: SparkSession, folder: str) -> DataFrame:
    """The first row is the header."""
    rows = _rows(spark, folder)
    t = rows.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "cells"))).alias("r")).where(F.col("r")[0]["row_no"] == 0)
    cells = F.transform("r", lambda x: x["cells"])
    return t.select("block_id", block_ops.markdown_table(cells[0], F.slice(cells, F.lit(2), F.size(cells))).alias("markdown"))


@query(f"SELECT block_id, row_no, regexp_replace(string_agg(text, chr(9) ORDER BY col_no), '\\t+$', '') AS tsv FROM ({CELLS}) GROUP BY ALL")
def office_tsv(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("block_id", "row_no", block_ops.office_row(F.col("cells")).alias("tsv"))


@query(f"SELECT block_id, row_no, (count(*) FILTER (t <> ''))::INT AS filled, count(*) FILTER (t <> '') = count(*) AS complete, 2 * count(*) FILTER (t <> '') >= count(*) AS mostly FROM (SELECT block_id, row_no, {_trimmed('text')} AS t FROM ({CELLS})) GROUP BY ALL")
def row_fill(spark: SparkSession, folder: str) -> DataFrame:
    return _rows(spark, folder).select("block_id", "row_no", block_ops.row_fill(F.col("cells")).alias("f")).select("block_id", "row_no", "f.*")


@query(
    "WITH c AS (SELECT block_id, row_no, col_no, max(text) AS text FROM cells WHERE text IS NOT NULL AND row_no IS NOT NULL AND col_no IS NOT NULL GROUP BY ALL), w AS (SELECT block_id, max(col_no) + 1 AS width FROM c GROUP BY ALL), r AS (SELECT DISTINCT block_id, row_no FROM c), g AS (SELECT block_id, row_no, unnest(range(width)) AS col_no FROM r JOIN w USING (block_id))"
    " SELECT block_id, row_no, string_agg(coalesce(text, ''), '|' ORDER BY col_no) AS line FROM g LEFT JOIN c USING (block_id, row_no, col_no) GROUP BY ALL"
)
def sheet_densify(spark: SparkSession, folder: str) -> DataFrame:
    """No table here is sparse enough for the compact form."""
    return block_ops.dense_grid(table(spark, folder, "cells"), "block_id", "row_no", "col_no", "text").select("block_id", "row_no", F.array_join("cells", "|").alias("line"))


@query(
    "WITH b AS (SELECT DISTINCT doc_id, page, block_no, kind, coalesce(text, '') AS text, level, ordered, marker, figure_id FROM blocks), m AS (SELECT doc_id, page, block_no, kind = 'list_item' AS item, CASE kind WHEN 'heading' THEN repeat('#', greatest(1, least(6, coalesce(level, 1)))) || ' ' || t"
    " WHEN 'list_item' THEN CASE WHEN coalesce(ordered, false) THEN coalesce(marker, '1.') || ' ' || t ELSE '- ' || t END WHEN 'figure' THEN '![](' || coalesce(figure_id, '') || '.png)' WHEN 'table' THEN text ELSE t END AS md FROM (SELECT *, " + _trimmed("text") + " AS t FROM b) WHERE kind IN ('table', 'figure') OR t <> ''),"
    " s AS (SELECT *, CASE WHEN lag(md) OVER w IS NULL THEN '' WHEN item AND lag(item) OVER w THEN chr(10) ELSE chr(10) || chr(10) END AS gap FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_no)) SELECT doc_id, string_agg(gap || md, '' ORDER BY page, block_no) || chr(10) AS markdown FROM s GROUP BY ALL"
)
def render_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """Tables stay as the tab-separated text they are stored as; markdown_table renders them."""
    b = table(spark, folder, "blocks").dropDuplicates(["doc_id", "page", "block_no"]).withColumn("table", F.coalesce("text", F.lit("")))
    return block_ops.render_markdown(b)


# --- trees -----------------------------------------------------------------

KIDS = "SELECT * FROM children QUALIFY row_number() OVER (PARTITION BY child_id) = 1"


def _kids(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "children").dropDuplicates(["child_id"])


@query(f"SELECT child_id, sha256(data) AS fingerprint, CASE WHEN data IS NOT NULL THEN row_number() OVER (PARTITION BY doc_id, sha256(data) ORDER BY ord, child_id) > 1 END AS repeated FROM ({KIDS})")
def content_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return trees.mark_duplicates(_kids(spark, folder), "doc_id", "ord", "data", "child_id").select("child_id", "fingerprint", "repeated")


@query(
    f"WITH RECURSIVE k AS (SELECT doc_id, child_id, size_bytes AS s, row_number() OVER (PARTITION BY doc_id ORDER BY ord, child_id) AS i FROM ({KIDS})), w AS (SELECT k.doc_id, k.child_id, k.i, CASE WHEN s IS NOT NULL AND s <= 4000 THEN 'accepted' ELSE 'refused' END AS outcome, 11 AS slots, CASE WHEN s IS NOT NULL AND s <= 4000 THEN 4000 - s ELSE 4000 END AS bytes FROM k WHERE i = 1"
    " UNION ALL SELECT k.doc_id, k.child_id, k.i, CASE WHEN w.outcome = 'stopped' OR slots <= 0 OR bytes <= 0 THEN 'stopped' WHEN s IS NOT NULL AND s <= bytes THEN 'accepted' ELSE 'refused' END, CASE WHEN w.outcome = 'stopped' OR slots <= 0 OR bytes <= 0 THEN slots ELSE slots - 1 END,"
    " CASE WHEN w.outcome <> 'stopped' AND slots > 0 AND bytes > 0 AND s IS NOT NULL AND s <= bytes THEN bytes - s ELSE bytes END FROM w JOIN k ON k.doc_id = w.doc_id AND k.i = w.i + 1) SELECT doc_id, child_id, outcome FROM w"
)
def budget_admission(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve files and 4000 bytes for the attachments of each file."""
    return trees.admit(_kids(spark, folder), "doc_id", "ord", "size_bytes", "child_id", 12, 4000).select("doc_id", "child_id", "outcome")


FILES = "SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY doc_id) = 1"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "files").dropDuplicates(["doc_id"])


@query(f"SELECT root_id, 1 + count(DISTINCT f.doc_id) + count(c.child_id) AS n_nodes FROM ({FILES}) f LEFT JOIN ({KIDS}) c USING (doc_id) WHERE root_id IS NOT NULL GROUP BY ALL")
def node_count(spark: SparkSession, folder: str) -> DataFrame:
    kids = _kids(spark, folder).groupBy("doc_id").agg(F.count("*").alias("n"))
    return _files(spark, folder).where("root_id is not null").join(kids, "doc_id", "left").groupBy("root_id").agg((1 + F.count("*") + F.coalesce(F.sum("n"), F.lit(0))).alias("n_nodes"))


@query(f"SELECT doc_id, string_agg({_trimmed('decode(data)')}, chr(10) || chr(10) ORDER BY ord, child_id) AS text FROM ({KIDS}) WHERE octet_length(data) > 0 AND hex(data) NOT LIKE '25504446%' AND hex(data) NOT LIKE '89504E47%' GROUP BY ALL")
def all_text(spark: SparkSession, folder: str) -> DataFrame:
    kids = _kids(spark, folder).where("octet_length(data) > 0").where(~F.hex("data").rlike("^(25504446|89504E47)"))
    nodes = kids.select("doc_id", F.array(F.col("ord").cast("bigint"), "child_id").alias("path"), F.col("data").cast("string").alias("text"))
    return trees.all_text(nodes, "doc_id", "path", "text")


@query(f"SELECT doc_id, string_agg('  ' || coalesce(name, '?') || ' [' || coalesce(file_format, 'unknown') || ']', chr(10) ORDER BY ord, child_id) AS tree FROM ({KIDS}) GROUP BY ALL")
def print_tree(spark: SparkSession, folder: str) -> DataFrame:
    nodes = _kids(spark, folder).select("doc_id", F.array(F.col("ord").cast("bigint"), "child_id").alias("path"), F.lit(1).alias("depth"), F.concat(F.coalesce("name", F.lit("?")), F.lit(" ["), F.coalesce("file_format", F.lit("unknown")), F.lit("]")).alias("label"))
    return trees.print_tree(nodes, "doc_id", "path", "depth", F.col("label"))


@query(
    f"WITH s AS (SELECT doc_id, path, regexp_replace(path, '\\.[^./]*$', '') AS stem FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'same/a' WHEN 1 THEN 'same/a-' || (doc_id % 20 + 2) WHEN 2 THEN path || '.md' ELSE path END AS path FROM ({FILES}) WHERE path IS NOT NULL)), b AS (SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY stem) > 1 THEN path ELSE stem END AS base FROM s),"
    " n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n, count(*) OVER (PARTITION BY base) AS m FROM b), names AS (SELECT DISTINCT base FROM b), free AS (SELECT base, k, row_number() OVER (PARTITION BY base ORDER BY k) AS i FROM (SELECT DISTINCT base, unnest(range(2, m + 60)) AS k FROM n WHERE m > 1) f WHERE NOT EXISTS (SELECT 1 FROM names WHERE names.base = f.base || '-' || f.k))"
    " SELECT doc_id, n.base || CASE WHEN n > 1 THEN '-' || k ELSE '' END || '.md' AS output FROM n LEFT JOIN free ON n.base = free.base AND n.n = free.i + 1"
)
def plan_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Some paths are made the same, or what the same would be called."""
    n = F.col("doc_id") % 7
    path = F.when(n == 0, "same/a").when(n == 1, F.concat(F.lit("same/a-"), (F.col("doc_id") % 20 + 2).cast("string"))).when(n == 2, F.concat("path", F.lit(".md"))).otherwise(F.col("path"))
    return trees.plan_outputs(_files(spark, folder).where("path is not null").withColumn("path", path), "doc_id", "path", ".md")


@query(
    f"WITH f AS (SELECT doc_id, n_pages FROM ({FILES}) WHERE n_pages IS NOT NULL), p AS (SELECT doc_id, n_pages, list_concat([1], list_concat(range(2, 6), list_concat([0], range(0, n_pages)))) AS l FROM f)"
    " SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: l[i] < n_pages AND NOT list_contains(l[1:i - 1], l[i])), lambda i: l[i]), ',') AS pages FROM p"
)
def page_spec(spark: SparkSession, folder: str) -> DataFrame:
    f = _files(spark, folder).where("n_pages is not null").withColumn("spec", F.concat(F.lit("2, 3-6,,1,1-"), F.col("n_pages").cast("string")))
    return f.select("doc_id", F.array_join(trees.page_list(F.col("spec"), F.col("n_pages")), ",").alias("pages"))
