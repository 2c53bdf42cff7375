"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.llm.canonical import canonical_rows
from pagemill.llm.garbled import garbled_words
from pagemill.llm.leakage import leaked_items
from pagemill.llm.mixture import mixture
from pagemill.llm.neardup import duplicate_groups, duplicate_pairs, near_duplicates
from pagemill.llm.pii import item_types, personal_items
from pagemill.llm.quality import common_words, statistics, text_types
from pagemill.llm.scan_repair import damaged, repaired_paragraphs
from pagemill.llm.split import split_oversized
from pagemill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_words(table(spark, folder, "words")).select("word_id")


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    return garbled_words(table(spark, folder, "words"))


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(table(spark, folder, "blocks"), table(spark, folder, "split_limits"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_pieces(spark, folder).where("piece_no = 2").select("block_id")


def p3_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces, characters and longest piece by kind."""
    return p3_pieces(spark, folder).groupBy("kind").agg(F.countDistinct("block_id").alias("n_blocks"), F.max(F.length("text")).alias("longest"), F.sum(F.when(F.col("piece_no") == F.col("n_pieces"), F.col("end_at"))).alias("n_chars"))


def p3_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each block that was cut: whether its pieces fit the limit, are its text at their places, begin and end with it, and overlap by what was asked."""
    limits = table(spark, folder, "split_limits").select("kind", "max_chars", "overlap_chars")
    whole = table(spark, folder, "blocks").where("text is not null").select("block_id", F.col("text").alias("whole")).distinct()
    p = p3_pieces(spark, folder).where("n_pieces > 1").join(limits, "kind").join(whole, "block_id")
    before = F.lag("end_at").over(W.partitionBy("block_id").orderBy("piece_no"))
    p = p.withColumn("shared", before - F.col("start_at"))
    return p.groupBy("block_id").agg(
        F.max(F.length("whole")).cast("bigint").alias("n_chars"),
        F.bool_and(F.length("text") <= F.col("max_chars")).alias("fits"),
        F.bool_and(F.expr("substring(whole, start_at + 1, end_at - start_at)") == F.col("text")).alias("in_place"),
        ((F.min("start_at") == 0) & (F.max("end_at") == F.max(F.length("whole"))) & (F.count("*") == F.max("n_pieces"))).alias("complete"),
        F.bool_and(F.coalesce(F.col("shared") == F.col("overlap_chars"), F.col("piece_no") == 1)).alias("overlaps"),
    )


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return damaged(table(spark, folder, "words"), table(spark, folder, "blocks"), table(spark, folder, "page_complexity"))


def p5_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return repaired_paragraphs(table(spark, folder, "words"), table(spark, folder, "blocks"), table(spark, folder, "page_complexity"))


def _words_and_cells(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "words").select(F.lit("words").alias("tab"), F.col("word_id").alias("rec_id"), "doc_id", "text")
    return words.unionByName(table(spark, folder, "cells").select(F.lit("cells").alias("tab"), F.col("cell_id").alias("rec_id"), "doc_id", "text"))


def p6_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_rows(_words_and_cells(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    changed = p6_canonical(spark, folder).where(F.col("text").rlike(r"[^\x00-\x7F]")).select("tab", "rec_id")
    garbled = garbled_words(table(spark, folder, "words")).select(F.lit("words").alias("tab"), F.col("word_id").alias("rec_id"))
    return changed.join(garbled, ["tab", "rec_id"], "left_anti")


def p7_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return leaked_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7_leaks(spark, folder).select("doc_id", "item_id")


def p8_copies(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each mix and source: its documents, whether each has a row with at most max_repeats copies, copies that differ by one at most, and whether shares add up to 1 or nothing was used."""
    copies, shares = mixture(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))
    used = copies.groupBy("mix", "source").agg(F.count("*").alias("n_docs"), F.max("copies").alias("most"), F.min("copies").alias("least"))
    total = shares.groupBy("mix").agg(F.sum("share").alias("total"))
    rows = shares.select("mix", "source", "max_repeats").join(used, ["mix", "source"], "left").join(total, "mix")
    return rows.select("mix", "source", F.coalesce("n_docs", F.lit(0)).alias("n_docs"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"), (F.coalesce(F.col("most") - F.col("least"), F.lit(0)) <= 1).alias("even"), (F.abs(F.col("total") - 1) < 1e-9).alias("whole"))


def p9_statistics(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents")
    s = statistics(d, common_words(d))
    return s.select("doc_id", "word_count", *(F.round(c, 6).alias(c) for c in s.columns[2:]))


def p9_types(spark: SparkSession, folder: str) -> DataFrame:
    return text_types(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_types(spark, folder).where("not is_prose").select("doc_id")


def _blocks_and_children(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of blocks, and of attachments whose bytes are valid UTF-8."""
    blocks = table(spark, folder, "blocks").select(F.lit("blocks").alias("tab"), F.col("block_id").alias("rec_id"), "text")
    data = F.col("data").cast("string")
    children = table(spark, folder, "children").where("data is not null").where(F.is_valid_utf8(data)).select(F.lit("children").alias("tab"), F.col("child_id").alias("rec_id"), data.alias("text"))
    return blocks.unionByName(children)


def p1_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return personal_items(_blocks_and_children(spark, folder))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return item_types(p1_redacted(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_pairs(*near_duplicates(_blocks_and_children(spark, folder), threshold=0.5, words=3))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    return duplicate_groups(*near_duplicates(_blocks_and_children(spark, folder), threshold=0.5, words=3))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[:1] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    limited = "SELECT DISTINCT b.block_id, b.kind, length(b.text) AS n, l.max_chars FROM blocks b JOIN split_limits l ON b.kind = l.kind WHERE b.text IS NOT NULL"
    records = (
        "SELECT 'blocks' AS tab, block_id AS id, max(text) AS t FROM blocks WHERE text IS NOT NULL GROUP BY ALL UNION ALL"
        " SELECT 'children', child_id, max(decode(data)) FROM children WHERE data IS NOT NULL AND hex(data) NOT LIKE '25504446%' AND hex(data) NOT LIKE '89504E47%' GROUP BY ALL"
    )
    return {
        "p3_found": f"SELECT block_id FROM ({limited}) WHERE n > max_chars",
        "p3_checks": f"SELECT block_id, n AS n_chars, true AS fits, true AS in_place, true AS complete, true AS overlaps FROM ({limited}) WHERE n > max_chars",
        "p4_found": rf"""
            WITH w AS (SELECT tab, id, list_filter(string_split_regex(lower(t), '[ \t\r\n]+'), lambda x: x <> '') AS w FROM ({records})),
            g AS (SELECT DISTINCT tab, id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT tab, id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 20)),
            n AS (SELECT tab, id, count(*) AS n FROM g GROUP BY ALL),
            c AS (SELECT a.tab, a.id AS id_a, b.id AS id_b, count(*) AS c FROM g a JOIN g b ON a.tab = b.tab AND a.g = b.g AND a.id < b.id GROUP BY ALL)
            SELECT c.tab, id_a, id_b FROM c JOIN n x ON x.tab = c.tab AND x.id = id_a JOIN n y ON y.tab = c.tab AND y.id = id_b WHERE c >= 0.5 * (x.n + y.n - c)""",
        "p8_checks": "SELECT mix, source, (SELECT count(*) FROM (SELECT DISTINCT doc_id, lower(trim(source)) AS s, text FROM documents WHERE doc_id IS NOT NULL) d WHERE d.s = m.source) AS n_docs, true AS capped, true AS even, true AS whole FROM mix_targets m",
        "p9_statistics": r"""
            WITH l AS (SELECT regexp_extract(lower(trim(coalesce(lang, ''))), '^([a-z]{2})', 1) AS lang, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS ws FROM documents WHERE text IS NOT NULL),
            c AS (SELECT lang, w, count(*) AS n FROM (SELECT lang, unnest(ws) AS w FROM l) GROUP BY ALL HAVING count(*) >= 3),
            common AS (SELECT list(DISTINCT w) AS ws FROM (SELECT w, row_number() OVER (PARTITION BY lang ORDER BY n DESC, w) AS r FROM c) WHERE r <= 60),
            d AS (SELECT doc_id, max(text) AS text FROM documents WHERE doc_id IS NOT NULL GROUP BY ALL),
            s AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+(?:[''’][\p{L}]+)*') AS w, list_filter(string_split_regex(text, '\r?\n'), lambda x: regexp_matches(x, '\S')) AS l, length(regexp_replace(text, '\s', '', 'g')) AS n,
                len(regexp_extract_all(text, '[^\p{L}\p{M}\p{N}\s]')) AS symbols, len(regexp_extract_all(text, '[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]')) AS dense FROM d)
            SELECT doc_id, CASE WHEN n > 0 THEN len(w) + dense // 2 ELSE 0 END AS word_count, CASE WHEN n > 0 AND len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / len(w), 6) END AS mean_word_length,
                CASE WHEN n > 0 THEN round(symbols::DOUBLE / n, 6) END AS symbol_ratio, CASE WHEN n > 0 THEN round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?…。！？:;]["''”’»)\]*_`]*\s*$')))::DOUBLE / len(l), 6) END AS punctuated_line_share,
                CASE WHEN n > 0 AND len(w) > 0 THEN round(len(list_filter(w, lambda x: list_contains(ws, x)))::DOUBLE / len(w), 6) END AS common_word_share FROM s, common""",
        "p7_found": r"""
            WITH d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
            b AS (SELECT DISTINCT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
            dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
            bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8))
            SELECT DISTINCT doc_id, item_id FROM dg JOIN bg USING (g)""",
    }
