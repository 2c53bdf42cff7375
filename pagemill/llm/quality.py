"""Statistics of document text, and text types learned from them without labels.

A document is cut into sentence-like segments. Thresholds on the statistics of
a segment are noisy labelling functions, each voting for one of the types or
for none; an expectation-maximization over how often they agree gives each
one's accuracy, and with them each segment's posterior over the types. The
document's posterior weighs its segments by their length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pagemill.session import cut, spread

KINDS = ("prose", "list", "table", "junk")
PROSE, LIST, TABLE, JUNK = range(4)
WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}]+)*"
#: One character of these scripts counts as half a word, since they write no spaces.
DENSE = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]"
END = r"[.!?…。！？:;][\"'”’»)\]*_`]*\s*$"
VOWELS = "aeiouyàâäéèêëîïôöùûüáíóúñąęœæøаеёиоуыэюяіαεηιουωάέήίόύώ"
BULLET = r"(?m)^[ \t]*(?:[-+*•◦▪·–—>]|\[[ xX]?\]|\(?[0-9]{1,3}[.)]|\(?[a-zA-Z][.)])[ \t]+"


def _count(text: Column | str, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def common_words(documents: DataFrame, per_language: int = 60) -> list[str]:
    """The ``per_language`` words that occur in most documents of each language, at least three, over all documents.

    A language is two letters a to z at the start of lang; all else is one more. There
    are at most 677, so the list is bounded whatever the data.
    """
    code = F.regexp_extract(F.lower(F.trim(F.coalesce("lang", F.lit("")))), "^([a-z]{2})", 1)
    words = documents.where("text is not null").select(code.alias("lang"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{M}]+)"), 1))).alias("w"))
    counted = words.groupBy("lang", "w").agg(F.count("*").alias("n")).where("n >= 3")
    ranked = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "w"))).where(F.col("r") <= per_language)
    return sorted({r.w for r in ranked.select("w").collect()})


def statistics(documents: DataFrame, common: list[str]) -> DataFrame:
    """One row for each document id (of several rows for an id the greatest text holds; null texts come last): doc_id, word_count, mean_word_length, symbol_ratio, punctuated_line_share, common_word_share.

    A null or blank text has 0 words and null shares.
    """
    rows = _one_text(documents)
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x.rlike(r"\S"))
    found = F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 1)
    s = rows.select("doc_id", found.alias("w"), lines.alias("l"), F.length(F.regexp_replace("text", r"\s", "")).alias("n"), _count("text", r"[^\p{L}\p{M}\p{N}\s]").alias("symbols"), _count("text", DENSE).alias("dense"))
    n_words = F.coalesce(F.size("w") + F.floor(F.col("dense") / 2), F.lit(0)).cast("long")
    real = F.col("n") > 0
    return s.select(
        "doc_id",
        F.when(real, n_words).otherwise(0).alias("word_count"),
        F.when(real & (F.size("w") > 0), F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)) / F.size("w")).alias("mean_word_length"),
        F.when(real, F.col("symbols") / F.col("n")).alias("symbol_ratio"),
        F.when(real, F.size(F.filter("l", lambda x: x.rlike(END))) / F.size("l")).alias("punctuated_line_share"),
        F.when(real & (F.size("w") > 0), F.size(F.filter("w", lambda x: x.isin(common))) / F.size("w")).alias("common_word_share"),
    )


def _one_text(documents: DataFrame) -> DataFrame:
    """The greatest text of each id, over enough tasks for the patterns that follow."""
    return spread(documents.where("doc_id is not null").select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))


def segments(documents: DataFrame, common: list[str]) -> DataFrame:
    """(doc_id, seg, chars, votes...) with the vote of each labelling function: a type's number, or -1."""
    rows = _one_text(documents).where(F.col("text").rlike(r"\S"))
    # A segment ends after a sentence, at an empty line, and before a line that opens as a list entry or table row.
    text = F.regexp_replace("text", "\r\n?", "\n")
    text = F.regexp_replace(text, r"([\p{L}\p{N})\]\"'”’»`%][.!?…]{1,3}[\"'”’»)]*)(?:\s+|$)", "$1\u0001")
    text = F.regexp_replace(text, r"([。！？]+)", "$1\u0001")
    text = F.regexp_replace(text, r"\n[ \t]*\n\s*", "\u0001")
    # List numbers are no sentence ends.
    text = F.regexp_replace(text, r"(?m)(^|\u0001)([ \t]*\(?(?:[0-9]{1,3}|[a-zA-Z])[.)])\u0001", "$1$2 ")
    seg = rows.select("doc_id", F.posexplode(F.split(text, "\u0001")).alias("seg", "s")).where(F.col("s").rlike(r"\S"))
    words = F.regexp_extract_all(F.lower("s"), F.lit(f"({WORD})"), 1)
    s = seg.select("doc_id", "seg", "s", words.alias("w"), F.length(F.regexp_replace("s", r"\s", "")).alias("chars"), _count("s", DENSE).alias("dense"))
    s = s.select(
        "*", (F.size("w") + F.col("dense") / 2).alias("n"), F.greatest(_count("s", r"(?m)^[ \t\r]*\S"), F.lit(1)).alias("lines"), F.col("s").rlike(r"[.!?…。！？][\"'”’»)\]*_`]*\s*$").alias("ends"),
        _share(F.size(F.filter("w", lambda x: x.isin(common))), F.size("w")).alias("common"), _share(F.size(F.array_distinct("w")), F.size("w")).alias("distinct"),
        _share(_count("s", r"[^\p{L}\p{M}\p{N}\s]"), F.col("chars")).alias("symbols"), _share(_count("s", r"\p{N}"), F.col("chars")).alias("digits"),
        _count("s", BULLET).alias("bullets"), (_count("s", r"\t|\|") + _count("s", r"(?<=[^\s,]),(?=[^\s,])|,(?=,)|;(?=\S)")).alias("cuts"),
        F.col("s").rlike(r"^[^\p{L}\p{N}]*(?:[\p{Lu}\p{N}]|[¿¡]|" + DENSE + ")").alias("capital"),
        _share(F.size(F.filter("w", lambda x: F.length(F.translate(x, VOWELS, "")) * 4 > 3 * F.length(x) + 2)), F.size("w")).alias("harsh"),
        _share(_count("s", r"(?:^|(?<=\n))[ \t]*[./~]?[\w.-]*/[\w./-]+[ \t]*(?=\n|$)"), F.lit(1.0)).alias("paths"), _count("s", r"\.{4,}|(?:\. ){4,}|_{4,}|…{2,}").alias("leaders"), _count("s", r"\S+ [>»|/] \S+").alias("crumbs"),
    )
    n, lines = F.col("n"), F.col("lines")
    prose_like = F.col("dense") * 2 > F.col("chars")
    per_line = n / lines
    vote = lambda *cases: _chain(cases)
    votes = {
        "sentence": vote(((n >= 4) & (n <= 70) & F.col("ends"), PROSE), (~F.col("ends") & (lines >= 3) & (F.col("cuts") < lines), LIST), (~F.col("ends") & (n > 40) & (F.col("cuts") < lines), JUNK)),
        "pace": vote(((lines >= 3) & (per_line < 7) & (F.col("cuts") < lines), LIST), ((per_line >= 8) & F.col("ends"), PROSE)),
        "opening": vote((F.col("capital") & F.col("ends") & (n >= 4), PROSE)),
        "common": vote((prose_like & F.col("ends"), PROSE), ((F.col("common") >= 0.28) & (n >= 5), PROSE), ((F.col("common") < 0.08) & (n >= 8) & (F.col("cuts") < lines) & (F.col("bullets") < lines), JUNK)),
        "symbols": vote((F.col("symbols") > 0.5, JUNK), (F.col("symbols") + F.col("digits") > 0.3, TABLE), ((F.col("symbols") < 0.08) & F.col("ends") & (n >= 5), PROSE)),
        "marks": vote((F.col("bullets") * 2 > lines, LIST)),
        "cells": vote((F.col("cuts") >= 2 * lines, TABLE), ((F.col("cuts") >= lines) & (lines >= 3), TABLE)),
        "repeats": vote(((F.size("w") >= 8) & (F.col("distinct") < 0.34), JUNK)),
        "letters": vote(((F.col("harsh") > 0.3) & (F.size("w") >= 5), JUNK)),
        "leaders": vote(((F.col("leaders") > 0) & (F.col("leaders") * 2 >= lines), LIST), (F.col("paths") * 2 > lines, LIST), (F.col("crumbs") >= 5, JUNK), (n < 1, JUNK)),
        "length": vote((n < 4, LIST), ((n > 90) & (F.col("cuts") < lines), JUNK)),
    }
    return s.select("doc_id", "seg", F.col("chars").cast("long").alias("chars"), *(v.cast("int").alias(k) for k, v in votes.items()))


def _chain(cases: tuple) -> Column:
    out = None
    for condition, kind in cases:
        out = F.when(condition, F.lit(kind)) if out is None else out.when(condition, F.lit(kind))
    return out.otherwise(F.lit(-1))


def learn(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60, prior: float = 0.7) -> tuple[np.ndarray, np.ndarray]:
    """Class shares and, for each function, P(vote | class) [function, class, vote + 1], by expectation-maximization.

    It starts from the functions being right with probability ``prior`` where
    they vote; a hundredth of the weight, spread that way, stays as a prior so
    that classes keep their meaning.
    """
    k, m = len(KINDS), len(patterns[0][0])
    v = np.array([p for p, _ in patterns]) + 1
    weight = np.array([w for _, w in patterns], float)
    start = np.zeros((m, k, k + 1))
    for j in range(m):
        silent = np.average(v[:, j] == 0, weights=weight)
        start[j, :, 0] = silent
        for c in range(k):
            start[j, c, 1:] = (1 - silent) * (1 - prior) / (k - 1)
            start[j, c, c + 1] = (1 - silent) * prior
    shares, p = np.full(k, 1 / k), np.clip(start, 1e-4, 1)
    for _ in range(rounds):
        post = posterior(v, shares, p) * weight[:, None]
        shares = (post.sum(0) + 0.01 * weight.sum() / k) / (1.01 * weight.sum())
        for j in range(m):
            for vote in range(k + 1):
                p[j, :, vote] = post[v[:, j] == vote].sum(0)
            p[j] += 0.01 * weight.sum() * start[j] / k
            p[j] = np.clip(p[j] / p[j].sum(1, keepdims=True), 1e-4, 1)
    return shares, p


def posterior(v: np.ndarray, shares: np.ndarray, p: np.ndarray) -> np.ndarray:
    log = np.log(shares)[None] + sum(np.log(p[j][:, v[:, j]]).T for j in range(v.shape[1]))
    log -= log.max(1, keepdims=True)
    out = np.exp(log)
    return out / out.sum(1, keepdims=True)


def text_types(documents: DataFrame, sample_patterns: int = 200_000) -> DataFrame:
    """statistics() with p_prose, p_list, p_table, p_junk (the posterior share of the text in each type), kind and is_prose.

    Null and blank texts have null posteriors, kind and is_prose. The model sees
    only the distinct combinations of votes, whose number is bounded by the
    functions (5^11) and in practice some hundreds; beyond ``sample_patterns``
    the most frequent ones teach the model, and all are classified.
    """
    spark: SparkSession = documents.sparkSession
    common = common_words(documents)
    voted = cut(segments(documents, common))
    functions = [c for c in voted.columns if c not in ("doc_id", "seg", "chars")]
    patterns = voted.groupBy(*functions).agg(F.sum("chars").alias("chars"), F.count("*").alias("n"))
    rows = patterns.orderBy(F.desc("n"), *functions).limit(sample_patterns).collect()
    stats = statistics(documents, common)
    if not rows:
        return stats.select("*", *(F.lit(None).cast("double").alias(f"p_{k}") for k in KINDS), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("boolean").alias("is_prose"))
    shares, p = learn([(tuple(r[f] for f in functions), float(r.n)) for r in rows])
    # The posterior of a vote pattern as an expression, so that every pattern is classified in the JVM.
    logs = []
    for c in range(len(KINDS)):
        log = F.lit(float(np.log(shares[c])))
        for j, f in enumerate(functions):
            log = log + F.element_at(F.array(*(F.lit(float(np.log(p[j, c, v]))) for v in range(len(KINDS) + 1))), F.col(f) + 2)
        logs.append(log)
    scored = voted.select("doc_id", "chars", *(x.alias(f"l{c}") for c, x in enumerate(logs)))
    top = F.greatest(*(F.col(f"l{c}") for c in range(len(KINDS))))
    total = sum((F.exp(F.col(f"l{c}") - top) for c in range(len(KINDS))), F.lit(0.0))
    weighed = scored.groupBy("doc_id").agg(F.sum("chars").alias("chars"), *(F.sum(F.exp(F.col(f"l{c}") - top) / total * F.col("chars")).alias(f"w{c}") for c in range(len(KINDS))))
    share = [F.col(f"w{c}") / F.col("chars") for c in range(len(KINDS))]
    kinds = weighed.select("doc_id", *(s.alias(f"p_{k}") for s, k in zip(share, KINDS, strict=True)))
    best = F.greatest(*(F.col(f"p_{k}") for k in KINDS))
    kind = _named(best)
    out = stats.join(kinds, "doc_id", "left")
    return out.withColumn("kind", kind).withColumn("is_prose", F.col("p_prose") >= 0.5)


def _named(best: Column) -> Column:
    out = None
    for k in KINDS:
        out = F.when(F.col(f"p_{k}") == best, F.lit(k)) if out is None else out.when(F.col(f"p_{k}") == best, F.lit(k))
    return out
