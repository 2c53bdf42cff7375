"""Cutting items that exceed a size limit at natural boundaries, with overlap.

Sizes and offsets count Unicode code points. The sorted boundary offsets of a
text are searched by bisection for the last one under the limit; the next piece
starts ``overlap`` code points before the cut.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Boundary patterns by kind, best first; a cut lies at the end of a match.
TIERS = {
    "table": [r"\r?\n", r"\t", r"\s+"],
    "paragraph": [r"(?:\r?\n[ \t]*){2,}", r"[.!?…][\"'”’»)\]]*\s+|[。！？]", r"\r?\n", r"[,;:、，；]\s*", r"\s+"],
    "list_item": [r"(?:\r?\n)+", r"[.!?…][\"'”’»)\]]*\s+|[。！？]", r"[,;:、，；]\s*", r"\s+"],
    "heading": [r"\r?\n", r"[:;–—]\s*", r"\s+"],
}
DEFAULT = TIERS["paragraph"]
_COMPILED: dict[str, list] = {}


def boundaries(text: str, kind: str) -> list[list[int]]:
    """Sorted cut offsets of each tier."""
    if kind not in _COMPILED:
        _COMPILED[kind] = [regex.compile(p) for p in TIERS.get(kind, DEFAULT)]
    return [[m.end() for m in p.finditer(text)] for p in _COMPILED[kind]]


def _joined(text: str, at: int) -> bool:
    """Whether a cut here would part a character from its marks."""
    return unicodedata.combining(text[at]) > 0 or text[at] in "‍︎️" or text[at - 1] == "‍"


def pieces(text: str, kind: str, limit: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Offsets (start, end) of the pieces of a text; every piece but the last ends at a cut, and starts ``overlap`` before the last one's end.

    A tier is taken when it has a boundary in the latter half of the room;
    failing that, the best tier with any boundary that makes progress; failing
    that, a hard cut at the limit that keeps a letter and its marks together.
    """
    tiers, start, n = None, 0, len(text)
    while n - start > limit:
        if tiers is None:
            tiers = boundaries(text, kind)
        least = start + overlap + 1 if start or overlap else start + 1
        end = 0
        for floor in (max(least, start + limit // 2), least):
            for marks in tiers:
                at = bisect_right(marks, start + limit) - 1
                if at >= 0 and marks[at] >= floor:
                    end = marks[at]
                    break
            if end:
                break
        if not end:
            end = start + limit
            while end > least and _joined(text, end):
                end -= 1
            if _joined(text, end):
                end = start + limit
        yield start, end
        start = end - overlap
    yield start, n


def split_oversized(items: DataFrame, limits: DataFrame, key: str = "block_id") -> DataFrame:
    """Pieces of every item whose kind has a limit: the key, piece_no, page, kind, text, start_at, end_at, n_pieces.

    items has the key, page, kind and text; limits has kind, max_chars and
    overlap_chars, one row a kind (of several rows for a kind the smallest limit
    holds). Items up to their limit stay whole in the JVM; only longer ones go
    through Python. Re-sent items count once. A null text or kind, or a kind
    without a positive limit, yields no piece; an empty text yields one empty
    piece. A null overlap is 0, and one of the limit or more is the limit less 1.
    Further columns of items are ignored.
    """
    bounds = (
        limits.where("kind is not null and max_chars > 0")
        .groupBy("kind")
        .agg(F.min(F.struct("max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap"))).alias("l"))
        .select("kind", F.col("l.max_chars").cast("int").alias("max_chars"), F.greatest(F.lit(0), F.least(F.col("l.overlap"), F.col("l.max_chars") - 1)).cast("int").alias("overlap"))
    )
    # As many rows as there are kinds, which Spark sees from the small file and broadcasts by itself.
    rows = items.where("text is not null").select(F.col(key).alias("_key"), "page", "kind", "text").join(bounds, "kind")
    size = F.length("text")
    small = rows.where(size <= F.col("max_chars")).select("_key", F.lit(1).alias("piece_no"), "page", "kind", "text", F.lit(0).alias("start_at"), size.alias("end_at"), F.lit(1).alias("n_pieces"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                got = list(pieces(r.text, r.kind, r.max_chars, r.overlap))
                out += [(r._0, i, r.page, r.kind, r.text[s:e], s, e, len(got)) for i, (s, e) in enumerate(got, 1)]
            yield pd.DataFrame(out, columns=["_key", "piece_no", "page", "kind", "text", "start_at", "end_at", "n_pieces"])

    kind = dict(small.dtypes)
    large = rows.where(size > F.col("max_chars")).select("_key", "page", "kind", "text", "max_chars", "overlap")
    large = large.mapInPandas(cut, ", ".join(f"{c} {kind[c]}" for c in small.columns))
    return small.unionByName(large).dropDuplicates(["_key", "piece_no"]).withColumnRenamed("_key", key)
