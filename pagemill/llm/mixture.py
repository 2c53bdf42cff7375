"""Combining sources to target shares of all tokens, with capped repeats.

Entropy balancing: among all document rates that give every source its target
tokens and stay under its cap, those of least divergence from using each
document once. The divergence counts every token, so that the optimal rate of a
document is exp(multiplier of its source), whatever its length, up to the cap.
The multipliers solve the convex dual by Newton steps whose gradient and
curvature are aggregated over all documents. Rates then become whole copies.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut, ship, spread

FINE = 4096


def token_counts(documents: DataFrame, tokenizer: str | None = None, pattern: str | None = None) -> DataFrame:
    """(doc_id, source, tokens): source in lower case without outer spaces; a null text has 0 tokens.

    tokenizer is a file of byte-pair ranks as base64 and number a line, the same
    path on every executor, and pattern how it splits text; by default those of
    the installed public tokenizers (byte_bpe_50k).
    """
    ship(documents.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        path, split = tokenizer, pattern
        if path is None or split is None:
            import public_tokenizers

            path, split = path or public_tokenizers.path("byte_bpe_50k.tiktoken"), split or public_tokenizers.PATTERN
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("mixture", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"doc_id": b.doc_id, "source": b.source, "tokens": [len(encoding.encode_ordinary(t)) if t else 0 for t in b.text]})

    source = F.nullif(F.lower(F.trim("source")), F.lit(""))
    rows = documents.where("doc_id is not null").select("doc_id", source.alias("source"), "text")
    return spread(rows, "doc_id").mapInPandas(count, "doc_id bigint, source string, tokens bigint")


def solve(sizes: DataFrame, target: dict[tuple[str, str], float], cap: dict[tuple[str, str], float], tolerance: float = 1e-9, rounds: int = 60) -> dict[tuple[str, str], float]:
    """The rate of each (mix, source), from Newton steps on its multiplier.

    sizes has source, tokens and n, the number of documents of that size. The dual
    is a sum over sources, its curvature diagonal; steps are bounded so that none
    leaps over the cap.
    """
    multiplier = dict.fromkeys(target, 0.0)
    pending = dict(target)
    for _ in range(rounds):
        rows = [(m, s, multiplier[m, s], math.log(cap[m, s])) for m, s in pending]
        if not rows:
            break
        at = sizes.sparkSession.createDataFrame(rows, "mix string, source string, l double, top double")
        size = F.col("tokens") * F.col("n")
        rate = F.exp(F.least("l", "top"))
        got = sizes.join(F.broadcast(at), "source").groupBy("mix", "source").agg(F.sum(size * rate).alias("used"), F.sum(F.when(F.col("l") <= F.col("top"), size * rate).otherwise(0.0)).alias("curve")).collect()
        for r in got:
            k = (r.mix, r.source)
            gap = target[k] - r.used
            top = math.log(cap[k])
            if abs(gap) <= tolerance * max(1.0, target[k]) or (multiplier[k] >= top and gap > 0):
                pending.pop(k)  # met, or all its documents are at the cap
                continue
            multiplier[k] = min(top, multiplier[k] + max(-2.0, min(2.0, gap / r.curve)))
    return {k: math.exp(min(v, math.log(cap[k]))) for k, v in multiplier.items()}


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, tokenizer: str | None = None, pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, shares) for each mix of targets (mix, source, target_share, max_repeats; a small table of settings).

    copies: mix, doc_id, source, tokens, copies, one row for each document and mix
    its source takes part in, copies being 0 for those left out. shares: mix,
    source, target_share, max_repeats, tokens, used_tokens, share.

    Without total_tokens a mix is as large as exact shares permit: the least of
    cap times tokens over target share among its sources. With it, a source short
    of tokens is used up to its cap and the others fill the total by their
    shares. A source without tokens gives nothing, and the others share by their
    targets. Documents of no source, or one outside the mix, have no row. Copies
    of a source differ by one at most: which documents get one more is settled by
    a hash of their id, in the order of which documents are taken until the
    source's tokens come nearest to its target.
    """
    counted = cut(token_counts(documents, tokenizer, pattern).withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 48))))
    wanted = {(r.mix, r.source): r for r in targets.where("target_share > 0 and max_repeats > 0").withColumn("source", F.lower(F.trim("source"))).dropDuplicates(["mix", "source"]).collect()}
    sizes = cut(counted.where("source is not null and tokens > 0").groupBy("source", "tokens").agg(F.count("*").alias("n")))
    have = {r.source: r.t for r in sizes.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t")).join(F.broadcast(targets.select(F.lower(F.trim("source")).alias("source")).distinct()), "source").collect()}
    target: dict[tuple[str, str], float] = {}
    cap = {k: float(r.max_repeats) for k, r in wanted.items()}
    for mix in {m for m, _ in wanted}:
        live = {k: r.target_share for k, r in wanted.items() if k[0] == mix and have.get(k[1])}
        if not live:
            continue
        room = {k: cap[k] * have[k[1]] for k in live}
        whole = sum(live.values())
        total = min(room[k] / (live[k] / whole) for k in live) if total_tokens is None else total_tokens
        open_, left = dict(live), float(total)
        while open_:
            short = [k for k in open_ if room[k] < left * open_[k] / sum(open_.values()) * (1 - 1e-12)]
            if not short:
                target |= {k: left * v / sum(open_.values()) for k, v in open_.items()}
                break
            for k in short:
                target[k] = room[k]
                left -= room[k]
                open_.pop(k)
    rates = solve(sizes, target, {k: cap[k] for k in target})
    spark = documents.sparkSession
    # Whole copies for all, and tokens that one more copy of some documents is to add.
    plan = {k: (math.floor(rates[k] + 1e-9), max(0.0, target[k] - math.floor(rates[k] + 1e-9) * have[k[1]])) for k in target}
    cuts = _thresholds(counted.where("tokens > 0"), {k: v[1] for k, v in plan.items()})
    rows = [(m, s, wanted[m, s].target_share, int(cap[m, s]), plan[m, s][0] if (m, s) in plan else 0, cuts.get((m, s), -1)) for m, s in wanted]
    settings = spark.createDataFrame(rows, "mix string, source string, target_share double, max_repeats int, whole int, below bigint")
    one_more = (F.col("u") <= F.col("below")).cast("int")
    n = F.when(F.col("tokens") > 0, F.least(F.col("whole") + one_more, "max_repeats")).otherwise(0)
    copies = counted.join(F.broadcast(settings), "source").select("mix", "doc_id", "source", "tokens", n.cast("int").alias("copies"))
    used = copies.groupBy("mix", "source").agg(F.sum("tokens").alias("tokens"), F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"))
    shares = settings.select("mix", "source", "target_share", "max_repeats").join(used, ["mix", "source"], "left").fillna(0, ["tokens", "used_tokens"])
    all_used = used.groupBy("mix").agg(F.sum("used_tokens").alias("all_tokens"))
    shares = shares.join(all_used, "mix", "left").withColumn("share", F.coalesce(F.try_divide(F.col("used_tokens").cast("double"), F.col("all_tokens")), F.lit(0.0))).drop("all_tokens")
    return copies, shares


def _thresholds(counted: DataFrame, extra: dict[tuple[str, str], float]) -> dict[tuple[str, str], int]:
    """For each (mix, source) the hash up to which documents get one more copy: their tokens come nearest to extra.

    Found in three passes over the documents, each splitting the interval that
    holds the threshold into ``FINE`` parts; of the last, at most FINE rows a source come back.
    """
    spark = counted.sparkSession
    low = dict.fromkeys(extra, 0)
    before = dict.fromkeys(extra, 0)
    width = 1 << 48
    for _ in range(4):
        step = width // FINE
        rows = [(m, s, low[m, s], low[m, s] + width) for m, s in extra]
        if not rows:
            return {}
        at = spark.createDataFrame(rows, "mix string, source string, lo bigint, hi bigint")
        inside = counted.join(F.broadcast(at), "source").where("u >= lo and u < hi")
        parts: dict[tuple[str, str], list] = {}
        for r in inside.groupBy("mix", "source", F.expr(f"(u - lo) div {step}").alias("part")).agg(F.sum("tokens").alias("t")).collect():
            parts.setdefault((r.mix, r.source), []).append((r.part, r.t))
        for k in extra:
            for part, t in sorted(parts.get(k, [])):
                if before[k] + t > extra[k]:
                    low[k] += part * step
                    break
                before[k] += t
            else:  # every document up to here fits
                low[k] += width - step
        width = step
        if width == 1:
            break
    out = {}
    last = {(r.mix, r.source): r.t for r in counted.join(F.broadcast(spark.createDataFrame([(m, s, low[m, s]) for m, s in extra], "mix string, source string, lo bigint")), "source").where("u = lo").groupBy("mix", "source").agg(F.sum("tokens").alias("t")).collect()}
    for k, wanted in extra.items():
        t = last.get(k, 0)
        takes = before[k] + t <= wanted or (before[k] + t) - wanted < wanted - before[k]
        out[k] = low[k] if takes else low[k] - 1
    return out
