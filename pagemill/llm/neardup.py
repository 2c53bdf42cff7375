"""Records that are edited copies of one another.

Records become sets of word shingles; records with the same set form a class,
so that exact copies cost one row. Likely pairs come from an exact join by the
rarest shingles of each set or, for high thresholds, from bands of a signature by
improved consistent weighted sampling over IDF weights, with the exact join for
what the bands do not reach. The shingle sets themselves decide.

Where the exact join does it all, no shingle is written as a row before it is known
that it can count: texts stay where they are, packed places of their shingles go
out to be counted, and one byte a shingle comes back.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.shingles import codes, mix, pack, segments, shingles, unpack
from pagemill.session import cut, ship, spread, uncut

#: Entries of the table from which the samplers draw their random numbers.
DRAWS = 1 << 16
#: The probability with which the bands may miss a pair that is left to them.
MISS = 1e-8
#: Words of 64 bits in the mark that a class carries into the join.
MARK = 4
#: Bytes of a row of the join of rare shingles, and what a round may shuffle in any case.
RARE_BYTES, LEAST_BYTES = 24 + 8 * MARK, 32 << 20


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010) with ``count`` samples.

    The gamma and uniform variates of (shingle, sample) are drawn from a fixed
    table at a place hashed from both, so equal shingles meet equal variates
    everywhere.
    """

    def __init__(self, count: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.multiply = (rng.integers(1, 1 << 62, count).astype(np.uint64) << np.uint64(1)) | np.uint64(1)
        self.add = rng.integers(0, 1 << 62, count).astype(np.uint64)
        self.r = rng.gamma(2, 1, DRAWS).astype(np.float32)
        self.log_c = np.log(rng.gamma(2, 1, DRAWS)).astype(np.float32)
        self.beta = rng.random(DRAWS).astype(np.float32)
        self.inverse = 1 / self.r

    def __call__(self, shingles: np.ndarray, log_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sampled shingle's number and level for each sample; shingles are distinct uint64."""
        place = shingles[None, :] * self.multiply[:, None]
        place += self.add[:, None]
        place >>= np.uint64(48)
        place = place.astype(np.intp)
        beta = self.beta[place]
        t = log_weight[None, :] * self.inverse[place]
        t += beta
        np.floor(t, out=t)
        a = t - beta
        a += 1
        a *= self.r[place]
        np.subtract(self.log_c[place], a, out=a)
        best = a.argmin(1)
        return best, t[np.arange(len(best)), best]


def shingle_rows(records: DataFrame, words: int, least: int) -> DataFrame:
    """(tab, id, shingles) with the sorted 64-bit hashes of all runs of ``words`` words, repeats included, of records of ``least`` words or more; one row for each key (of several texts for a key the greatest holds)."""
    one = records.where("rec_id is not null and text is not null").groupBy("tab", F.col("rec_id").alias("id")).agg(F.max("text").alias("text"))
    w = one.select("tab", "id", F.filter(F.split(F.lower("text"), "[ \t\r\n]+"), lambda x: x != "").alias("w")).where(F.size("w") >= max(least, words))
    runs = F.transform(F.sequence(F.lit(1), F.size("w") - (words - 1)), lambda i: F.xxhash64(F.array_join(F.slice("w", i, words), " ")))
    return w.select("tab", "id", F.array_sort(runs).alias("shingles"))


def _jaccard(a: Column | str, b: Column | str, n_a: Column | str, n_b: Column | str) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.col(n_a) + F.col(n_b) - both)


def near_duplicates(records: DataFrame, threshold: float = 0.8, words: int = 5, least: int = 20, rows: int = 3, bands: int = 80, crowd: int = 5000) -> tuple[DataFrame, DataFrame]:
    """(members, links) of the records (tab, rec_id, text).

    members has tab, rec_id and class_id, the least id among the records with
    the same shingle set. links has tab, class_a < class_b and similarity, the
    share of distinct shingles found in both among those found in either, of all pairs
    of classes that are at least ``threshold`` alike. Records of fewer than ``least``
    words, null ones and empty ones are in neither. Records are only compared within a tab.

    A pair whose weighted similarity is below what ``bands`` of ``rows`` reach, the one
    they miss with probability MISS, meets by the rarest shingles of both sets
    instead, of which any two sets alike enough share one, so no link is lost. With a
    threshold below that reach all pairs do, and nothing is signed. Above it, classes
    do of which a weighted similarity below the reach is possible, and those in
    buckets of more than ``crowd`` classes, which are not joined.
    """
    spark = records.sparkSession
    ship(spark)
    reach = (1 - MISS ** (1 / bands)) ** (1 / rows)
    if threshold < reach:
        return _without_bands(records, threshold, words, least)
    # Two 64-bit hashes stand for a set. Copies are collapsed by sums that combine before the shuffle.
    sets = cut(shingle_rows(records, words, least).select("tab", "id", "shingles", F.xxhash64("shingles").alias("k1"), F.xxhash64(F.lit(1), F.reverse("shingles")).alias("k2")))
    least_id = sets.groupBy("tab", "k1", "k2").agg(F.min("id").alias("class_id"))
    members = sets.select("tab", "id", "k1", "k2").join(least_id, ["tab", "k1", "k2"]).select("tab", "id", "class_id")
    one = sets.join(least_id.select("tab", F.col("class_id").alias("id")), ["tab", "id"], "left_semi").select("tab", F.col("id").alias("class_id"), F.array_distinct("shingles").alias("shingles"))
    classes = cut(one.withColumn("n", F.size("shingles")))
    pairs = _by_bands(classes, threshold, rows, bands, crowd, reach).distinct()
    left = classes.select("tab", F.col("class_id").alias("class_a"), F.col("shingles").alias("s_a"), F.col("n").alias("n_a"))
    right = classes.select("tab", F.col("class_id").alias("class_b"), F.col("shingles").alias("s_b"), F.col("n").alias("n_b"))
    alike = pairs.join(left, ["tab", "class_a"]).join(right, ["tab", "class_b"]).withColumn("similarity", _jaccard("s_a", "s_b", "n_a", "n_b"))
    links = cut(alike.where(F.col("similarity") >= threshold).select("tab", "class_a", "class_b", "similarity"))
    return members.select("tab", F.col("id").alias("rec_id"), "class_id"), links


def _without_bands(records: DataFrame, threshold: float, words: int, least: int) -> tuple[DataFrame, DataFrame]:
    """The (members, links) of near_duplicates by the exact join alone."""
    kind = dict(records.dtypes)
    given = records.where("tab is not null and rec_id is not null and text is not null").select("tab", F.col("rec_id").alias("id"), "text")
    lower = F.lower(F.max("text")).alias("text")  # of several texts for a key the greatest holds

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            record, s = shingles(b["text"], words, least)
            at = segments(record)
            sums = [np.add.reduceat(mix(s ^ np.uint64(salt)), at) if len(at) else s for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            has = pa.array(record[at])
            yield pa.RecordBatch.from_arrays([b["tab"].take(has), b["id"].take(has), *(pa.array(x.view(np.int64)) for x in sums)], ["tab", "id", "k1", "k2"])

    # Two 64-bit sums stand for a set. Copies are collapsed by sums that combine before the shuffle.
    sets = cut(given.groupBy("tab", "id").agg(lower).mapInArrow(sign, f"tab {kind['tab']}, id {kind['rec_id']}, k1 bigint, k2 bigint"), free=True)
    least_id = sets.groupBy("tab", "k1", "k2").agg(F.min("id").alias("class_id"))
    members = cut(sets.join(least_id, ["tab", "k1", "k2"]).select("tab", F.col("id").alias("rec_id"), "class_id"), free=True)
    n, size = given.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rare = _rare_shingles(given, size, members.where("rec_id = class_id").select("tab", F.col("class_id").alias("id")), threshold, words, least)
    # What a round of either loop shuffles besides the texts is about half as large as they are.
    rounds = _rounds(rare.agg(F.sum(F.size("shingles"))).first()[0] or 0, RARE_BYTES, size)
    pairs = [cut(_joined(rare, threshold, k, rounds).distinct(), free=True) for k in range(rounds)]
    pairs = pairs[0] if rounds == 1 else cut(reduce(DataFrame.unionByName, pairs).distinct(), free=True)
    uncut(rare)

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (one, s), (other, s_other) = (_distinct(*shingles(b[c], words, least)) for c in ("text_1", "text_2"))
            either = np.bincount(_distinct(np.concatenate([one, other]), np.concatenate([s, s_other]))[0], minlength=len(b))
            similarity = (np.bincount(one, minlength=len(b)) + np.bincount(other, minlength=len(b)) - either) / either
            has = pa.array(np.flatnonzero(similarity >= threshold))
            yield pa.RecordBatch.from_arrays([*(b[c].take(has) for c in ("tab", "class_a", "class_b")), pa.array(similarity).take(has)], ["tab", "class_a", "class_b", "similarity"])

    rounds, links = _rounds(pairs.count(), 2 * (size // max(n, 1)), size), []
    for k in range(rounds):
        some = pairs.where(F.pmod(F.xxhash64("class_a"), F.lit(rounds)) == k)
        ends = some.select("*", F.explode(F.array("class_a", "class_b")).alias("id"))
        texts = given.groupBy("tab", "id").agg(lower).join(ends, ["tab", "id"]).groupBy("tab", "class_a", "class_b").agg(F.collect_list("text").alias("t"))  # two
        texts = texts.select("tab", "class_a", "class_b", F.col("t")[0].alias("text_1"), F.col("t")[1].alias("text_2"))
        links.append(cut(texts.mapInArrow(decide, f"tab {kind['tab']}, class_a {kind['rec_id']}, class_b {kind['rec_id']}, similarity double"), free=True))
    return members, reduce(DataFrame.unionByName, links)


def _rounds(rows: int, each: int, size: int) -> int:
    return max(1, -(-rows * each // max(size // 2, LEAST_BYTES)))


def _distinct(record: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different pairs in order."""
    order = np.lexsort((s, record))
    record, s = record[order], s[order]
    once = np.ones(len(s), bool)
    once[1:] = (s[1:] != s[:-1]) | (record[1:] != record[:-1])
    return record[once], s[once]


def _lists(s: np.ndarray, at: np.ndarray) -> pa.Array:
    """Lists of bigint that begin at these places."""
    return pa.ListArray.from_arrays(pa.array(np.append(at, len(s)), pa.int32()), pa.array(s.view(np.int64)))


def _rare_shingles(given: DataFrame, size: int, classes: DataFrame, threshold: float, words: int, least: int) -> DataFrame:
    """(tab, class_id, n, shared, shingles, mark) of the classes that can be alike any other: how many distinct shingles a class has, how many of these other classes may have as well, the rarest of the latter as far as _joined needs them, and the parities of the number of the latter in each of 64 * MARK places.

    Texts are shuffled once, into groups. A group sends the first bits of its hashes to
    where they are counted, sorted and packed, and gets one byte for each in return.
    Hashes that begin alike are counted together, so a shingle may seem shared that
    is not, but never the reverse.
    """
    kind = dict(given.dtypes)
    groups = max(1, min(64, size >> 20), size >> 24)
    share = (groups - 1).bit_length()  # 2 ** share parts of the hashes are counted apart
    within = max(int(2 * size).bit_length(), 16 + share) - share
    group = F.pmod(F.xxhash64("tab", "id"), F.lit(groups)).cast("int").alias("gid")
    texts = given.select(group, "*").repartition("gid").groupBy("gid", "tab", "id").agg(F.lower(F.max("text")).alias("text")).withColumn("salt", F.xxhash64("tab"))

    def hashed(texts: pa.Table, side: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """The classes of a group; of each distinct shingle the class's number and the hash, by both, and the first bits."""
        wanted = set(zip(side["tab"].to_pylist(), side["id"].to_pylist(), strict=True))
        texts = texts.filter(pa.array([x in wanted for x in zip(texts["tab"].to_pylist(), texts["id"].to_pylist(), strict=True)], pa.bool_()))
        record, s = shingles(pa.concat_arrays([pa.array([], pa.large_binary()), *texts["text"].cast(pa.large_binary()).chunks]), words, least)
        record, s = _distinct(record, s)
        salt = texts["salt"].to_numpy().view(np.uint64)
        return texts, record, s, mix(s ^ salt[record]) >> np.uint64(64 - share - within)

    def bounds(sorted_first: np.ndarray) -> np.ndarray:
        return np.searchsorted(sorted_first, np.arange((1 << share) + 1, dtype=np.uint64) << np.uint64(within))

    def places(texts: pa.Table, side: pa.Table) -> pa.Table:
        first = np.sort(hashed(texts, side)[3]) if len(texts) else np.zeros(0, np.uint64)
        at = bounds(first)
        parts = np.flatnonzero(np.diff(at))
        packed = [pack(first[at[p] : at[p + 1]] - (np.uint64(p) << np.uint64(within)), within) for p in parts]
        gid = np.full(len(parts), texts["gid"][0].as_py() if len(texts) else 0)
        return pa.table({"part": pa.array(parts, pa.int32()), "gid": pa.array(gid, pa.int32()), "n": pa.array(np.diff(at)[parts], pa.int32()), "packed": pa.array(packed, pa.binary())})

    def count(rows: pa.Table) -> pa.Table:
        n = rows["n"].to_pylist()
        every = np.concatenate([unpack(x.as_buffer(), k, within) for x, k in zip(rows["packed"], n, strict=True)])
        _, of, counts = np.unique(every, return_inverse=True, return_counts=True)
        code, ends = codes(counts)[of], np.cumsum(n)
        packed = [zlib.compress(code[e - k : e].tobytes()) for e, k in zip(ends, n, strict=True)]
        return pa.table({"gid": rows["gid"], "part": rows["part"], "packed": pa.array(packed, pa.binary())})

    def rank(texts: pa.Table, side: pa.Table) -> pa.Table:
        back = side.filter(side["part"].is_valid())
        texts, record, s, first = hashed(texts, side.filter(side["part"].is_null()))
        code, order = np.zeros(len(s), np.uint8), np.argsort(first, kind="stable")
        answers = dict(zip(back["part"].to_pylist(), back["packed"].to_pylist(), strict=True))
        at = bounds(first[order])
        for p in np.flatnonzero(np.diff(at)).tolist():
            code[order[at[p] : at[p + 1]]] = np.frombuffer(zlib.decompress(answers[p]), np.uint8)
        n, some = np.bincount(record, minlength=len(texts)), np.bincount(record[code > 0], minlength=len(texts))
        need = np.ceil(n * threshold - 1e-9).astype(np.int64)
        kept = (n > 0) & (some >= need)
        use = (code > 0) & kept[record]
        record, s, code = record[use], s[use], code[use]
        order = np.lexsort((s, code, record))
        record, s, at = record[order], s[order], segments(record)
        bit = np.uint64(1) << (s & np.uint64(63))
        of = (s >> np.uint64(6)) % np.uint64(MARK)
        marks = [np.bitwise_xor.reduceat(np.where(of == k, bit, np.uint64(0)), at).view(np.int64) if len(at) else np.zeros(0, np.int64) for k in range(MARK)]
        of = record[at]
        first = some[of] - need[of] + 1
        s = s[np.arange(len(s)) - np.repeat(at, some[of]) < np.repeat(first, some[of])]
        given = {"tab": texts["tab"].take(pa.array(of)), "class_id": texts["id"].take(pa.array(of)), "n": pa.array(n[of], pa.int32()), "shared": pa.array(some[of], pa.int32())}
        return pa.table(given | {"shingles": _lists(s, np.cumsum(first) - first), **{f"mark{k}": pa.array(x) for k, x in enumerate(marks)}})

    none = {"part": F.lit(None).cast("int"), "packed": F.lit(None).cast("binary")}
    wanted = classes.select(group, "tab", "id").withColumns(none)
    places_of = texts.groupBy("gid").cogroup(wanted.groupBy("gid")).applyInArrow(places, "part int, gid int, n int, packed binary")
    counted = places_of.groupBy("part").applyInArrow(count, "gid int, part int, packed binary")
    side = wanted.unionByName(counted, allowMissingColumns=True)
    return cut(texts.groupBy("gid").cogroup(side.groupBy("gid")).applyInArrow(rank, f"tab {kind['tab']}, class_id {kind['id']}, n int, shared int, shingles array<bigint>, {', '.join(f'mark{k} bigint' for k in range(MARK))}"), free=True)


def with_frequencies(classes: DataFrame, shared: bool = False) -> DataFrame:
    """(tab, class_id, n, shingles, df): the shingles of each class with the number of classes each is in, rarest first; with ``shared`` only those of two classes or more.

    Frequencies are counted before the shuffle and joined back, so that a shingle
    of a third of all classes is no task's burden by itself: its rows are a skewed
    side of a join, which is split.
    """
    each = classes.select("tab", "class_id", "n", F.explode("shingles").alias("s"))
    df = each.groupBy("tab", "s").agg(F.count("*").cast("int").alias("df")).where("df > 1")
    counted = each.join(df, ["tab", "s"]) if shared else each.join(df, ["tab", "s"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    rows = counted.groupBy("tab", "class_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))  # as large as one record
    return rows.select("tab", "class_id", "n", F.col("o.s").alias("shingles"), F.col("o.df").alias("df"))


def _by_bands(classes: DataFrame, threshold: float, rows: int, bands: int, crowd: int, reach: float) -> DataFrame:
    """(tab, class_a, class_b) of the pairs that share a band, and of all that can be alike where bands may miss one."""
    total = classes.count()
    heaviest = float(np.log1p(max(total, 1)))
    count = rows * bands

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sampler = Sampler(count)
        mix = np.random.default_rng(3).integers(1, 1 << 62, rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)
        number = np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for b in batches:
            keys, least = [], []
            for s, df in zip(b.shingles, b.df, strict=True):
                shingles = np.asarray(s, np.int64).view(np.uint64)
                weight = np.log1p(max(total, 1) / np.asarray(df, float))  # IDF over classes: copies do not make a shingle common
                best, level = sampler(shingles, np.log(weight).astype(np.float32))
                least.append(least_weighted(weight, heaviest, threshold))
                h = shingles[best] ^ (level.astype(np.int64).view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
                h = (h * np.uint64(0xFF51AFD7ED558CCD)).reshape(bands, rows)
                h ^= h >> np.uint64(29)
                key = (h * mix).sum(1, dtype=np.uint64) + number
                key ^= key >> np.uint64(32)
                keys.append(key.view(np.int64))
            yield pd.DataFrame({"tab": b["tab"], "class_id": b["class_id"], "n": b["n"], "least": least, "keys": keys})

    kind = dict(classes.dtypes)
    # Read back by both sides of the join, so that each class is signed once.
    signed = cut(spread(with_frequencies(classes), "class_id").mapInPandas(sign, f"tab {kind['tab']}, class_id {kind['class_id']}, n int, least double, keys array<bigint>"))
    banded = signed.select("tab", "class_id", "n", F.explode("keys").alias("band"))
    # Buckets of one class, which are nearly all, and those of more than ``crowd`` do not go into the join.
    shared = cut(banded.groupBy("tab", "band").agg(F.count("*").alias("members")).where("members > 1"))
    crowded = banded.join(shared.where(F.col("members") > crowd), ["tab", "band"], "left_semi").select("tab", "class_id")
    # Two classes meet in the bands unless both are among these.
    beyond = signed.where(F.col("least") < reach).select("tab", "class_id").unionByName(crowded)
    banded = banded.join(shared.where(F.col("members") <= crowd).select("tab", "band"), ["tab", "band"], "left_semi")
    # Of two classes, one may be so much smaller that they cannot be alike.
    a, b = banded.select("tab", "band", F.col("class_id").alias("class_a"), F.col("n").alias("n_a")), banded.select("tab", "band", F.col("class_id").alias("class_b"), F.col("n").alias("n_b"))
    pairs = a.join(b, ["tab", "band"]).where(_ordered(threshold)).select("tab", "class_a", "class_b")
    return pairs.unionByName(_by_rare_shingles(classes.join(beyond.distinct(), ["tab", "class_id"], "left_semi"), threshold))


def least_weighted(weights: np.ndarray, heaviest: float, threshold: float) -> float:
    """The least weighted similarity that a set of such weights can have with any set that it is alike.

    With ``o`` shingles in both there are at most ``o / threshold`` in either. The
    least is where those in both are the lightest, and those of the other set alone
    of the weight ``heaviest``.
    """
    n = len(weights)
    o = np.arange(max(int(np.ceil(n * threshold - 1e-9)), 1), n + 1)
    light = np.sort(weights).cumsum()
    return float((light[o - 1] / (light[-1] + heaviest * np.maximum(np.floor(o / threshold + 1e-9) - n, 0))).min())


def _ordered(threshold: float) -> Column:
    """Each pair once, and none where one set is so much smaller that they cannot be alike."""
    return (F.col("class_a") < F.col("class_b")) & (F.col("n_a") >= threshold * F.col("n_b") - 1e-9) & (F.col("n_b") >= threshold * F.col("n_a") - 1e-9)


def _by_rare_shingles(classes: DataFrame, threshold: float) -> DataFrame:
    """(tab, class_a, class_b) of all pairs that can be alike.

    In one order for all, rarest first, two sets that are alike share one of the
    n - ceil(threshold * n) + 1 first shingles of each, and after the first that they
    share enough others must be left in both. Shingles of one class alone keep
    their places, which are the first, but are left out of the join.
    """
    return _joined(with_frequencies(classes, shared=True).withColumn("shared", F.size("shingles")), threshold)


def _joined(ordered: DataFrame, threshold: float, k: int = 0, rounds: int = 1) -> DataFrame:
    """The pairs of _by_rare_shingles from (tab, class_id, n, shared, shingles), those of the k-th of so many shares of all shingles; where there are marks, without those whose marks differ too much."""
    marked = [c for c in ordered.columns if c.startswith("mark")]
    first = F.col("shared") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    rare = ordered.select("tab", "class_id", "n", "shared", *marked, F.posexplode(F.slice("shingles", F.lit(1), F.greatest(first, F.lit(0)))).alias("at", "s"))
    if rounds > 1:
        rare = rare.where(F.pmod("s", F.lit(rounds)) == k)
    rare = rare.select("tab", "class_id", "n", "shared", *marked, (F.col("shared") - F.col("at")).alias("left"), "s")  # left: the shingle itself and those after it
    a, b = (rare.select("tab", "s", *(F.col(c).alias(f"{c.removesuffix('_id')}_{x}") for c in ("class_id", "n", "shared", *marked, "left"))) for x in "ab")
    both = F.least("left_a", "left_b")
    if marked:  # places where the parities differ hold a shingle that is not in both
        apart = sum((F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b"))) for c in marked), F.lit(0))
        both = F.least(both, (F.col("shared_a") + F.col("shared_b") - apart) / 2)
    enough = both * (1 + threshold) >= threshold * (F.col("n_a") + F.col("n_b")) - 1e-9
    return a.join(b, ["tab", "s"]).where(_ordered(threshold) & enough).select("tab", "class_a", "class_b")


def duplicate_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tab, id_a, id_b), id_a < id_b: the links between classes and within them, as pairs of records."""
    a = members.select("tab", F.col("class_id").alias("class_a"), F.col("rec_id").alias("x"))
    b = members.select("tab", F.col("class_id").alias("class_b"), F.col("rec_id").alias("y"))
    across = links.select("tab", "class_a", "class_b").join(a, ["tab", "class_a"]).join(b, ["tab", "class_b"]).select("tab", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    within = a.join(b, (a.tab == b.tab) & (a.class_a == b.class_b) & (a.x < b.y)).select(a.tab, F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(within)


def duplicate_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """(tab, rec_id, class_id, group_id, n_links): one row a record, its class, the least class id it is linked to over any number of links, and how many other classes its own is linked to.

    Components come from alternating large-star and small-star steps (Kiveris et al. 2014), each read back from a checkpoint.
    """
    edges = links.select("tab", F.col("class_b").alias("u"), F.col("class_a").alias("v"))
    while True:
        both = edges.unionByName(edges.select("tab", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("tab", "u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, ["tab", "u"]).where("v > u").select("tab", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select("tab", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("tab", "u").agg(F.min("v").alias("m"))
        small = down.join(least, ["tab", "u"]).select("tab", F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        following = cut(small)
        if following.count() == edges.count() and following.exceptAll(edges).isEmpty():
            break
        edges = following
    root = edges.select("tab", F.col("u").alias("class_id"), F.col("v").alias("root"))
    ends = links.select("tab", F.col("class_a").alias("class_id")).unionByName(links.select("tab", F.col("class_b").alias("class_id"))).groupBy("tab", "class_id").agg(F.count("*").alias("n"))
    out = members.join(root, ["tab", "class_id"], "left").join(ends, ["tab", "class_id"], "left")
    return out.select("tab", "rec_id", "class_id", F.coalesce("root", "class_id").alias("group_id"), F.coalesce("n", F.lit(0)).alias("n_links"))
