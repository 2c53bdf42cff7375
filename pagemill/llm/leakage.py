"""Documents that contain passages of held-out test items.

The test items form a BM25 inverted index: a posting list for each word, cut
into blocks of items with the highest impact in each block. Every document is cut
into short overlapping passages, each of which queries the index by block-max
WAND, for many passages at a time in arrays: the words of a passage in the order of their
highest impacts have a pivot, before which they cannot reach the least
threshold of any item by themselves; only the lists from the pivot on open blocks, a
block is entered only where the block maxima of all words reach its least
threshold, and only its items are scored. An item's threshold is the least score
that any ``run`` consecutive words of it can have, so nothing that holds
such a run is missed; a look at the words themselves then decides.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import ship, spread

WORD = re.compile(r"[^\W_]+")
K1, B = 1.2, 0.75
ANSWER = re.compile(r"^\W*(?:answer|antwort|réponse|respuesta|ответ|odpowiedź)\b\W*", re.I | re.M)
#: The multiplier of the hash of a run (any odd number does: runs are compared word by word in the end).
MIX = 0x9E3779B97F4A7C15


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def spans_of(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each span, one span after the other."""
    if not len(starts):
        return np.empty(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) - np.repeat(ends - lengths - starts, lengths)


class Table:
    """Values of distinct keys of 0 or more, by open addressing in arrays at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 1)
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.zeros(size, np.float32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, size + np.arange(len(slot))), return_index=True)
            first = first[free[first]]
            self.keys[slot[first]], self.values[slot[first]] = keys[left[first]], values[left[first]]
            rest = np.delete(np.arange(len(left)), first)
            left, slot = left[rest], (slot[rest] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """The values of the wanted keys, 0 where there are none."""
        slot = self._slot(wanted)
        there = self.keys[slot]
        out = np.where(there == wanted, self.values[slot], np.float32(0))
        left = np.nonzero((there != wanted) & (there >= 0))[0]
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & (len(self.keys) - 1)
            there = self.keys[slot]
            hit = there == wanted[left]
            out[left[hit]] = self.values[slot[hit]]
            on = ~hit & (there >= 0)
            left, slot = left[on], slot[on]
        return out


class Index:
    """Posting lists with block maxima, thresholds, and the runs of the items. Its size is proportional to the words of the items."""

    def __init__(self, items: list[tuple[int, str]], run: int, block: int = 2):
        tokens = [(i, words(t), t) for i, t in items]
        df = Counter(w for _, ws, _ in tokens for w in set(ws))
        n = len(items)
        # Items in the order of their rarest words lie with their like, which makes block bounds tight.
        tokens = sorted(((i, ws, t) for i, ws, t in tokens if len(ws) >= run), key=lambda x: (sorted(set(x[1]), key=lambda w: (df[w], w))[:3], x[0]))
        self.run, self.block, self.n = run, block, len(tokens)
        self.ids = np.array([i for i, _, _ in tokens], np.int64)
        self.vocabulary = {w: k for k, w in enumerate(df)}
        self.offsets = np.cumsum([0] + [len(ws) for _, ws, _ in tokens])
        self.flat = np.array([self.vocabulary[w] for _, ws, _ in tokens for w in ws], np.int32)
        self.questions = np.array([len(words(t[: m.start()])) if (m := ANSWER.search(t)) else len(ws) for _, ws, t in tokens], np.int32)
        if not self.n:
            return
        owner = np.repeat(np.arange(self.n), np.diff(self.offsets))
        # Postings: word and item with the item's impact on the score.
        posting, count = np.unique(self.flat.astype(np.int64) * self.n + owner, return_counts=True)
        word, item = posting // self.n, posting % self.n
        often = np.array(list(df.values()), float)[word]
        length = np.diff(self.offsets)
        norm = K1 * (1 - B + B * length / length.mean())
        impact = (np.log(1 + (n - often + 0.5) / (often + 0.5)) * count * (K1 + 1) / (count + norm[item])).astype(np.float32)
        # Runs: where each begins, and the least score of each item's, by which its impacts are divided, so that 1 is the threshold of all.
        impacts = Table(posting, impact)
        begins = spans_of(self.offsets[:-1], np.maximum(length - run + 1, 0))
        of = owner[begins]
        least = np.full(self.n, np.inf, np.float32)
        for part in np.array_split(np.arange(len(begins)), max(1, len(begins) // 100_000)):
            codes = np.sort(self.flat[begins[part][:, None] + np.arange(run)], 1)
            score = impacts((codes.astype(np.int64) * self.n + of[part][:, None]).ravel()).reshape(codes.shape)
            score[:, 1:][codes[:, 1:] == codes[:, :-1]] = 0  # a word counts once
            np.minimum.at(least, of[part], score.sum(1))
        impact /= least[item] * np.float32(0.9999)  # for rounding
        self.impacts = Table(posting, impact)
        # Blocks of each list with their highest impacts, where each list begins, and its highest impact.
        self.blocks = -(-self.n // block)
        self.block_posting, first = np.unique(word * self.blocks + item // block, return_index=True)
        self.block_impacts = Table(self.block_posting, np.maximum.reduceat(impact, first))
        self.begin = np.searchsorted(self.block_posting, np.arange(len(df) + 1) * self.blocks)
        self.highest = np.zeros(len(df) + 1, np.float32)  # the last is of words that no item has
        np.maximum.at(self.highest, word, impact)
        order = np.argsort(self.hashes(self.flat, begins), kind="stable")
        self.runs, self.run_item = begins[order].astype(np.int32), of[order].astype(np.int32)
        self.run_hash, first, n_same = np.unique(self.hashes(self.flat, self.runs), return_index=True, return_counts=True)
        self.first_run, self.n_same = first.astype(np.int32), n_same.astype(np.int32)

    def hashes(self, codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
        h = np.zeros(len(begins), np.uint64)
        for k in range(self.run):
            h = (h + codes[begins + k].astype(np.uint64) + np.uint64(1)) * np.uint64(MIX)
            h ^= h >> np.uint64(29)
        return h

    def candidates(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(passage, item) for all items whose threshold a passage reaches; passages are spans of word codes."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if not len(starts):
            return none
        # Passages that could not reach any item's threshold even if each word were at its highest.
        total = np.add.reduceat(self.highest[flat[spans_of(starts, lengths)]], np.cumsum(lengths) - lengths)
        live = np.nonzero(total >= 1)[0]
        if not len(live):
            return none
        passage, word = np.repeat(live, lengths[live]), flat[spans_of(starts[live], lengths[live])].astype(np.int64)
        known = word < len(self.vocabulary)
        pair = np.unique(passage[known] * len(self.vocabulary) + word[known])
        passage, word = pair // len(self.vocabulary), pair % len(self.vocabulary)
        # The pivot: from the lowest on, the words that together stay below the least threshold open no block.
        order = np.lexsort((self.highest[word], passage))
        passage, word = passage[order], word[order]
        first = np.nonzero(np.append(True, passage[1:] != passage[:-1]))[0]
        n_words = np.diff(np.append(first, len(passage)))
        reach = np.cumsum(self.highest[word].astype(float))
        before = np.repeat(reach[first] - self.highest[word[first]], n_words)
        opens = np.nonzero(reach - before >= 1)[0]
        n_blocks = self.begin[word[opens] + 1] - self.begin[word[opens]]
        blocks = self.block_posting[spans_of(self.begin[word[opens]], n_blocks)] % self.blocks
        opened = np.unique(np.repeat(passage[opens], n_blocks) * self.blocks + blocks)
        # Block maxima of all words of the passage.
        at = np.full(len(starts), -1)
        at[passage[first]] = np.arange(len(first))
        row, bound = at[opened // self.blocks], opened % self.blocks
        score = self._sums(word, first[row], n_words[row], bound, self.block_impacts, self.blocks)
        enter = score >= 1
        row, bound = np.repeat(row[enter], self.block), np.repeat(bound[enter], self.block)
        item = bound * self.block + np.tile(np.arange(self.block), int(enter.sum()))
        row, item = row[item < self.n], item[item < self.n]
        score = self._sums(word, first[row], n_words[row], item, self.impacts, self.n)
        found = score >= 1
        return passage[first[row[found]]], item[found]

    @staticmethod
    def _sums(word: np.ndarray, first: np.ndarray, n: np.ndarray, column: np.ndarray, values: Table, width: int) -> np.ndarray:
        """The sum over a passage's words of what the lists say of a block or an item."""
        out = np.zeros(len(first), np.float32)
        for part in np.array_split(np.arange(len(first)), max(1, int(n.sum()) // 200_000)):  # so many at a time
            if len(part):
                got = values(word[spans_of(first[part], n[part])] * width + np.repeat(column[part], n[part]))
                out[part] = np.add.reduceat(got, np.cumsum(n[part]) - n[part])
        return out

    def search(self, texts: list[str | None], length: int = 32) -> Iterator[tuple[int, dict[int, set[int]]]]:
        """(text, {item: numbers of its runs found}) of every text with a run of an item."""
        if not self.n:
            return
        get, other = self.vocabulary.get, len(self.vocabulary)
        codes = [np.array([get(w, other) for w in words(t)], np.int32) for t in texts]
        sizes = np.array([len(c) for c in codes])
        flat = np.concatenate([*codes, np.empty(0, np.int32)])
        offsets = np.cumsum(sizes) - sizes
        n_passages = np.where(sizes >= self.run, np.maximum(0, sizes - self.run) // (length - self.run + 1) + 1, 0)
        owner = np.repeat(np.arange(len(texts)), n_passages)
        inside = spans_of(np.zeros(len(texts), np.int64), n_passages) * (length - self.run + 1)
        starts, lengths = offsets[owner] + inside, np.minimum(length, sizes[owner] - inside)
        hits: dict[int, dict[int, set[int]]] = {}
        for at in range(0, len(starts), 4096):
            passages, items = self.candidates(flat, starts[at : at + 4096], lengths[at : at + 4096])
            # The runs of the passages that retrieved an item, against those items alone.
            some = np.unique(passages)
            n_runs = lengths[at + some] - self.run + 1
            passage, begins = np.repeat(some, n_runs), spans_of(starts[at + some], n_runs)
            h = self.hashes(flat, begins)
            place = np.minimum(np.searchsorted(self.run_hash, h), len(self.run_hash) - 1)
            same = np.nonzero(self.run_hash[place] == h)[0]
            n_same = self.n_same[place[same]]
            entry, at_run = spans_of(self.first_run[place[same]], n_same), np.repeat(same, n_same)
            retrieved = np.isin(passage[at_run] * self.n + self.run_item[entry], passages * self.n + items)
            entry, at_run = entry[retrieved], at_run[retrieved]
            equal = (self.flat[self.runs[entry][:, None] + np.arange(self.run)] == flat[begins[at_run][:, None] + np.arange(self.run)]).all(1)
            for t, e in zip(owner[at + passage[at_run[equal]]].tolist(), entry[equal].tolist(), strict=True):
                hits.setdefault(t, {}).setdefault(int(self.run_item[e]), set()).add(int(self.runs[e]))
        yield from sorted(hits.items())

    def report(self, item: int, found: set[int]) -> tuple[int, int, float, bool, bool]:
        """n_runs, item_runs, share, in_question and in_answer of the runs found of an item; runs that recur in it count once."""
        begin, end = self.offsets[item], self.offsets[item + 1]
        distinct = lambda places: len({self.flat[p : p + self.run].tobytes() for p in places})
        n, total, at = distinct(found), distinct(range(begin, end - self.run + 1)), [p - begin for p in found]
        question, size = self.questions[item], end - begin
        return n, total, n / total, bool(min(at) < question), bool(max(at) + self.run > question and question < size)


def leaked_items(documents: DataFrame, items: DataFrame, run: int = 8, shard_words: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_runs, item_runs, share, in_question, in_answer) of each document and each item of which it has ``run`` consecutive words.

    n_runs counts the distinct runs found of the item_runs that the item has;
    in_question and in_answer tell whether runs lie before or in its part after
    "Answer:" (an item without one is all question). Items of fewer words than
    ``run``, and null or empty texts, match nothing. Ids that occur again with
    the same text count once. Documents may be any number. Up to ``shard_words``
    words of items are one index, built once and broadcast (about 120 bytes a word), in one
    pass over the documents; beyond, there is an index and a pass for each so many.
    """
    spark = documents.sparkSession
    ship(spark)
    shape = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    shards = max(1, math.ceil((shape.agg(F.sum(F.length("text") / 5)).first()[0] or 0) / shard_words))
    rows = spread(documents.where("doc_id is not null and text is not null").select("doc_id", "text"), "doc_id")
    found = []
    for shard in range(shards):
        part = shape if shards == 1 else shape.where(F.pmod(F.hash("item_id"), F.lit(shards)) == shard)
        held = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in part.collect()], run))

        def search(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            index = held.value
            for b in batches:
                ids = b.doc_id.tolist()
                out = [(ids[t], int(index.ids[k]), *index.report(k, runs)) for t, hits in index.search(b.text.tolist()) for k, runs in hits.items()]
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "n_runs", "item_runs", "share", "in_question", "in_answer"])

        found.append(rows.mapInPandas(search, "doc_id bigint, item_id bigint, n_runs int, item_runs int, share double, in_question boolean, in_answer boolean"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.dropDuplicates(["doc_id", "item_id"])
