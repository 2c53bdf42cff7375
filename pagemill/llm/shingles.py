"""Word shingles of texts as 64-bit hashes, and the packed rows in which their frequencies are counted. Plain numpy and Arrow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20
#: Upper bounds of the counts that share a code, from code 1 on: exact ones first, then in steps of a fifth.
COUNTS = np.unique(np.concatenate([np.arange(1, 33), np.geomspace(33, 2**62, 220).astype(np.int64)]))[:254]

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of MurmurHash3, a bijection of uint64."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _chunk(data: np.ndarray, offsets: np.ndarray, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] |= inside[edges]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.flatnonzero(inside)
    place = at - starts[np.cumsum(first)[at] - 1]
    factor = mix(np.arange(1, place.max() + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    h = mix(np.add.reduceat((data[at].astype(np.uint64) + np.uint64(1)) * factor[place], np.flatnonzero(first[at])))
    record = np.searchsorted(offsets, starts, "right") - 1
    size = np.bincount(record, minlength=len(offsets) - 1)
    n = max(len(h) - words + 1, 0)
    s = np.zeros(n, np.uint64)
    for j, c in enumerate(mix(np.arange(11, 11 + words, dtype=np.uint64)) | np.uint64(1)):
        s += h[j : j + n] * c
    whole = (record[:n] == record[words - 1 : words - 1 + n]) & (size[record[:n]] >= least)
    return record[:n][whole], mix(s[whole])


def shingles(texts: pa.Array, words: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(record, hash) of all runs of ``words`` words of the lower-cased texts of ``least`` words or more, in their order, repeats included. Words are divided by space, tab, CR and LF."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    records, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(texts):
        to = max(int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1, at + 1)
        r, s = _chunk(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], words, max(least, words))
        records.append(r + at)
        hashes.append(s)
        at = to
    return np.concatenate(records), np.concatenate(hashes)


def segments(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def pack(numbers: np.ndarray, bits: int) -> bytes:
    """Ascending numbers below 2 ** bits, repeats included, in about log2(2 ** bits / count) + 2 bits each (Elias and Fano)."""
    low = max(bits - int(len(numbers)).bit_length(), 0)
    high = np.zeros((int(numbers[-1]) >> low) + len(numbers), bool)
    high[(numbers >> np.uint64(low)).astype(np.int64) + np.arange(len(numbers))] = True
    rest = (numbers[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(high).tobytes() + np.packbits(rest.astype(np.uint8).ravel()).tobytes()


def unpack(packed: bytes, count: int, bits: int) -> np.ndarray:
    low = max(bits - int(count).bit_length(), 0)
    tail = (count * low + 7) // 8
    data = np.frombuffer(packed, np.uint8)
    high = np.flatnonzero(np.unpackbits(data[: len(data) - tail]))[:count] - np.arange(count)
    rest = np.unpackbits(data[len(data) - tail :], count=count * low).reshape(count, low)
    numbers = high.astype(np.uint64) << np.uint64(low)
    for j in range(low):
        numbers |= rest[:, j].astype(np.uint64) << np.uint64(j)
    return numbers


def codes(counts: np.ndarray) -> np.ndarray:
    """One byte for each count, in its order; 0 stands for one."""
    return np.searchsorted(COUNTS, counts).astype(np.uint8)
