"""Character-level bidirectional LSTM with CRF transitions, in numpy.

The network reads character classes (not code points), so its size does not
depend on the scripts in the data.  ``Tagger`` decodes texts of any length:
overlapping windows go through the LSTM as one batch, each position keeps the
emission scores of the window in which it lies furthest from an edge, and one
Viterbi pass over the whole text reconciles the windows globally.
"""

from __future__ import annotations

import io
import pkgutil
import unicodedata

import numpy as np

TYPES = ("email", "phone", "name", "id_number", "address")
#: 0 is "outside"; type k has the labels 2k+1 (first character) and 2k+2 (a later one).
N_LABELS = 1 + 2 * len(TYPES)
NEG = np.float32(-1e4)

# Character classes: 1-95 printable ASCII, then the classes below. 0 is padding.
NEWLINE, TAB, SPACE_LIKE, INVISIBLE, UPPER, LOWER, DIGIT, MARK, OTHER = range(96, 105)
N_CLASSES = 105
#: Look-alike letters of other scripts, by the ASCII letter they resemble (fixed values).
LOOK_ALIKE = dict(zip("АВЕЅІЈКМНОРСТХУаеѕіјорсхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν", "ABESIJKMHOPCTXYaesijopcxyABEZHIKMNOPTYXoav", strict=True))


def _classify(code: int) -> int:
    c = chr(code)
    if 32 <= code < 127:
        return code - 31
    if c in "\n\r\x0b\x0c  ":
        return NEWLINE
    if c == "\t":
        return TAB
    if c in LOOK_ALIKE:
        return ord(LOOK_ALIKE[c]) - 31
    category = unicodedata.category(c)
    if category == "Zs":
        return SPACE_LIKE
    if category in ("Cf", "Cc"):
        return INVISIBLE
    if category[0] == "M":
        return MARK
    base = unicodedata.normalize("NFKD", c)[:1]
    if base and 32 < ord(base) < 127:
        return ord(base) - 31
    return {"Lu": UPPER, "Lt": UPPER, "Ll": LOWER, "Nd": DIGIT}.get(category, OTHER)


_TABLE: list[np.ndarray] = []


def class_table() -> np.ndarray:
    if not _TABLE:
        table = np.full(0x110000, OTHER, np.uint8)
        table[:0x3000] = [_classify(c) for c in range(0x3000)]
        table[0x3000] = SPACE_LIKE
        table[0xFE00:0x10000] = [_classify(c) for c in range(0xFE00, 0x10000)]
        _TABLE.append(table)
    return _TABLE[0]


def encode(text: str) -> np.ndarray:
    """Character classes of a text, one for each code point."""
    return class_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def lstm(table: np.ndarray, recurrent: np.ndarray, x: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states [T, B, H] of character classes x [T, B]; gates are input, forget, output, candidate. keep gets what training needs."""
    steps, batch = x.shape
    h_size = recurrent.shape[0]
    h, c = np.zeros((batch, h_size), np.float32), np.zeros((batch, h_size), np.float32)
    out = np.empty((steps, batch, h_size), np.float32)
    for t in range(steps):
        z = h @ recurrent
        z += table[x[t]]
        gates = z[:, : 3 * h_size]
        gates *= np.float32(0.5)
        np.tanh(z, out=z)
        gates *= np.float32(0.5)
        gates += np.float32(0.5)
        i, f, o, g = z[:, :h_size], z[:, h_size : 2 * h_size], z[:, 2 * h_size : 3 * h_size], z[:, 3 * h_size :]
        before = c
        c = f * c
        c += i * g
        tc = np.tanh(c)
        h = np.multiply(o, tc, out=out[t])
        if keep is not None:
            keep.append((z, before, tc))
    return out


def backward_order(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Places [T, B] that turn each column within its own length and leave the rest; doing it again turns it back."""
    t = np.arange(steps)[:, None]
    return np.where(t < lengths, lengths - 1 - t, t)


class Tagger:
    """Finds typed spans. Windows, stride and batch are fixed parameters of the model, not limits on the text."""

    WINDOW, STRIDE, BATCH = 224, 176, 384

    def __init__(self, weights: dict[str, np.ndarray]):
        self.how = str(weights.get("how", ""))  # how they were trained
        self.w = {k: v.astype(np.float32) for k, v in weights.items() if k != "how"}

    @classmethod
    def load(cls) -> Tagger:
        raw = pkgutil.get_data(__package__, "pii_weights.npz")
        return cls(dict(np.load(io.BytesIO(raw))))

    def emissions(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Scores [T, B, labels] of windows x [T, B]; each is read backward from its own end, so that what fills it up changes nothing."""
        w = self.w
        turn, columns = backward_order(lengths, len(x)), np.arange(x.shape[1])
        forward = lstm(w["table_f"], w["rec_f"], x)
        backward = lstm(w["table_b"], w["rec_b"], x[turn, columns])[turn, columns]
        h = w["rec_f"].shape[0]
        return forward @ w["out"][:h] + backward @ w["out"][h:] + w["bias"]

    def scores(self, texts: list[str]) -> list[np.ndarray]:
        """Emission scores [length, labels] of each text, stitched from its windows."""
        codes = [encode(t) for t in texts]
        out = [np.empty((len(c), N_LABELS), np.float32) for c in codes]
        places = [(i, at) for i, c in enumerate(codes) if len(c) for at in range(0, max(1, len(c) - (self.WINDOW - self.STRIDE)), self.STRIDE)]
        places.sort(key=lambda p: min(self.WINDOW, len(codes[p[0]]) - p[1]))
        margin = (self.WINDOW - self.STRIDE) // 2
        for first in range(0, len(places), self.BATCH):
            group = places[first : first + self.BATCH]
            longest = max(min(self.WINDOW, len(codes[i]) - at) for i, at in group)
            x, lengths = np.zeros((longest, len(group)), np.uint8), np.zeros(len(group), np.int64)
            for k, (i, at) in enumerate(group):
                part = codes[i][at : at + self.WINDOW]
                x[: len(part), k] = part
                lengths[k] = len(part)
            e = self.emissions(x, lengths)
            for k, (i, at) in enumerate(group):
                n = len(codes[i])
                start = at + margin if at else 0
                stop = n if at + self.WINDOW >= n else at + self.WINDOW - margin
                out[i][start:stop] = e[start - at : stop - at, k]
        return out

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text its spans (start, end, type), in order and apart from one another."""
        found: list[list[tuple[int, int, str]]] = [[] for _ in texts]
        scores = self.scores(texts)
        order = sorted((i for i, s in enumerate(scores) if len(s)), key=lambda i: len(scores[i]))
        first = 0
        while first < len(order):
            group = [order[first]]
            while len(group) < 512 and first + len(group) < len(order) and len(scores[order[first + len(group)]]) * (len(group) + 1) < 400_000:
                group.append(order[first + len(group)])
            first += len(group)
            for i, labels in zip(group, viterbi([scores[i] for i in group], self.w["trans"]), strict=True):
                found[i] = spans(labels)
        return found


def viterbi(scores: list[np.ndarray], trans: np.ndarray) -> list[np.ndarray]:
    """The best label sequence of each text under emission and transition scores; trans[N_LABELS] are the start scores."""
    longest, batch = max(map(len, scores)), len(scores)
    e = np.zeros((longest, batch, N_LABELS), np.float32)
    for k, s in enumerate(scores):
        e[: len(s), k] = s
    best = e[0] + trans[N_LABELS]
    back = np.empty((longest, batch, N_LABELS), np.uint8)
    lengths = np.array([len(s) for s in scores])
    last = np.empty(batch, np.int64)
    into = np.ascontiguousarray(trans[:N_LABELS].T)  # [to, from]
    for t in range(1, longest + 1):
        ended = np.nonzero(lengths == t)[0]
        last[ended] = best[ended].argmax(1)
        if t == longest:
            break
        both = best[:, None, :] + into
        back[t] = both.argmax(2)
        best = both.max(2)
        best += e[t]
    out = np.zeros((longest, batch), np.uint8)
    label = np.zeros(batch, np.int64)
    rows = np.arange(batch)
    for t in range(longest - 1, -1, -1):
        label = np.where(lengths == t + 1, last, label)
        out[t] = label
        if t:
            label = np.where(lengths > t, back[t, rows, label], label)
    return [out[: n, k] for k, n in enumerate(lengths)]


def spans(labels: np.ndarray) -> list[tuple[int, int, str]]:
    found, open_at, kind = [], -1, -1
    hot = np.nonzero(labels)[0]
    previous = -2
    for p in hot:
        label = int(labels[p])
        k, begins = (label - 1) // 2, label % 2 == 1
        if open_at >= 0 and (p != previous + 1 or begins or k != kind):
            found.append((open_at, previous + 1, TYPES[kind]))
            open_at = -1
        if open_at < 0:
            open_at, kind = int(p), k
        previous = int(p)
    if open_at >= 0:
        found.append((open_at, previous + 1, TYPES[kind]))
    return found
