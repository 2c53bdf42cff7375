"""Words that a wrong decoding or a broken font garbled, and what they meant.

The garbled sequences of all encoding pairs are computed once from Python's
codecs. Sequences of several characters are proof by themselves and are matched
by one automaton; a span is replaced only where it matches, so correct text
around it stays. Single characters (one byte read as another) prove nothing
alone: such a word counts only when its restored form is an established word of
the collection and the word itself is not, or when a sign stands between letters
that never does, which proves the damage but not what was meant.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.session import cut, ship, spread

# Encodings (fixed values): UTF-8 read by one byte or several, and pairs of one-byte encodings.
NARROW = ["cp1252", "latin-1", "mac-roman", "cp437", "cp850", "cp1251", "koi8-r", "cp866", "cp1250", "iso8859-2", "iso8859-15", "cp1253", "cp737"]
MULTIBYTE = ["gbk", "cp932", "big5", "euc-kr"]
SINGLE = [
    *((a, b) for a in ("mac-roman", "cp437", "cp850") for b in ("cp1252", "latin-1")),
    *((a, b) for a in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac-cyrillic") for b in ("cp1252", "latin-1")),
    *((a, b) for a in ("koi8-r", "cp866", "iso8859-5", "mac-cyrillic") for b in ("cp1251",)),
    ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("cp1252", "mac-roman"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "cp1251"), ("cp1250", "cp1252"), ("iso8859-2", "cp1252"), ("iso8859-2", "latin-1"), ("cp1253", "cp1252"), ("iso8859-7", "latin-1"), ("cp1252", "cp1250"), ("cp852", "cp1252"),
]
#: Characters that texts are made of besides ASCII: letters of European scripts and printers' marks.
REPERTOIRE = [chr(c) for r in ((0xA0, 0x180), (0x384, 0x3D0), (0x401, 0x402), (0x404, 0x405), (0x406, 0x408), (0x410, 0x450), (0x451, 0x452), (0x454, 0x455), (0x456, 0x458), (0x490, 0x492)) for c in range(*r) if chr(c).isprintable() or c == 0xA0] + list("“”‘’‚„–—…•€™†‡‰‹›−№ﬁﬂ′″ŒœŠšŽžŸƒ")

#: Characters of three or four bytes in UTF-8: Vietnamese letters, marks, currencies, arrows, mathematical and other signs, emoji.
WIDER = [chr(c) for r in ((0x1E00, 0x1F00), (0x2010, 0x2060), (0x20A0, 0x20C1), (0x2100, 0x2150), (0x2190, 0x2400), (0x2500, 0x2800), (0x1F300, 0x1FB00)) for c in range(*r) if chr(c).isprintable()]


def _read(text: str, wrote: str, read: str) -> str | None:
    """The text as it looks when bytes of one encoding are read as another; undefined bytes become C1 controls as browsers do."""
    try:
        raw = text.encode(wrote)
    except UnicodeError:
        return None
    out = []
    for b in raw:
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeError:
            if b < 0x80 or b > 0x9F:
                return None
            out.append(chr(b))
    return "".join(out)


def sequences() -> dict[str, str]:
    """Garbled sequence of several characters to the character meant, once and twice misread. Of two meanings the commoner encoding's holds."""
    found: dict[str, str] = {}
    for read in NARROW:
        for c in REPERTOIRE:
            once = _read(c, "utf-8", read)
            if not once or len(once) < 2 or once.isascii():
                continue
            found.setdefault(once, c)
            twice = _read(once, "utf-8", read)
            if twice:
                found.setdefault(twice, c)
    for read in NARROW:
        for c in WIDER:
            once = _read(c, "utf-8", read)
            twice = once and _read(once, "utf-8", read)
            for seen in (once, twice):
                if seen and not (seen.isalpha() and seen[1:].islower()):  # what may be letters of a word
                    found.setdefault(seen, c)
    return found


def singles() -> list[tuple[str, str, dict[str, str]]]:
    """For each pair of one-byte encodings the characters it turns into others."""
    out = []
    for wrote, read in SINGLE:
        table = {}
        for c in REPERTOIRE:
            seen = _read(c, wrote, read)
            if seen and len(seen) == 1 and seen not in "\xa0\xad":  # spaces and soft hyphens prove nothing
                table[seen] = c  # itself, where both encodings agree
        out.append((wrote, read, table))
    return out


_STATE: dict[str, object] = {}


def _state() -> dict[str, object]:
    if not _STATE:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for seen, meant in sequences().items():
            automaton.add_word(seen, (seen, meant))
        automaton.make_automaton()
        _STATE.update(automaton=automaton, singles=singles())
    return _STATE


CID = regex.compile(r"(?:\(cid:\d+\))+")
LOST = regex.compile("[\ufffd\ue000-\uf8ff\x00-\x08\x0e-\x1f]")
C1 = regex.compile("[\x80-\x9f]")
#: Signs that never stand between letters.
SIGN = regex.compile(r"\p{L}[†‡‰‚„¢£¤¥¦¨¬±¶¸¿¡‹›˜ˆ]\p{Ll}")
POSSESSIVE = regex.compile(r"['’]s[^\p{L}\p{N}]*$")
EDGE = regex.compile(r"^([^\p{L}\p{N}]*)(.*?)([^\p{L}\p{N}]*)$", regex.S)
#: Marks that printers set before and after a word, besides ASCII ones.
ASCII_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEFORE, AFTER = set("“‘„–—…") | set(ASCII_MARKS), set("”’“–—…") | set(ASCII_MARKS)
ONE_SCRIPT = regex.compile(r"(?:\p{Latin}|\p{M}|[^\p{L}])*|(?:\p{Cyrillic}|[^\p{L}])*|(?:\p{Greek}|[^\p{L}])*")
RUN = regex.compile(r"[^\x00-\x7f]{2,}")
LOOK_ALIKE = set("АВЕЅІЈКМНОРСТХУаеѕіјорсхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαν")


def _font(text: str) -> str:
    """Letters of private use back to those of a font with shifted codes, where the shift is plain: U+E000 above the code, or (cid:) 3 above it."""
    def cid(m: regex.Match) -> str:
        codes = [int(x) - 3 for x in regex.findall(r"\d+", m[0])]
        return "".join(map(chr, codes)) if all(32 <= c < 0x530 and chr(c).isprintable() for c in codes) else m[0]

    text = CID.sub(cid, text)
    private = [c for c in text if "\ue000" <= c <= "\uf8ff"]
    if private:
        low = [ord(c) - 0xE000 for c in private]
        if all(0x20 <= c < 0x180 for c in low):
            # Codes past U+0100 stand for Latin Extended-A beside plain letters, and by themselves for Cyrillic or Greek less 0x300.
            shift = 0x300 if len(low) > 1 and all(c >= 0x100 or c < 0x41 for c in low) else 0
            if shift or min(low) < 0x100:
                text = "".join(chr(ord(c) - 0xE000 + (shift if ord(c) >= 0xE100 else 0)) if "\ue000" <= c <= "\uf8ff" else c for c in text)
    return text


def proven(text: str) -> tuple[bool, str | None]:
    """Whether sequences prove the text garbled, and the text with just those spans replaced, or None where it may mean several."""
    if CID.search(text) or LOST.search(text):
        return True, _font(text)
    state, hit, out = _state(), False, text
    for _ in range(2):  # what was misread twice by different readers
        matches, last = [], 0
        for end, (seen, meant) in state["automaton"].iter(out):
            matches.append((end - len(seen) + 1, end + 1, meant))
        if not matches:
            break
        hit = True
        matches.sort(key=lambda m: (m[0], -m[1]))
        parts = []
        for s, e, meant in matches:
            if s >= last:
                parts += [out[last:s], meant]
                last = e
        out = "".join(parts) + out[last:]
    if not hit:  # scripts whose many characters the automaton leaves out: a run that is valid UTF-8 when read back
        for m in RUN.finditer(text):
            for read in NARROW:
                try:
                    meant = m[0].encode(read).decode("utf-8")
                except UnicodeError:
                    continue
                if all(c.isalnum() for c in meant) and not m[0].isalpha() and (len(meant) > 1 or len(m[0]) > 2 and not set(m[0][1:]) <= AFTER | set("»›«‹")):
                    return True, out.replace(m[0], meant)
        several = multibyte(text)
        if several:
            return True, several[0] if len(several) == 1 else None
    return hit or bool(C1.search(out)), out


ASIAN = regex.compile(r"[\p{Han}\p{Hangul}\p{Katakana}\p{Hiragana}]")
BESIDE = regex.compile(r"[A-Za-z][\p{Han}\p{Hangul}\p{Katakana}\p{Hiragana}]|[\p{Han}\p{Hangul}\p{Katakana}\p{Hiragana}][A-Za-z]")
EUROPEAN = regex.compile(r"[\p{Latin}\p{Cyrillic}\p{Greek}\x20-\x7e\xa0-\xbf‐-⁞€™№]+")


def multibyte(text: str) -> list[str]:
    """The European texts whose UTF-8 bytes, read by an encoding of several bytes, or whose ASCII bytes, read in pairs, are this East Asian one; of two byte orders both.

    East Asian text is only rarely valid when read back; beside Latin letters one
    character meant is enough, else it takes three.
    """
    if not ASIAN.search(text):
        return []
    for read in MULTIBYTE:
        try:
            meant = text.encode(read).decode("utf-8")
        except UnicodeError:
            continue
        if EUROPEAN.fullmatch(meant) and ONE_SCRIPT.fullmatch(meant) and (BESIDE.search(text) or sum(c.isalpha() for c in meant) >= 3):
            return [meant]
    raws = [text.encode(read, "surrogatepass") for read in ("utf-16-le", "utf-16-be")] if len(text) >= 3 else []
    return [raw.decode("ascii") for raw in raws if regex.fullmatch(rb"[A-Za-z][a-z]+[.,;:!?]?", raw)]


def meanings(text: str) -> list[str]:
    """What the text would mean if its bytes were read by each wrong one-byte encoding; all characters of the pair are turned, and something must change."""
    found = []
    for _, _, table in _state()["singles"]:
        changed = "".join(table.get(c, c) for c in text)
        if changed != text and all(c.isascii() or c in table for c in text):
            found.append(changed)
    return list(dict.fromkeys(found))


def kernels(meant: str) -> list[str]:
    """The words by which a meaning is looked up: the text without ASCII marks around it, and, where only printers' marks stand around a word, that word without a possessive."""
    whole = meant.strip(ASCII_MARKS).lower()
    before, word, after = EDGE.fullmatch(POSSESSIVE.sub("", meant)).groups()
    bare = word.lower() if set(before) <= BEFORE and set(after) <= AFTER else ""
    return [k for k in dict.fromkeys((whole, bare)) if k]


def doubts(text: str) -> list[tuple[str, str, str]]:
    """(meaning, word to look up, the text's own word) of each reading that is not garbled itself."""
    own = text.strip(ASCII_MARKS).lower()
    out = []
    for meant in meanings(text):
        changed = {a for a, b in zip(text, meant, strict=True) if a != b}
        if not changed <= LOOK_ALIKE and ONE_SCRIPT.fullmatch(meant) and not proven(meant)[0]:
            out += [(meant, k, own) for k in kernels(meant) if k != own]
    return out


def examine(texts: pd.Series) -> pd.DataFrame:
    """certain, restored, and the one-byte readings (meaning, word to look up, the word as it stands)."""
    rows = []
    for t in texts:
        certain, restored = proven(t)
        if not certain and SIGN.search(t):
            certain, restored = True, None
        guesses = doubts(t)
        rows.append((certain, restored, guesses))
    return pd.DataFrame(rows, columns=["certain", "restored", "guesses"])


def garbled_words(words: DataFrame, key: str = "word_id", established: int = 3, broadcast_rows: int = 500_000) -> DataFrame:
    """The garbled words: key, doc_id, page, text, restored (null where the meaning is unknown).

    Words of recognised pages (confidence above 0, or null: native words always
    have one) and null or empty texts are never garbled. Plain ASCII holds no garbled
    sequence but ``(cid:n)``, so only other texts are examined, each distinct
    text once. A text under one-byte suspicion counts when its restored core
    occurs at least ``established`` times in the collection and more often than the
    core as it stands, or, with restored null, when a sign that never stands between
    letters does. The words asked for go to all executors only while there
    are at most ``broadcast_rows`` of them, else both sides are shuffled. Re-sent words count once; further columns are ignored.
    """
    ship(words.sparkSession)
    words = words.select(key, "doc_id", "page", "text", "confidence")
    native = words.where("confidence = 0 and text is not null")
    odd = F.col("text").rlike(r"[^\x00-\x7F]|\(cid:\d+\)|[\x00-\x08\x0e-\x1f]")
    suspects = native.where(odd)
    kind = "certain boolean, restored string, guesses array<struct<meant:string,core:string,own:string>>"
    distinct = suspects.groupBy("text").agg(F.count("*").alias("n"))
    # Read back from a checkpoint by the three steps that follow, so that each text is examined once.
    examined = cut(spread(distinct, "text").select("text", F.pandas_udf(lambda s: examine(s), kind)("text").alias("x")).select("text", "x.*"))
    certain = examined.where("certain").select("text", "restored")
    doubtful = examined.where("size(guesses) > 0").select("text", F.explode("guesses").alias("g")).select("text", "g.*")
    # How often the cores occur: only the words asked for are counted.
    asked = doubtful.select(F.explode(F.array("core", "own")).alias("w")).distinct()
    bare = F.lower(F.btrim("text", F.lit(ASCII_MARKS)))
    asked = F.broadcast(asked) if asked.count() <= broadcast_rows else asked
    counted = words.where("text is not null").groupBy("text").agg(F.count("*").alias("n"))  # before any join, so that a common word is one row
    known = counted.select(bare.alias("w"), "n").join(asked, "w", "left_semi").groupBy("w").agg(F.sum("n").alias("n"))
    judged = (
        doubtful.join(known.select(F.col("w").alias("core"), F.col("n").alias("meant_n")), "core")
        .join(known.select(F.col("w").alias("own"), F.col("n").alias("own_n")), "own", "left")
        .where((F.col("meant_n") >= established) & (F.col("meant_n") > F.when(F.col("core").rlike(r"[^\x00-\x7F]"), 2).otherwise(20) * F.coalesce("own_n", F.lit(0))))
        .groupBy("text")
        .agg(F.max(F.struct("meant_n", F.col("meant").alias("restored"))).alias("best"))
        .select("text", "best.restored")
    )
    lost = F.col("restored").rlike(r"[\uFFFD\uE000-\uF8FF\x00-\x08\x0e-\x1f\x80-\x9f]|\(cid:")
    # An established one-byte reading of the whole word explains more than sequences within it.
    both = certain.join(judged.withColumnRenamed("restored", "judged"), "text", "full_outer").select("text", F.coalesce("judged", "restored").alias("restored"))
    verdict = both.select("text", F.when(~lost, F.col("restored")).alias("restored"))
    found = suspects.select(key, "doc_id", "page", "text").join(verdict, "text")
    return found.select(key, "doc_id", "page", "text", "restored").dropDuplicates([key])
