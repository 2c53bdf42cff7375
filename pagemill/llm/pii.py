"""Personal items in free text: found by the character tagger, replaced by typed placeholders."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.pii_model import Tagger
from pagemill.session import ship, spread

SPAN = "array<struct<start:int,stop:int,pii_type:string>>"


def personal_items(records: DataFrame, key: str = "rec_id") -> DataFrame:
    """(tab, key, text, redacted, items) of each record (tab, key, text) in which the tagger finds personal items.

    items lists start, stop (code point offsets) and type, in order; redacted is
    the text with each item replaced by its type in brackets and all else
    unchanged. Texts are read whole, whatever their length, and each distinct text once,
    so records of equal text get equal rows. Null and empty texts, and texts
    without an item, give no row. A record that occurs again gives its row
    again; further columns are ignored.
    """
    ship(records.sparkSession)

    def tag(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = Tagger.load()
        for b in batches:
            texts = b.text.tolist()
            rows = []
            for i, (text, found) in enumerate(zip(texts, tagger.decode(texts), strict=True)):
                found = trimmed(text, found)
                if found:
                    rows.append((b.h1.iat[i], b.h2.iat[i], text, redact(text, found), [{"start": s, "stop": e, "pii_type": t} for s, e, t in found]))
            yield pd.DataFrame(rows, columns=["h1", "h2", "text", "redacted", "items"])

    # Two 64-bit hashes stand for a text in the join that gives the items back to the records, so that their texts stay where they are.
    hashes = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), F.reverse("text")).alias("h2")]
    rows = records.where(f"{key} is not null and text is not null and text <> ''")
    texts = rows.select("text").distinct()  # copies are gone before the shuffle
    tagged = spread(texts.select("text", *hashes), "text", least=4).mapInPandas(tag, f"h1 bigint, h2 bigint, text string, redacted string, items {SPAN}")
    return rows.select("tab", key, *hashes).join(tagged, ["h1", "h2"]).select("tab", key, "text", "redacted", "items")


def trimmed(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans without white space at their ends; parts of one type with at most a character between them are joined; names that end before or at a particle go on to the capital after it; spans that cannot be an item of their type are dropped."""
    out: list[tuple[int, int, str]] = []
    for s, e, t in found:
        while s < e and text[s].isspace():
            s += 1
        while s < e and text[e - 1].isspace():
            e -= 1
        if out and out[-1][2] == t and s - out[-1][1] <= 1:
            out[-1] = (out[-1][0], e, t)
        elif e > s:
            out.append((s, e, t))
    for i, (s, e, t) in enumerate(out):
        if t == "name" and not possible(text[s:e], t) and (m := PARTED.match(text, s)) and m.end() > e and (i + 1 == len(out) or m.end() <= out[i + 1][0]):
            out[i] = (s, m.end(), t)
    return [x for x in out if possible(text[x[0] : x[1]], x[2])]


#: Marks that stand for digits where they were misread.
DIGIT = regex.compile(r"[\p{Nd}OoIl|SBZ]")
AT = regex.compile(r"@|＠|\bat\b|\(at\)|\[at\]|\ba\b", regex.I)
#: Words in lower case that stand between the parts of a name.
PARTICLES = r"(?:van|von|vom|zu|zur|zum|de|der|den|del|della|dello|di|da|do|dos|das|du|des|la|las|le|lo|los|ter|ten|te|op|af|av|bin|ibn|ben|al|el)"
#: Two capitals; words without capitals throughout; letters of a script that has no capitals.
NAME = regex.compile(
    r"(?:\p{Lu}|[|1l0@(])[\p{L}\p{M}\p{Cf}'’.0-9|+@(-]*,?(?:[\s\u200b\u2060\ufeff]+|-\s*)(?:" + PARTICLES + r"\s+)*[\p{Lu}|0-9@(]"
    r"|^\p{Ll}[\p{Ll}\p{M}'’-]+(?:\s+\p{Ll}[\p{Ll}\p{M}'’-]+){1,3}$"
    r"|\p{Lo}\p{M}*[\s·・]*\p{Lo}",
    regex.S,
)
PARTED = regex.compile(r"\p{Lu}[\p{L}\p{M}'’.-]*(?:\s+" + PARTICLES + r")+\s+\p{Lu}[\p{L}\p{M}'’-]*\p{L}")
DATE = regex.compile(r"\d{4}-\d\d-\d\d|\d{1,2}[./]\d{1,2}[./]\d{4}")


def possible(item: str, kind: str) -> bool:
    """What any item of a kind has: an e-mail address an at sign or its word, a phone number seven digits, an identity number five, neither a date alone, a postal address three words and a digit, a name two words that begin with capitals, particles between them or not, two to four words without any, or two letters of a script without capitals."""
    if kind == "email":
        return len(item) >= 6 and AT.search(item) is not None
    if kind == "name":
        return NAME.search(item) is not None
    if kind == "address":
        return regex.search(r"\p{Nd}", item) is not None and len(item.split()) >= 3
    return len(DIGIT.findall(item)) >= {"phone": 7, "id_number": 5}[kind] and DATE.fullmatch(item) is None


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for s, e, t in found:
        parts += [text[at:s], f"[{t.upper()}]"]
        at = e
    return "".join([*parts, text[at:]])


def item_types(found: DataFrame, key: str = "rec_id") -> DataFrame:
    """(tab, key, pii_type), each once."""
    return found.select("tab", key, F.explode("items").alias("i")).select("tab", key, "i.pii_type").distinct()
