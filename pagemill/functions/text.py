"""Scalar functions over text, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; Spark's trim knows U+0020 alone.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
BULLETS = "•◦▪·–—*-"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trim_space(text: Column | str) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def furniture_key(text: Column | str) -> Column:
    """What running lines of all pages have in common: lower case, digits as ``#``, no white space."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"\p{Nd}", "#"), f"{SPACE}+", "")


def list_marker(text: Column | str) -> Column:
    """struct(marker, rest, ordered) of a list entry, else null.

    A bullet needs a space after it; an enumeration is an ASCII letter or a
    number of up to three digits, followed by a full stop or bracket, and needs none, but text after it.
    """
    t = trim_space(text)
    bullet = F.regexp_extract(t, f"^([{BULLETS}]) (?s:(.*))$", 1)
    number = F.regexp_extract(t, r"^([0-9]{1,3}[.)]|[A-Za-z][.)])(?s:(.*))$", 1)
    after = F.regexp_extract(t, r"^(?:[0-9]{1,3}[.)]|[A-Za-z][.)])(?s:(.*))$", 1)
    made = lambda marker, rest, ordered: F.struct(marker.alias("marker"), trim_space(rest).alias("rest"), F.lit(ordered).alias("ordered"))
    return F.when(bullet != "", made(bullet, F.regexp_extract(t, f"^[{BULLETS}] (?s:(.*))$", 1), False)).when((number != "") & (trim_space(after) != ""), made(number, after, True))


def heading_level(n_words: Column | str, text: Column | str, size: Column | str, body: Column | str) -> Column:
    """1 to 4 by how much larger than the body text a short line without a full stop is; null for other lines."""
    ratio = _c(size) / _c(body)
    fits = (_c(n_words) <= 14) & ~trim_space(text).endswith(".") & (_c(body) > 0) & (trim_space(text) != "")
    return F.when(fits & (ratio >= 1.8), 1).when(fits & (ratio >= 1.45), 2).when(fits & (ratio >= 1.25), 3).when(fits & (ratio >= 1.15), 4)


def join_wrapped(text: Column | str, following: Column | str) -> Column:
    """Two lines as running text: a hyphen at the end is healed when the next line's first byte is a lower-case letter, as a byte (a-z, or the lead of a three or four-byte character)."""
    heals = F.endswith(_c(text), F.lit("-")) & _c(following).rlike(r"^[a-z\x{800}-\x{10FFFF}]")
    return F.when(heals, F.concat(F.substring(text, F.lit(1), F.length(text) - 1), following)).otherwise(F.concat(text, F.lit(" "), following))


def is_garbled(text: Column | str) -> Column:
    """A page text that decoded badly: a ``(cid:`` code, or a fifth or more of at least 16 visible characters that are replacement, private-use or control characters."""
    visible = F.regexp_replace(text, SPACE, "")
    bad = F.length(visible) - F.length(F.regexp_replace(visible, r"[\x{FFFD}\x{E000}-\x{F8FF}\p{Cc}]", ""))
    return F.contains(_c(text), F.lit("(cid:")) | ((F.length(visible) >= 16) & (bad >= F.length(visible) * 0.2))


def strip_html(text: Column | str) -> Column:
    """The text of an HTML body: lines end at breaks, paragraphs, divisions and rows; tags go, five entities are read once, lines are trimmed and blank ones dropped. Bodies of scripts stay."""
    t = F.regexp_replace(text, r"(?i)<(?:br|/p|/div|/tr)[^<>]*>?", ">\n")
    t = F.regexp_replace(F.regexp_replace(t, r"<[^<>]*>?", ""), ">", "")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(c))
    return F.array_join(F.filter(F.transform(F.split(t, "\n"), trim_space), lambda x: x != ""), "\n")


def escape_cell(text: Column | str) -> Column:
    t = F.replace(_c(text), F.lit("|"), F.lit("\\|"))
    return F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\n"), F.lit("<br>"))


def column_index(reference: Column | str) -> Column:
    """The zero-based column of a cell reference such as AB12: up to three letters, up to 16384 columns, else -1."""
    letters = F.upper(F.regexp_extract(reference, "^([A-Za-z]*)", 1))
    n = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda a, x: a * 26 + F.ascii(x) - 64)
    return F.when(F.length(letters).between(1, 3) & (n <= 16384), n - 1).otherwise(-1)


def heading_style(style: Column | str) -> Column:
    """The level of a paragraph style: Title is 1, HeadingN is N+1 up to 6; spaces and case do not count."""
    s = F.lower(F.regexp_replace(style, " ", ""))
    n = F.regexp_extract(s, "^heading([0-9]+)$", 1)
    return F.when(s == "title", 1).when(n != "", F.least(n.cast("int") + 1, F.lit(6)))


def base_name(path: Column | str) -> Column:
    """The last part of a path of either kind of slash."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def clamp_confidence(percent: Column | str) -> Column:
    """A recogniser's percentage as 0.01 to 1; 0 is kept for native text."""
    c = _c(percent) / 100
    return F.when(c <= 0, 0.01).when(c > 1, 1.0).otherwise(c)


def transfer_decode(body: Column | str, encoding: Column | str) -> Column:
    """A mail body by its transfer encoding: base64 without its white space, quoted-printable with soft line breaks joined and blanks at line ends cut; invalid bodies and other encodings as they are."""
    kind = F.lower(trim_space(encoding))
    packed = F.regexp_replace(body, r"[ \t\r\n]", "")
    lines = F.regexp_replace(F.regexp_replace(body, r"[ \t]+(?=\r?\n|$)", ""), r"=(?:\r?\n|$)", "")
    # Escapes become those of URLs, which the engine decodes as bytes of UTF-8.
    escaped = F.regexp_replace(F.replace(F.replace(lines, F.lit("%"), F.lit("%25")), F.lit("+"), F.lit("%2B")), "=([0-9A-Fa-f]{2})", "%$1")
    printable = F.when(~F.contains(escaped, F.lit("=")), F.try_url_decode(escaped))
    return F.when(kind == "base64", F.coalesce(F.try_to_binary(packed, F.lit("base64")).cast("string"), body)).when(kind == "quoted-printable", F.coalesce(printable, body)).otherwise(_c(body))
