"""What kind of file bytes are, as Column expressions over content and name."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions and their formats (fixed values).
BY_NAME = {
    "pdf": "pdf", "docx": "docx", "docm": "docx", "xlsx": "xlsx", "xlsm": "xlsx", "pptx": "pptx", "pptm": "pptx", "odt": "odt", "ods": "ods", "odp": "odp", "rtf": "rtf", "doc": "doc", "xls": "xls", "ppt": "ppt", "msg": "msg",
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "tif": "tiff", "tiff": "tiff", "bmp": "bmp", "webp": "webp", "zip": "zip", "eml": "eml",
    "txt": "txt", "md": "txt", "csv": "txt", "tsv": "txt", "log": "txt", "json": "txt",
}
IMAGES = ["png", "jpeg", "gif", "tiff", "bmp", "webp"]
OOXML = ["docx", "xlsx", "pptx"]
OFFICE = [*OOXML, "odt", "ods", "odp", "rtf", "doc", "xls", "ppt"]
#: Bytes that a file of a format begins with, in the order they are tried (hexadecimal).
MAGIC = [("255044462D", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("474946383761", "gif"), ("474946383961", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("7B5C727466", "rtf"), ("D0CF11E0A1B11AE1", "ole"), ("504B0304", "zip")]
MAIL_HEADERS = ["From:", "To:", "Subject:", "Message-ID:", "Date:", "Received:"]


def format_by_name(name: Column | str) -> Column:
    """By the lower-cased last extension, '' where it is none of the known."""
    table = F.create_map(*(F.lit(x) for x in chain(*BY_NAME.items())))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))), F.lit(""))


def looks_like_email(content: Column | str) -> Column:
    """A mail or mailbox by its first 4096 bytes (a text column is taken as it is)."""
    head = F.substring(content, 1, 4096).cast("string")
    header = r"^[A-Za-z0-9-]+:"
    mbox = F.startswith(head, F.lit("From "))
    second = F.regexp_extract(head, r"^[^\n]*\n([^\n]*)", 1).rlike(header)
    mime = F.contains(head, F.lit("MIME-Version:")) | F.contains(head, F.lit("Content-Type:"))
    known = sum(F.contains(head, F.lit(h)).cast("int") for h in MAIL_HEADERS)
    return F.when(mbox, second).when(mime, head.rlike(header)).otherwise((known >= 2) & head.rlike(header))


def looks_like_text(content: Column | str) -> Column:
    """No NUL within the first 512 bytes and valid UTF-8 but for the last three bytes, where a character may be cut off."""
    head = F.substring(content, 1, 512)
    valid = F.exists(F.array(*(F.is_valid_utf8(F.substring(content, F.lit(1), F.greatest(F.length(head) - k, F.lit(0))).cast("string")) for k in range(4))), lambda x: x)
    return (F.length(head) > 0) & ~F.hex(head).rlike("^(?:..)*00") & valid


def _little(content: Column, at: int, n: int) -> Column:
    h = F.hex(F.substring(content, at + 1, n))
    return F.conv(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(n)))), 16, 10).cast("bigint")


def is_bmp(content: Column | str) -> Column:
    c = F.col(content) if isinstance(content, str) else content
    return (F.length(c) >= 26) & (F.hex(F.substring(c, 1, 2)) == "424D") & (_little(c, 6, 4) == 0) & _little(c, 10, 4).between(26, 1 << 20) & _little(c, 14, 4).isin(12, 16, 40, 52, 56, 64, 108, 124)


def sniff(content: Column | str) -> Column:
    """The format by the first bytes; a ZIP package stays 'zip' here, only its directory tells more."""
    c = F.col(content) if isinstance(content, str) else content
    h = F.hex(F.substring(c, 1, 16))
    out = F.when(c.isNull() | (F.length(c) == 0), "")
    for magic, kind in MAGIC:
        out = out.when(F.startswith(h, F.lit(magic)), kind)
    out = out.when(F.startswith(h, F.lit("52494646")) & (F.substring(h, 17, 8) == "57454250"), "webp").when(is_bmp(c), "bmp")
    late = F.contains(F.hex(F.substring(c, 1, 1024)), F.lit("255044462D"))
    return out.when(late, "pdf").when(looks_like_email(c), "eml").when(looks_like_text(c), "txt").otherwise("")


def detect_format(content: Column | str, name: Column | str) -> Column:
    """By content, refined by name: OLE files by an Office or mail name, text by any name of another format; unknown bytes by name alone."""
    by_bytes, by_name = sniff(content), format_by_name(name)
    return F.when((by_bytes == "ole") & by_name.isin("doc", "xls", "ppt", "msg"), by_name).when((by_bytes == "txt") & (by_name != ""), by_name).when(by_bytes != "", by_bytes).otherwise(by_name)


def extension(kind: Column | str) -> Column:
    """The usual suffix of a format, '' of an unknown one."""
    k = F.col(kind) if isinstance(kind, str) else kind
    return F.when(k == "", "").when(k == "jpeg", ".jpg").when(k == "ole", ".bin").otherwise(F.concat(F.lit("."), k))
