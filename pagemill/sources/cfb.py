"""Compound files (OLE): their streams, embedded payloads, and Outlook messages."""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pagemill.sources import detect
from pagemill.sources.budget import Budget, Child

MAGIC = bytes.fromhex("D0CF11E0A1B11AE1")
END, HOPS, ENTRY = 0xFFFFFFFE, 1 << 20, 128


class CompoundFile:
    """Every chain is bounded by the file's sectors, so forged links and sizes cannot make a read run on."""

    def __init__(self, data: bytes):
        if len(data) < 512 or not data.startswith(MAGIC):
            raise ValueError("not a compound file")
        shift, mini = struct.unpack_from("<HH", data, 30)
        if not 7 <= shift <= 20 or not 4 <= mini < shift:
            raise ValueError("bad sector sizes")
        self.data, self.size, self.mini_size = data, 1 << shift, 1 << mini
        self.count = max(0, -(-(len(data) - 512) // self.size)) if self.size <= 512 else max(0, -(-len(data) // self.size) - 1)
        directory, self.cutoff = struct.unpack_from("<I", data, 48)[0], struct.unpack_from("<I", data, 56)[0]
        mini_fat, n_mini, difat, n_difat = struct.unpack_from("<IIII", data, 60)
        fat_sectors = [s for s in struct.unpack_from("<109I", data, 76) if s < self.count]
        seen = set()
        while difat < self.count and difat not in seen and len(seen) < n_difat + 1:
            seen.add(difat)
            *more, difat = struct.unpack(f"<{self.size // 4}I", self._sector(difat))
            fat_sectors += [s for s in more if s < self.count]
        self.fat = [x for s in fat_sectors[: self.count] for x in struct.unpack(f"<{self.size // 4}I", self._sector(s))]
        self.mini_fat = list(struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4])) if (raw := self._chain(mini_fat)) else []
        raw = self._chain(directory)
        self.entries = [raw[k : k + ENTRY] for k in range(0, len(raw) - ENTRY + 1, ENTRY)]
        if not self.entries:
            raise ValueError("no directory")
        start, size = self._place(self.entries[0])
        self.mini = self._chain(start)[:size]

    def _sector(self, k: int) -> bytes:
        at = 512 + k * self.size if self.size <= 512 else (k + 1) * self.size
        return self.data[at : at + self.size].ljust(self.size, b"\0")

    def _chain(self, k: int) -> bytes:
        out, seen = [], set()
        while k < self.count and k not in seen and len(seen) < HOPS:
            seen.add(k)
            out.append(self._sector(k))
            k = self.fat[k] if k < len(self.fat) else END
        return b"".join(out)

    @staticmethod
    def _place(entry: bytes) -> tuple[int, int]:
        return struct.unpack_from("<I", entry, 116)[0], struct.unpack_from("<Q", entry, 120)[0] & 0xFFFFFFFF

    def read(self, entry: bytes) -> bytes:
        start, size = self._place(entry)
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, seen, k = [], set(), start
        while k < len(self.mini_fat) and k not in seen:
            seen.add(k)
            out.append(self.mini[k * self.mini_size : (k + 1) * self.mini_size])
            k = self.mini_fat[k]
        return b"".join(out)[:size]

    def streams(self) -> list[tuple[tuple[str, ...], bytes]]:
        """(path, entry) of each stream: an entry, what it holds, then its left and right neighbours."""
        out: list[tuple[tuple[str, ...], bytes]] = []
        seen: set[int] = set()
        todo = [(struct.unpack_from("<I", self.entries[0], 76)[0], ())]
        while todo:
            k, path = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            e = self.entries[k]
            left, right, child = struct.unpack_from("<III", e, 68)
            name = e[: max(0, min(64, struct.unpack_from("<H", e, 64)[0]) - 2)].decode("utf-16-le", "replace")
            if e[66] == 2:
                out.append(((*path, name), e))
            todo += [(right, path), (left, path)]
            if e[66] in (1, 5):
                todo.append((child, (*path, name)))
        return out


def payload(data: bytes) -> tuple[str, bytes]:
    """Name and bytes of an Ole10Native stream; where its header does not hold, what begins at the earliest known signature."""
    try:
        at = 6
        texts = []
        for _ in range(2):
            end = data.index(b"\0", at, at + 4096)
            texts.append(data[at:end].decode("latin-1"))
            at = end + 1
        at += 8
        at = data.index(b"\0", at, at + 4096) + 1
        size = struct.unpack_from("<I", data, at)[0]
        if at + 4 + size <= len(data):
            return texts[0].replace("\\", "/").split("/")[-1], data[at + 4 : at + 4 + size]
    except (ValueError, struct.error):
        pass
    starts = [p for s in (b"%PDF-", b"PK\x03\x04", b"\xff\xd8\xff", b"\x89PNG") if (p := data.find(s)) >= 0]
    if not starts:
        raise ValueError("no embedded file")
    return "", data[min(starts) :]


def ole_children(data: bytes, budget: Budget) -> Iterator[Child]:
    f = CompoundFile(data)
    found = []
    for path, entry in f.streams():
        raw = f.read(entry)
        if path[-1] == "\x01Ole10Native":
            try:
                name, raw = payload(raw)
            except ValueError:
                continue
            found.append((name or path[0], raw))
        elif detect.sniff(raw) in ("pdf", "docx", "xlsx", "pptx", "png", "jpeg", "gif", "tiff", "bmp", "webp", "zip"):
            found.append((path[-1], raw))
    yield from budget.admit((name, lambda limit, raw=raw: raw) for name, raw in found)


def _properties(f: CompoundFile, storage: tuple[str, ...]) -> dict[str, str | bytes]:
    """Properties of a message or attachment by their number, as text where they are text."""
    out: dict[str, str | bytes] = {}
    for path, entry in f.streams():
        if path[:-1] != storage or not path[-1].startswith("__substg1.0_"):
            continue
        number, kind, raw = path[-1][12:16].upper(), path[-1][16:20].upper(), f.read(entry)
        out[number] = raw.decode("utf-16-le", "replace").strip("\0") if kind == "001F" else raw.decode("cp1252", "replace").strip("\0") if kind == "001E" else raw
    return out


def _readable(p: dict) -> str:
    shown = "".join(f"{k}: {v}\n" for k, n in (("From", "0C1A"), ("To", "0E04"), ("Subject", "0037")) if (v := p.get(n)))
    body = p.get("1000") or ""
    if not body and isinstance(p.get("1013"), bytes):
        from pagemill.sources.mail import strip_html

        body = strip_html(p["1013"].decode("utf-8", "replace"))
    return f"{shown}\n{body if isinstance(body, str) else body.decode('utf-8', 'replace')}"


def message_text(data: bytes) -> str:
    return _readable(_properties(CompoundFile(data), ()))


def message_children(data: bytes, budget: Budget) -> list[Child]:
    """Attachments of an Outlook message; an attached message comes as its text."""
    f = CompoundFile(data)
    storages = sorted({path[0] for path, _ in f.streams() if path[0].startswith("__attach_version1.0_")})

    def read(storage: str, p: dict):
        def some(limit: int) -> bytes:
            if isinstance(p.get("3701"), bytes):
                return p["3701"]
            inner = _properties(f, (storage, "__substg1.0_3701000D"))
            if not inner:
                raise ValueError("attachment without content")
            return _readable(inner).encode()

        return some

    entries = []
    for s in storages:
        p = _properties(f, (s,))
        name = p.get("3707") or p.get("3704") or s
        if "3701" not in p:
            name = (name[:-4] if name.lower().endswith(".msg") else name) + ".txt"
        elif name == s:
            name += "." + (detect.sniff(p["3701"]) or "bin")
        entries.append((name, read(s, p)))
    return sorted(budget.admit(entries), key=lambda c: c.name)
