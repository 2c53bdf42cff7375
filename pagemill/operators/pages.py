"""What consumes the lines of one page in order: columns, tables, lists, paragraphs. Plain Python over one page's lines."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pagemill.operators.layout import ANCHOR, BUCKET, CELL_FACTOR, CELL_GAP, COLUMN_LINES, COLUMN_WORDS, FULL_WIDTH, GUTTER, INDENT, PARAGRAPH_GAP, SIZE_TOLERANCE

MARKER = re.compile(r"([•◦▪·–—*-]) (.*)|([0-9]{1,3}[.)]|[A-Za-z][.)])(.*)", re.S)


@dataclass
class Word:
    text: str
    x0: float
    y0: float
    x1: float
    y1: float
    font_size: float = 0.0


@dataclass
class Line:
    words: list[Word]
    size: float = 0.0
    x0: float = field(init=False)
    y0: float = field(init=False)
    x1: float = field(init=False)
    y1: float = field(init=False)

    def __post_init__(self) -> None:
        self.x0, self.y0 = min(w.x0 for w in self.words), min(w.y0 for w in self.words)
        self.x1, self.y1 = max(w.x1 for w in self.words), max(w.y1 for w in self.words)
        if not self.size:
            sizes = [w.font_size for w in self.words if w.font_size > 0]
            self.size = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else self.height

    @classmethod
    def of(cls, row: dict) -> Line:
        return cls([Word(w["text"], w["x0"], w["y0"], w["x1"], w["y1"], w["font_size"]) for w in row["words"]], row["size"])

    @property
    def text(self) -> str:
        return " ".join(w.text for w in self.words)

    @property
    def height(self) -> float:
        return self.y1 - self.y0


@dataclass
class Block:
    kind: str
    box: tuple
    text: str | None = None
    level: int | None = None
    ordered: bool | None = None
    marker: str | None = None
    rows: list | None = None
    header: list | None = None
    figure_id: str | None = None

    def grow(self, line: Line) -> None:
        x0, y0, x1, y1 = self.box
        self.box = min(x0, line.x0), min(y0, line.y0), max(x1, line.x1), max(y1, line.y1)


def body_size(lines: list[Line]) -> float:
    sizes = sorted(s for x in lines for s in [x.size] * len(x.words))
    return sizes[len(sizes) // 2] if sizes else 0.0


def list_marker(text: str) -> tuple[str, str, bool] | None:
    m = MARKER.match(text.strip())
    if not m:
        return None
    if m[1]:
        return m[1], m[2].strip(), False
    return (m[3], m[4].strip(), True) if m[4].strip() else None


def heading_level(line: Line, body: float) -> int | None:
    text = line.text.strip()
    if not text or text.endswith(".") or len(line.words) > 14 or body <= 0:
        return None
    return next((level for level, least in ((1, 1.8), (2, 1.45), (3, 1.25), (4, 1.15)) if line.size / body >= least), None)


def join_wrapped(text: str, following: str) -> str:
    if text.endswith("-") and following and ("a" <= following[0] <= "z" or ord(following[0]) >= 0x800):
        return text[:-1] + following
    return f"{text} {following}"


def continues_paragraph(previous: Line, line: Line) -> bool:
    return 0 <= previous.y0 - line.y1 <= PARAGRAPH_GAP * previous.height and not (abs(line.x0 - previous.x0) > INDENT and line.x0 < previous.x0) and abs(line.size - previous.size) <= SIZE_TOLERANCE


def cells_of(line: Line) -> list[list]:
    """[text, x0, x1] of each cell of a line."""
    least, out = max(CELL_GAP, CELL_FACTOR * line.size), []
    for w in line.words:
        if out and w.x0 - out[-1][2] < least:
            out[-1][0] += " " + w.text
            out[-1][2] = w.x1
        else:
            out.append([w.text, w.x0, w.x1])
    return out


def table_at(lines: list[Line], at: int) -> tuple[Block, int] | None:
    """The table that begins at a line, and how many lines it takes."""
    rows: list[list[list]] = []
    anchors: list[float] = []
    for k in range(at, len(lines)):
        cells = cells_of(lines[k])
        if len(cells) < 2:
            break
        if rows:
            astray = sum(all(abs(a - c[1]) > ANCHOR for a in anchors) for c in cells)
            if astray > 1 or lines[k - 1].y0 - lines[k].y1 > PARAGRAPH_GAP * lines[k - 1].height:  # rows may overlap
                break
        rows.append(cells)
        for c in cells:
            if all(abs(a - c[1]) > ANCHOR for a in anchors):
                anchors = sorted([*anchors, c[1]])
    if len(rows) < 2 or len(anchors) < 2:
        return None
    grid = []
    for cells in rows:
        row = [""] * len(anchors)
        for text, x0, _ in cells:
            slot = min(range(len(anchors)), key=lambda i: (abs(anchors[i] - x0), i))
            row[slot] = f"{row[slot]} {text}" if row[slot] else text
        grid.append(row)
    taken = lines[at : at + len(rows)]
    block = Block("table", (min(x.x0 for x in taken), min(x.y0 for x in taken), max(x.x1 for x in taken), max(x.y1 for x in taken)))
    has_header = len(grid) > 1 and all(c.strip() for c in grid[0])
    block.header, block.rows = (grid[0], grid[1:]) if has_header else (None, grid)
    return block, len(rows)


def classify(lines: list[Line], body: float) -> list[Block]:
    out, i = [], 0
    while i < len(lines):
        line = lines[i]
        if table := table_at(lines, i):
            out.append(table[0])
            i += table[1]
            continue
        block = Block("paragraph", (line.x0, line.y0, line.x1, line.y1), line.text)
        i += 1
        out.append(block)
        if marker := list_marker(line.text):
            block.kind, (block.marker, block.text, block.ordered) = "list_item", marker
            while i < len(lines) and continues_paragraph(lines[i - 1], lines[i]) and not list_marker(lines[i].text) and lines[i].x0 > line.x0:
                block.text = join_wrapped(block.text, lines[i].text)
                block.grow(lines[i])
                i += 1
        elif level := heading_level(line, body):
            block.kind, block.level = "heading", level
        else:
            while i < len(lines) and continues_paragraph(lines[i - 1], lines[i]) and not list_marker(lines[i].text) and not heading_level(lines[i], body):
                block.text = join_wrapped(block.text, lines[i].text)
                block.grow(lines[i])
                i += 1
    return out


def gutter(lines: list[Line], left: float, right: float) -> tuple[float, float] | None:
    n = int((right - left) / BUCKET) + 1
    inked = set()
    for x in lines:
        for w in x.words:
            inked.update(range(int((w.x0 - left) / BUCKET), int((w.x1 - left) / BUCKET) + 1))
    best, run = (0, 0), 0
    last = int(0.8 * n)
    for b in range(int(0.2 * n), last + 1):
        run = run + 1 if b not in inked else 0
        if run > best[0]:
            best = run, b - run + 1
    return (left + best[1] * BUCKET, left + (best[1] + best[0]) * BUCKET) if best[0] * BUCKET >= GUTTER else None


def reads_as_column(lines: list[Line]) -> bool:
    return len(lines) >= COLUMN_LINES and sum(len(x.words) for x in lines) >= COLUMN_WORDS * len(lines)


def split_band(band: list[Line], left: float, right: float) -> tuple[list[Line], list[Line]] | None:
    """The two columns of a band of lines, where it has a gutter that no word crosses and both sides read as columns."""
    found = gutter(band, left, right) if band else None
    if not found:
        return None
    sides: tuple[list[Line], list[Line]] = ([], [])
    for line in band:
        parts: tuple[list[Word], list[Word]] = ([], [])
        for w in line.words:
            if w.x1 <= found[0] + ANCHOR:
                parts[0].append(w)
            elif w.x0 >= found[1] - ANCHOR:
                parts[1].append(w)
            else:
                return None
        for side, ws in zip(sides, parts, strict=True):
            if ws:
                side.append(Line(ws))
    return sides if all(map(reads_as_column, sides)) else None


def reading_order(lines: list[Line]) -> list[list[Line]]:
    """Regions in reading order: lines across the page by themselves, the columns of each band between them left before right; one region when no band has columns."""
    if not lines:
        return []
    left, right = min(x.x0 for x in lines), max(x.x1 for x in lines)

    def full(x: Line) -> bool:
        return x.x1 - x.x0 >= FULL_WIDTH * (right - left) and all(b.x0 - a.x1 < GUTTER for a, b in zip(x.words, x.words[1:], strict=False))

    regions, band, any_split = [], [], False

    def close_band() -> None:
        nonlocal any_split
        if columns := split_band(band, left, right):
            any_split = True
            regions.extend(columns)
        elif band:
            regions.append(list(band))
        band.clear()

    for x in lines:
        if full(x):
            close_band()
            regions.append([x])
        else:
            band.append(x)
    close_band()
    return regions if any_split else [lines]


def page_blocks(lines: list[Line]) -> list[Block]:
    body = body_size(lines)
    return [b for region in reading_order(lines) for b in classify(region, body)]


def place_figures(blocks: list[Block], images: list, page: int) -> list[Block]:
    """Figures from the top down, each before the first block that lies lower; the blocks keep their order."""
    figures = [Block("figure", (f["x0"], f["y0"], f["x1"], f["y1"]), figure_id=f"img_p{page + 1}_{int(f['index']) + 1}") for f in images]
    out = list(blocks)
    for f in sorted(figures, key=lambda f: -f.box[3]):
        at = next((k for k, b in enumerate(out) if b.kind != "figure" and b.box[3] < f.box[3]), len(out))
        out.insert(at, f)
    return out
