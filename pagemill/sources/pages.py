"""One PDF page with recognition where its text layer is silent, and the choice of pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pagemill.operators.routing import COVERED, FIGURE_SHARE, FIGURE_SIDE
from pagemill.sources import pdf


def pages_selected(spec: str, count: int, most: int | None = None) -> list[int]:
    """Zero-based pages of a specification ('' is all), at most ``most`` of them; ValueError for a malformed one."""
    out: dict[int, None] = {}
    for part in (p.strip() for p in spec.split(",")):
        if not part:
            continue
        a, dash, b = part.partition("-")
        first, last = int(a), int(b) if dash else int(a)
        if first < 1 or last < first:
            raise ValueError(f"bad page range {part}")
        out.update(dict.fromkeys(range(first - 1, min(last, count))))
    chosen = list(out) if spec else list(range(count))
    return chosen[:most] if most is not None and most > 0 else chosen


@dataclass(frozen=True)
class Tools:
    """What works outside this package: a recogniser of images, a renderer of pages, a converter of office files to PDF; None where there is none.

    figures also recognises pictures on pages that have text; native_office reads
    Word, Excel and PowerPoint packages without the converter even where there is one.
    """

    recogniser: Callable[[bytes], list[dict]] | None = None
    renderer: Callable | None = None
    converter: Callable[[bytes, str], bytes] | None = None
    figures: bool = False
    native_office: bool = True
    dpi: float = 200.0


def in_points(words: list[dict], dpi: float, height: float, left: float = 0, top: float = 0) -> list[dict]:
    """Recognised words from pixels of a picture, whose corner lies at left and top, to points from the bottom left of its page."""
    r = dpi / 72
    return [{"text": w["text"], "x0": (w["x0"] + left) / r, "y0": height - (w["y1"] + top) / r, "x1": (w["x1"] + left) / r, "y1": height - (w["y0"] + top) / r, "font_size": 0.0, "confidence": w["confidence"]} for w in words]


def covered(w: dict, others: list[dict]) -> bool:
    """Whether other words lie on half of a word's area."""
    area = (w["x1"] - w["x0"]) * (w["y1"] - w["y0"])
    over = sum(max(0.0, min(w["x1"], o["x1"]) - max(w["x0"], o["x0"])) * max(0.0, min(w["y1"], o["y1"]) - max(w["y0"], o["y0"])) for o in others)
    return area > 0 and over >= COVERED * area


def read_page(file: pdf.File, node: dict, index: int, tools: Tools | None = None) -> pdf.Page:
    """A page's native words; where it has none, recognised ones; with ``figures``, also those of its larger pictures that native words do not cover."""
    page = pdf.page(file, node)
    for w in page.words:
        w["confidence"] = 0.0
    if tools is None or tools.recogniser is None or tools.renderer is None:
        return page
    if not page.words:
        page.words = in_points(tools.recogniser(tools.renderer(file.data, index, tools.dpi, None)), tools.dpi, page.height)
    elif tools.figures:
        r = tools.dpi / 72
        for x0, y0, x1, y1 in page.images:
            if min(x1 - x0, y1 - y0) < FIGURE_SIDE or (x1 - x0) * (y1 - y0) < FIGURE_SHARE * page.width * page.height:
                continue
            left, top = max(0, int(x0 * r)), max(0, int((page.height - y1) * r))
            right, bottom = min(int(page.width * r), int(x1 * r) + 1), min(int(page.height * r), int((page.height - y0) * r) + 1)
            if right - left <= 1 or bottom - top <= 1:
                continue
            found = in_points(tools.recogniser(tools.renderer(file.data, index, tools.dpi, (left, top, right, bottom))), tools.dpi, page.height, left, top)
            page.words = page.words + [w for w in found if w["text"].strip() and not covered(w, page.words)]
    return page


def read_pages(data: bytes, pages: str = "", most: int | None = None, password: str = "", tools: Tools | None = None, granularity: str = "word") -> Iterator[tuple[int, pdf.Page]]:
    """The selected pages with their numbers; with the granularity "line" the words of a line are one."""
    file = pdf.File(data, password)
    nodes = file.pages()
    for p in pages_selected(pages, len(nodes), most):
        page = read_page(file, nodes[p], p, tools)
        if granularity == "line":
            page.words = pdf.lines_of(page.words)
        yield p, page
