"""Entries of ZIP archives, and files embedded in Office packages."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

from pagemill.sources.budget import Budget, Child


def children(data: bytes, budget: Budget, embedded_only: bool = False) -> Iterator[Child]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:

        def read(entry: zipfile.ZipInfo):
            def some(limit: int) -> bytes:
                if entry.file_size > limit:
                    raise ValueError(f"larger than the {limit} bytes left")
                with z.open(entry) as f:  # the declared size may lie
                    return f.read(limit + 1)

            return some

        entries = [e for e in z.infolist() if not e.is_dir() and (not embedded_only or "/embeddings/" in e.filename.lower())]
        yield from budget.admit((e.filename, read(e)) for e in entries)
