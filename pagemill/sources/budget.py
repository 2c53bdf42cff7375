"""What a walk may still unpack: slots for files, and bytes; None is without limit."""

from __future__ import annotations

import signal
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

LARGEST = 128 << 20


@dataclass
class Child:
    name: str
    data: bytes | None
    error: str | None = None
    stop: bool = False


@dataclass
class Budget:
    slots: int | None = None
    bytes: int | None = None

    def spent(self) -> bool:
        return (self.slots is not None and self.slots <= 0) or (self.bytes is not None and self.bytes <= 0)

    def limit(self) -> int:
        return LARGEST if self.bytes is None else min(self.bytes, LARGEST)

    def take(self, size: int | None) -> None:
        """A slot, and the bytes of an accepted child; None for a refused one."""
        if self.slots is not None:
            self.slots -= 1
        if self.bytes is not None and size is not None:
            self.bytes -= size

    def admit(self, entries):
        """Children of (name, read) pairs, where read(limit) gives at most limit + 1 bytes or raises."""
        for name, read in entries:
            if self.spent():
                yield Child(name, None, "budget exhausted", stop=True)
                return
            limit = self.limit()
            try:
                data = read(limit)
            except Exception as e:  # a broken entry is a row of its own, not the end of its neighbours
                self.take(None)
                yield Child(name, None, str(e) or type(e).__name__)
                continue
            if len(data) > limit:
                self.take(None)
                yield Child(name, None, f"larger than the {limit} bytes left")
                continue
            self.take(len(data))
            yield Child(name, data)


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in what takes longer; None is without limit, and so is a thread that cannot be interrupted."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError(f"took longer than {seconds:g} seconds")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)
