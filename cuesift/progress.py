"""Progress lines and logging."""

from __future__ import annotations

import logging
import sys
import threading
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TextIO

from pyspark import Accumulator, SparkContext


class Progress:
    """Counts items and writes 'name: p%' over the line before it, p rounded down."""

    def __init__(self, name: str, total: int, out: TextIO = sys.stdout):
        self.name, self.total, self.out, self.done = name, total, out, 0
        out.write(f"\r{name}: processing {total} items\n\r{name}: 0%")

    def tick(self, n: int = 1) -> None:
        self.done += n
        self.out.write(f"\r{self.name}: {self.percent}%")
        self.out.flush()

    @property
    def percent(self) -> int:
        return 100 * self.done // self.total if self.total else 100


@contextmanager
def counted(context: SparkContext, name: str, total: int, out: TextIO = sys.stdout, every: float = 0.5) -> Iterator[Accumulator]:
    """An accumulator that tasks add finished items to; while the block runs, its growth is shown as progress.

    Spark hands counts over as tasks end, and a repeated task may count again, so the last line is written at the end.
    """
    done, progress, over = context.accumulator(0), Progress(name, total, out), threading.Event()

    def follow() -> None:
        while not over.wait(every):
            if (n := min(done.value, total) - progress.done) > 0:
                progress.tick(n)

    thread = threading.Thread(target=follow, daemon=True)
    thread.start()
    try:
        yield done
    finally:
        over.set()
        thread.join()
    progress.tick(total - progress.done)


def init_log(level: int = logging.DEBUG) -> None:
    logging.basicConfig(level=level, format="%(asctime)s %(levelname)s %(name)s: %(message)s")
