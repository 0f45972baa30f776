"""A priority queue that spills sorted runs, for one task's messages."""

from __future__ import annotations

import heapq
import os
import pickle
import tempfile

BLOCK = 1024


def _scratch_dir() -> str | None:
    """The folder that Spark gives a task for its own spills; the system's if none is named.
    Only this task reads what it writes there, and a task that runs again writes it again."""
    named = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return named if named and os.path.isdir(named) else None


def _write(items):
    """Sorted items -> an unnamed file that goes when it is closed."""
    out, block = tempfile.TemporaryFile(dir=_scratch_dir()), []
    for x in items:
        block.append(x)
        if len(block) == BLOCK:
            pickle.dump(block, out, pickle.HIGHEST_PROTOCOL)
            block = []
    if block:
        pickle.dump(block, out, pickle.HIGHEST_PROTOCOL)
    out.seek(0)
    return out


def _read(run):
    while True:
        try:
            block = pickle.load(run)
        except EOFError:
            run.close()
            return
        yield from block


class SpillQueue:
    """Smallest tuple first.  At most ``limit`` items and a block of each of at most
    ``fan`` runs are in memory; more runs are merged into one."""

    def __init__(self, limit: int = 100_000, fan: int = 16):
        self.limit, self.fan = limit, fan
        self.heap: list = []
        self.heads: list = []  # (smallest item left, run number) of every run
        self.runs: dict = {}
        self.made = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            if len(self.runs) >= self.fan:
                rest = [iter([head]) for head, _ in self.heads] + [self.runs[n] for _, n in self.heads]
                self.heads, self.runs = [], {}
                self._add(heapq.merge(*rest))
            self.heap.sort()
            self._add(self.heap)
            self.heap = []

    def _add(self, items) -> None:
        run = _read(_write(items))
        self.made += 1
        self.runs[self.made] = run
        heapq.heappush(self.heads, (next(run), self.made))

    def peek(self):
        """The smallest item, None if there is none."""
        if not self.heads:
            return self.heap[0] if self.heap else None
        return min(self.heap[0], self.heads[0][0]) if self.heap else self.heads[0][0]

    def pop(self) -> tuple:
        if not self.heads or self.heap and self.heap[0] <= self.heads[0][0]:
            return heapq.heappop(self.heap)
        item, n = self.heads[0]
        follows = next(self.runs[n], None)
        if follows is None:
            heapq.heappop(self.heads)
            del self.runs[n]
        else:
            heapq.heapreplace(self.heads, (follows, n))
        return item
