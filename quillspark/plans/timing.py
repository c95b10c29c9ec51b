"""Wall time by phase of a run."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Phases:
    """Seconds of named phases; phases of one name add up."""

    def __init__(self) -> None:
        self.seconds: dict[str, float] = {}

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def report(self, queries: int = 0) -> list[tuple[str, float, float, float]]:
        """(phase, seconds, share of all in percent, milliseconds a query or 0) in the order the phases began, and their total last."""
        total = sum(self.seconds.values())
        a_query = lambda s: round(1000 * s / queries, 3) if queries else 0.0
        rows = [(name, round(s, 3), round(100 * s / total, 1) if total else 0.0, a_query(s)) for name, s in self.seconds.items()]
        return [*rows, ("total", round(total, 3), 100.0 if total else 0.0, a_query(total))]
