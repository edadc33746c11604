"""Watching runs: counters of a plan while it runs, and progress of streams as indexing events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(rows: DataFrame, name: str, **counters) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds `rows` and the given aggregates once an action has run."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counters.items()]), seen


class StreamEvents(StreamingQueryListener):
    """Turns the life of a stream into events (kind, source, data) for callbacks; kinds: those that a callback asks for."""

    def __init__(self):
        self.callbacks: list[tuple[Callable[[dict], None], frozenset[str] | None]] = []

    def on(self, callback: Callable[[dict], None], kinds: list[str] | None = None) -> StreamEvents:
        self.callbacks.append((callback, frozenset(kinds) if kinds else None))
        return self

    def _tell(self, kind: str, source: str, data: dict) -> None:
        for callback, kinds in self.callbacks:
            if kinds is None or kind in kinds:
                callback({"kind": kind, "source": source, "data": data})

    def onQueryStarted(self, event) -> None:
        self._tell("PIPELINE_STARTED", str(event.id), {"name": event.name})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._tell("PROGRESS_UPDATE", str(p.id), {"batch": p.batchId, "rows": p.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        failed = event.exception is not None
        self._tell("PIPELINE_FAILED" if failed else "PIPELINE_COMPLETED", str(event.id), {"error": event.exception})
