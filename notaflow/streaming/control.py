"""Steering streams: phases in order, a graceful stop, progress, status, and statistics in bounded state."""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Progress(StreamingQueryListener):
    """Calls report(phase, batch, rows) after every micro-batch; the phase is the query's name."""

    def __init__(self, report: Callable[[str, int, int], None]):
        self.report = report

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.report(p.name or str(p.id), p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def run_until(query: StreamingQuery, stop: threading.Event, poll_s: float = 0.2) -> str:
    """Waits for the query's end; on the event lets the micro-batch under way end and stops. COMPLETED or INTERRUPTED."""
    while query.isActive:
        if stop.is_set():
            query.stop()
            return "INTERRUPTED"
        query.awaitTermination(poll_s)
    if query.exception() is not None:
        raise query.exception()
    return "COMPLETED"


def in_phases(phases: Sequence[tuple[str, Callable[[], StreamingQuery]]], stop: threading.Event | None = None) -> dict[str, str]:
    """Starts each phase's query after the one before has ended; what became of each. After an interrupt none begins."""
    stop, out = stop or threading.Event(), {}
    for name, start in phases:
        out[name] = "SKIPPED" if stop.is_set() else run_until(start(), stop)
    return out


def status(query: StreamingQuery) -> dict:
    """A query's state: active or not, last micro-batch, rows so far in the kept progress."""
    last = query.lastProgress
    return {"name": query.name, "active": query.isActive, "batch": last["batchId"] if last else None, "rows": sum(p["numInputRows"] for p in query.recentProgress)}


def running_counts(stream: DataFrame, *keys: str) -> DataFrame:
    """Counts by key, to be written in complete mode: the state holds one row a key, whatever the stream's length."""
    return stream.groupBy(*keys).agg(F.count("*").alias("n"))
