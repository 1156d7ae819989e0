"""Watching and ending running streams."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Events(StreamingQueryListener):
    """Hands every start, progress and end of a session's streams to ``tell(kind, fields)``."""

    def __init__(self, tell: Callable[[str, dict], None]):
        self.tell = tell

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.tell("started", {"id": str(event.id), "name": event.name})

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.tell("progress", {"id": str(p.id), "batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond})

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.tell("idle", {"id": str(event.id)})

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.tell("error" if event.exception else "ended", {"id": str(event.id), "error": event.exception})


def stopped(query: StreamingQuery, wait_seconds: float = 30.0) -> bool:
    """Ends a stream between two of its batches: waits for the running one, then stops; whether it ended in time."""
    end = time.monotonic() + wait_seconds
    while query.isActive and query.status["isTriggerActive"] and time.monotonic() < end:
        time.sleep(0.05)
    query.stop()
    return not query.isActive


class Kept:
    """A result kept for some seconds: computed at the first call, again once it is older."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock, self.held, self.at = make, seconds, clock, None, 0.0

    def __call__(self) -> DataFrame:
        if self.held is None or self.clock() - self.at >= self.seconds:
            if self.held is not None:
                self.held.unpersist()
            self.held, self.at = self.make().persist(), self.clock()
        return self.held
