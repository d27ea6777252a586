"""A log of what streams have done."""

from __future__ import annotations

import logging
from dataclasses import dataclass, field

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("termloom.streaming")


@dataclass
class Progress:
    batches: int = 0
    rows_in: int = 0
    failed: str | None = None
    ended: bool = False


@dataclass
class ProgressLog(StreamingQueryListener):
    """Counts batches and rows of each query, and writes them to the log.

    spark.streams.addListener(ProgressLog())"""

    queries: dict[str, Progress] = field(default_factory=dict)

    def onQueryStarted(self, event) -> None:
        self.queries[str(event.id)] = Progress()
        log.info("query %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = self.queries.setdefault(str(event.progress.id), Progress())
        p.batches += 1
        p.rows_in += event.progress.numInputRows
        log.info("query %s: batch %s, %s rows", event.progress.id, event.progress.batchId, event.progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        p = self.queries.setdefault(str(event.id), Progress())
        p.ended, p.failed = True, event.exception
        log.info("query %s ended%s", event.id, f": {event.exception}" if event.exception else "")
