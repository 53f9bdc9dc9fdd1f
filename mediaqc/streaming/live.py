"""Counters of a running query: what each batch stored, observed as it is written, and how fast rows arrive."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

STATUSES = ("Valid", "Invalid", "Duplicate", "Error")


def counts() -> list[Column]:
    return [*[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES], F.count(F.lit(1)).alias("done")]


class Live(StreamingQueryListener):
    """Counts by status of all that is stored, kept by batch, so that a batch which runs again replaces its own counts.

    Counts come with the write of a batch (no second read) and are complete when it has ended; seconds come from the engine's
    own reports a little later.
    """

    def __init__(self, total: int | None = None):
        self.total, self.query = total, None
        self._lock, self._stored, self._took = threading.Lock(), {}, {}

    def start(self, stored: DataFrame) -> None:
        """What earlier runs stored: one row a batch, read once."""
        found = {r.batch: r.asDict() for r in stored.groupBy("batch").agg(*counts()).collect()}
        with self._lock:
            self._stored = {b: {k: n for k, n in row.items() if k != "batch"} for b, row in found.items()}

    def observed(self, out: DataFrame) -> tuple[DataFrame, Observation]:
        seen = Observation()
        return out.observe(seen, *counts()), seen

    def stored(self, batch: int, seen: Observation) -> None:
        row = {k: v or 0 for k, v in seen.get.items()}
        with self._lock:
            self._stored[batch] = row

    def snapshot(self) -> dict:
        """valid, invalid, duplicate, error, done; total and left if a total is known; rows, seconds and rate of this run.

        The engine's own number of input rows counts a row each time that a batch reads its source again, so rows are those stored.
        """
        with self._lock:
            sums = Counter({name: 0 for name in (*map(str.lower, STATUSES), "done")})
            for row in self._stored.values():
                sums.update(row)
            rows, seconds = sum(self._stored[b]["done"] for b in self._took if b in self._stored), sum(self._took.values())
        out = dict(sums)
        if self.total is not None:
            out |= {"total": self.total, "left": self.total - out["done"]}
        return out | {"rows": rows, "seconds": seconds, "rate": rows / seconds if seconds else 0.0}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if self.query in (None, str(p.id)):
            with self._lock:
                self._took[p.batchId] = (p.batchDuration or 0) / 1000

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
