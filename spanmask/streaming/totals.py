"""Totals of streaming runs (A3, E3), gathered while the stream runs.

``RunTotals`` is a listener.  A stream of ``redact_stream`` that is given one observes its rows
where they pass, so no row is read twice; the listener adds up what each micro-batch reports.
Streams with a scorer that works by chunk rows report per batch, with failures by type, as
their batches are written.
"""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import DataFrame, Observation
from pyspark.sql.streaming import StreamingQueryListener

from ..operators.aggregates import error_summary, run_metrics

NAME = "spanmask_run"


class RunTotals(StreamingQueryListener):
    """Sums of ``aggregates.run_metrics`` and of failures by type over all micro-batches."""

    def __init__(self):
        self._lock = threading.Lock()
        self.totals, self.errors, self.batches = Counter(), Counter(), 0

    def add(self, metrics: dict, errors: dict[str, int] | None = None) -> None:
        with self._lock:
            self.totals.update({k: v or 0 for k, v in metrics.items()})
            self.errors.update(errors or {})
            self.batches += 1

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(NAME)
        if row is not None and row["docs"]:
            self.add(row.asDict())

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def observe_stream(self, out: DataFrame) -> DataFrame:
        """``out`` with its rows observed as the stream passes them."""
        return out.observe(NAME, *run_metrics())

    def write_batch(self, done: DataFrame, write) -> None:
        """Writes one batch with ``write`` (which gives the frame of what it wrote) and adds its
        totals."""
        seen = Observation()
        written = write(done.observe(seen, *run_metrics()))
        self.add(seen.get, {r["error"]: r["n"] for r in error_summary(written).collect()})  # one row per type
