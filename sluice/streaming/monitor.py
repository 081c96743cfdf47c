"""Figures of running streams, gathered by a listener."""

from __future__ import annotations

import json
from collections import defaultdict

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class Monitor(StreamingQueryListener):
    """Per query: batches, rows in, rows dropped as late, state rows, last rates."""

    def __init__(self) -> None:
        self.figures: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        self.ended: dict[str, str | None] = {}

    def start(self, spark: SparkSession) -> Monitor:
        spark.streams.addListener(self)
        return self

    def stop(self, spark: SparkSession) -> None:
        spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.figures[str(event.id)]["batches"] += 0

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = json.loads(event.progress.json)
        f = self.figures[p["id"]]
        f["batches"] += 1
        f["rows_in"] += p.get("numInputRows", 0)
        f["rows_per_second"] = p.get("processedRowsPerSecond", 0.0)
        states = p.get("stateOperators", [])
        f["late_rows"] += sum(s.get("numRowsDroppedByWatermark", 0) for s in states)
        f["state_rows"] = sum(s.get("numRowsTotal", 0) for s in states)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.id)] = event.exception
