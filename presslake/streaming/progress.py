"""Progress while a stream runs: metrics observed on the rows it writes anyway, kept as a table by micro-batch."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

NAME = "progress"


def watched(rows: DataFrame, **metrics: Column) -> DataFrame:
    """A stream whose every micro-batch reports these aggregates."""
    return rows.observe(NAME, *[value.alias(name) for name, value in metrics.items()])


class ProgressLog(StreamingQueryListener):
    """Writes one row for each finished micro-batch of watched() streams: (input_rows, the metrics), under its number.

    A micro-batch that is run again replaces its row. Register with spark.streams.addListener; finished() waits for the
    events of a query that has ended, which arrive a moment later.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._ended = spark, path, threading.Event()
        self.errors: list[Exception] = []

    def onQueryStarted(self, event):
        self._ended.clear()

    def onQueryProgress(self, event):
        progress = event.progress
        seen = progress.observedMetrics.get(NAME)
        if seen is None or not progress.numInputRows:
            return
        row = {"input_rows": progress.numInputRows, **seen.asDict()}
        try:
            one = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{name} BIGINT" for name in row))
            one.write.mode("overwrite").parquet(f"{self.path}/batch={progress.batchId}")
        except Exception as error:  # a listener must not end the stream
            self.errors.append(error)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self._ended.set()

    def finished(self, timeout: float = 60.0) -> bool:
        return self._ended.wait(timeout)
