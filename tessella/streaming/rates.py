"""Rates of running streams, per batch."""

from __future__ import annotations

from datetime import datetime
from threading import Event

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import QueryIdleEvent, QueryProgressEvent, QueryStartedEvent, QueryTerminatedEvent, StreamingQueryListener

PROGRESS = "run string, batch long, at timestamp, rows long, ms long"


class Progress(StreamingQueryListener):
    """Gathers each batch's input rows and duration of one session's streams: a row of a few numbers per batch."""

    def __init__(self, spark: SparkSession):
        self.spark, self.rows, self._ended = spark, [], {}
        spark.streams.addListener(self)

    def _end(self, run: str) -> Event:
        return self._ended.setdefault(run, Event())

    def onQueryStarted(self, event: QueryStartedEvent) -> None:
        pass

    def onQueryIdle(self, event: QueryIdleEvent) -> None:
        pass

    def onQueryProgress(self, event: QueryProgressEvent) -> None:
        p = event.progress
        at = datetime.fromisoformat(p.timestamp.replace("Z", "+00:00"))
        self.rows.append((str(p.runId), p.batchId, at, p.numInputRows, p.batchDuration))

    def onQueryTerminated(self, event: QueryTerminatedEvent) -> None:
        self._end(str(event.runId)).set()

    def finish(self, stream: StreamingQuery, seconds: float = 60) -> DataFrame:
        """Waits for the stream's end and for what is still to be told of it; then its batches (PROGRESS)."""
        stream.awaitTermination()
        if not self._end(run := str(stream.runId)).wait(seconds):
            raise TimeoutError(f"no word of the end of stream {run}")
        self.spark.streams.removeListener(self)
        return self.spark.createDataFrame([r for r in self.rows if r[0] == run], PROGRESS)


def rates(progress: DataFrame) -> DataFrame:
    """Batches (PROGRESS) with the rows so far, the seconds since the batch before began (of the first its own), and rows a second."""
    so_far = Window.partitionBy("run").orderBy("batch")
    seconds = F.coalesce((F.unix_micros("at") - F.unix_micros(F.lag("at").over(so_far))) / 1e6, F.col("ms") / 1e3)
    out = progress.withColumns({"total": F.sum("rows").over(so_far), "seconds": seconds})
    return out.withColumn("rate", F.when(F.col("seconds") > 0, F.col("rows") / F.col("seconds")))
