"""Capture sessions of streams, what watches them, and how they end."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


class Monitor(StreamingQueryListener):
    """Events of running queries as JSON lines: states, batches, rows taken and rows too late."""

    def __init__(self, put: Callable[[str], None]) -> None:
        self.put = put

    def _say(self, kind: str, **more) -> None:
        self.put(json.dumps({"type": kind} | more))

    def onQueryStarted(self, event) -> None:
        self._say("state", name=event.name, state="started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        self._say("qsize", name=p.name, batch=p.batchId, rows=p.numInputRows, too_old=late)

    def onQueryIdle(self, event) -> None:
        self._say("state", name=None, state="idle")

    def onQueryTerminated(self, event) -> None:
        self._say("state", name=None, state="stopped", error=event.exception)


class Capture:
    """One stream written while a session runs; a session begins at a timestamp and ends with a row that says so."""

    def __init__(self, stream: DataFrame, path: str) -> None:
        self.stream, self.path = stream, path
        self.query: StreamingQuery | None = None
        self.sessions = 0

    def start(self, since: int = 0, everything_there: bool = False) -> None:
        if self.query is not None and self.query.isActive:
            raise RuntimeError("a capture is already in progress")
        self.sessions += 1
        rows = self.stream.where(F.col("ts") >= since)
        writer = rows.writeStream.format("parquet").option("path", f"{self.path}/rows-{self.sessions}").option("checkpointLocation", f"{self.path}/state-{self.sessions}")
        self.query = writer.trigger(availableNow=True).start() if everything_there else writer.start()

    def stop(self) -> DataFrame:
        """Finish what was taken in, end the session, and give its rows."""
        if self.query is None:
            raise RuntimeError("no capture in progress")
        self.query.processAllAvailable() if self.query.isActive else self.query.awaitTermination()
        self.query.stop()
        self.query = None
        spark = self.stream.sparkSession
        rows = spark.read.schema(self.stream.schema).parquet(f"{self.path}/rows-{self.sessions}")
        spark.range(1).select(F.lit(self.sessions).alias("session"), F.lit("stop").alias("item")).write.mode("overwrite").parquet(f"{self.path}/stop-{self.sessions}")
        return rows


def fan_out(batch: DataFrame, outputs: list[Callable[[DataFrame], None]]) -> None:
    """One micro-batch to several pipelines: read once, given back when all are done."""
    batch.persist()
    for write in outputs:
        write(batch)
    batch.unpersist()


def dispatched(stream: DataFrame, reason: str, take: Callable[[DataFrame], None], discard: Callable[[DataFrame], None], path: str) -> StreamingQuery:
    """Run a stream whose rows have a reason to be dropped, or none: rows without one go to `take`, the others
    to the `discard` hook, batch by batch."""

    def each(batch: DataFrame, _: int) -> None:
        fan_out(batch, [lambda b: take(b.where(F.col(reason).isNull())), lambda b: discard(b.where(F.col(reason).isNotNull()))])

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", path).trigger(availableNow=True).start()
