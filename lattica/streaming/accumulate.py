"""Streams of heaps: event-time windows in append mode, the open window never flushed; finished streams read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_dir


def windowed(stream: DataFrame, keys: list[str], width: str, late: str) -> DataFrame:
    """stream (ts timestamp, keys, value) -> (start, keys, n, total) for each closed window. Rows later
    than `late` behind the newest are dropped; progress counts them (numRowsDroppedByWatermark)."""
    w = F.window("ts", width)
    return stream.withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def finished(stream: DataFrame) -> DataFrame:
    """Run a stream over all there is and read its rows from the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def events(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events as a stream; `files` bounds what one micro-batch takes."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one stream, available now; windows a day behind the latest event close."""
    out = windowed(events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"), ["event_type"], "1 day", "1 day")
    return finished(out).select(F.to_date("start").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
