"""What engines send, as rows: heaps by substream with their ids, gates and counters, frames, announcements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import timeline


def substream(chan: Column, channels: int, substreams: int) -> Column:
    """Contiguous equal blocks of channels."""
    return F.floor(chan / (channels // substreams))


def interface(heap: Column, heaps: int, interfaces: int) -> Column:
    """Contiguous blocks of heaps."""
    return F.floor(heap * interfaces / heaps)


def channelised(batches: DataFrame, substreams: int, engine: int, engines: int, interfaces: int, heap_bytes: int, block: int = 4096) -> DataFrame:
    """batches (batch, present) -> a row for each heap sent: batch, substream, heap_id, interface, bytes. All
    heaps of a batch are sent if it is present, else none; ids of a substream go up by `engines`."""
    numbered = timeline.running(batches, ["batch"], {"ordinal": ("sum", F.col("present").cast("long"))}, block).where("present")
    heaps = numbered.select("batch", (F.col("ordinal") - 1).alias("ordinal"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(substreams - 1).cast("long"))).alias("substream"))
    heap_id = F.shiftleft("substream", 40) + engine + F.col("ordinal") * engines
    return heaps.select("batch", "substream", heap_id.alias("heap_id"), interface(F.col("substream"), substreams, interfaces).alias("interface"), F.lit(heap_bytes).alias("bytes"))


def gated(rows: DataFrame, ts: str, enabled: DataFrame, key: list[str] | None = None) -> DataFrame:
    """rows from the timestamp that their stream is enabled from; enabled (key, enabled, since) is small, a row a stream."""
    key = key or []
    if not key:
        on = enabled.where("enabled").agg(F.min("since").alias("m")).first()["m"]
        return rows.where(F.lit(False)) if on is None else rows.where(F.col(ts) >= on)
    since = enabled.where("enabled").select(*(F.col(k).alias(f"_{k}") for k in key), F.col("since").alias("_since"))
    same = [F.col(k) == F.col(f"_{k}") for k in key]
    return rows.join(since, same, "inner").where(F.col(ts) >= F.col("_since")).drop("_since", *(f"_{k}" for k in key))


def product_counters(accs: DataFrame, heap_bytes: int, products: int) -> DataFrame:
    """accs (stream, acc, complete antennas, antennas, clipped) -> counters of what is sent: an accumulation without
    any complete antenna is skipped, one without all is incomplete."""
    skipped, whole = F.col("complete") == 0, F.col("complete") == F.col("antennas")
    sent = F.count_if(~skipped)
    return accs.groupBy("stream").agg(sent.alias("heaps"), (sent * heap_bytes).alias("bytes"), (sent * products).alias("visibilities"), F.sum(F.when(skipped, 0).otherwise(F.col("clipped"))).alias("clipped"), F.count_if(skipped).alias("skipped_accs"), F.count_if(~skipped & ~whole).alias("incomplete_accs"))


def frames(levels: DataFrame, samples: int, destinations: int) -> DataFrame:
    """levels (i, thread, level 0..3) -> frames (frame, thread, seq, destination, payload): 2 bits a sample, the
    first in the low bits; frames that lack a sample are left out. seq counts frames of all
    threads in order; destinations take turns."""
    if samples % 4:
        raise ValueError("a frame must fill whole bytes")
    whole = levels.groupBy(F.floor(F.col("i") / samples).alias("frame"), "thread").agg(F.sort_array(F.collect_list(F.struct("i", F.col("level").cast("int").alias("level")))).alias("v")).where(F.size("v") == samples)
    threads = levels.agg(F.max("thread").alias("m")).first()["m"]
    seq = F.col("frame") * ((threads or 0) + 1) + F.col("thread")
    byte = lambda k: F.col("l")[k * 4] + F.col("l")[k * 4 + 1] * 4 + F.col("l")[k * 4 + 2] * 16 + F.col("l")[k * 4 + 3] * 64
    packed = whole.select("frame", "thread", seq.alias("seq"), F.pmod(seq, F.lit(destinations)).alias("destination"), F.col("v.level").alias("l"))
    return packed.select("frame", "thread", "seq", "destination", F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(samples // 4 - 1)), lambda k: F.lpad(F.hex(byte(k)), 2, "0")), "")).alias("payload"))


def announcements(spark: SparkSession, first: int, until: int, interval: int, substreams: int) -> DataFrame:
    """(at, substream): a description of the stream at once and then every interval, counted from the first, so
    that lateness never adds up."""
    return spark.range(first, until, interval).select(F.col("id").alias("at"), F.explode(F.sequence(F.lit(0), F.lit(substreams - 1))).alias("substream"))


def stops(sent: DataFrame) -> DataFrame:
    """The end of each substream: one row after its last heap."""
    return sent.groupBy("substream").agg(F.max("batch").alias("after"), F.max("heap_id").alias("last_id"))


def queue_events(events: DataFrame, block: int = 4096) -> DataFrame:
    """events (at, queue, delta) -> with qsize, the queue's size after each."""
    return timeline.running(events, ["at"], {"qsize": ("sum", F.col("delta"))}, block, ["queue"])


def key_values(rows: DataFrame, prefix: list[str], values: list[str]) -> DataFrame:
    """Columns as (key, value) strings; keys are the prefix columns and the column's name joined by '_'."""
    pairs = F.array(*(F.struct(F.concat_ws("_", *(F.col(p).cast("string") for p in prefix), F.lit(v)).alias("key"), F.col(v).cast("string").alias("value")) for v in values))
    return rows.select(F.explode(pairs).alias("p")).select("p.*")


def latest(readings: DataFrame) -> DataFrame:
    """readings (name, ts, status, value) -> the last of each sensor."""
    return readings.groupBy("name").agg(F.max_by(F.struct("ts", "status", "value"), F.col("ts")).alias("r")).select("name", "r.*")


def status_rank(status: Column) -> Column:
    return F.when(status == "unknown", 0).when(status == "nominal", 1).when(status == "warn", 2).when(status == "error", 3).otherwise(4)


def device_status(readings: DataFrame) -> DataFrame:
    """ok unless the latest status of any sensor is worse than nominal."""
    return latest(readings).agg(F.when(F.coalesce(F.max(status_rank(F.col("status"))), F.lit(0)) <= 1, "ok").otherwise("degraded").alias("device_status"))
