"""Heaps as rows: layouts, placement in chunks, reject rules and receive accounting.

A heap is a row of immediate items (ts, heap_len, digitiser_id, status, feng_id, frequency, beam_ants, ...) in
order of arrival. Chunks are tumbling windows of `chunk_batches` batches aligned to timestamp 0. A chunk is
given up once one `active` chunks later has begun; heaps for it are too old from then on.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, ByteType, IntegerType, LongType, ShortType, StructField, StructType

from ..functions import exprs as X
from ..operators import timeline


@dataclass(frozen=True)
class Layout:
    """Sizes of one stream. step: timestamps of a batch; mask: drop the low bits of timestamps."""

    heap_bytes: int
    step: int
    chunk_batches: int
    batch_heaps: int = 1
    heap_samples: int = 1
    mask: bool = False

    @property
    def chunk_step(self) -> int:
        return self.step * self.chunk_batches

    def active_chunks(self, tolerance: int) -> int:
        """Chunks open at once for heaps up to `tolerance` timestamps late."""
        return -(-tolerance // self.chunk_step) + 1

    def timestamp(self) -> Column:
        return X.mask_timestamp(F.col("ts"), self.heap_samples) if self.mask else F.col("ts")


def gaussian(bits: int):
    """The type of a complex integer of `bits` bits a part; 4-bit pairs share a byte."""
    parts = {8: ByteType, 16: ShortType, 32: IntegerType}
    if bits == 4:
        return ByteType()
    if bits not in parts:
        raise ValueError(f"no complex integer of {bits} bits")
    return StructType([StructField("re", parts[bits]()), StructField("im", parts[bits]())])


HEAP = StructType([StructField(x, LongType()) for x in ("heap_len", "ts", "digitiser_id", "status", "feng_id", "frequency", "beam_ants")] + [StructField("payload", BinaryType())])


def rejected(heaps: DataFrame, layout: Layout, antennas: int | None = None, channels: int | None = None, channels_per_heap: int = 1) -> DataFrame:
    """heaps with ts masked and reason: why the heap is dropped, null if it is placed. The first
    rule that fits wins: size or a negative item, timestamp, engine or frequency."""
    ts = layout.timestamp()
    negative = ts < 0
    for c, used in (("feng_id", antennas), ("frequency", channels)):
        if used is not None:
            negative = negative | (F.col(c) < 0)
    reason = F.when((F.col("heap_len") != layout.heap_bytes) | negative, "metadata").when(F.pmod(ts, F.lit(layout.step)) != 0, "bad_timestamp")
    if antennas is not None:
        reason = reason.when(F.col("feng_id") >= antennas, "bad_feng_id")
    if channels is not None:
        reason = reason.when((F.col("frequency") >= channels) | (F.pmod("frequency", F.lit(channels_per_heap)) != 0), "bad_frequency")
    return heaps.withColumn("ts", ts).withColumn("reason", reason)


def placed(heaps: DataFrame, layout: Layout, active: int, block: int = 4096, **rules) -> DataFrame:
    """heaps (arrival, ts, heap_len, ...) with reason, chunk and batch (of the chunk). A heap whose
    chunk was given up when it arrived has the reason too_old."""
    checked = rejected(heaps, layout, **rules).withColumn("chunk", F.floor(F.col("ts") / layout.chunk_step))
    taken = F.when(F.col("reason").isNull(), F.col("chunk"))
    newest = timeline.running(checked, ["arrival"], {"_newest": ("max", taken)}, block)
    old = F.col("reason").isNull() & (F.col("chunk") <= F.col("_newest") - active)
    return newest.withColumn("reason", F.when(old, "too_old").otherwise(F.col("reason"))).withColumn("batch", F.expr(f"(ts - chunk * {layout.chunk_step}) div {layout.step}")).drop("_newest")


def merged_streams(*streams: DataFrame, label: str = "pol") -> DataFrame:
    """Several single streams as one group, told apart by `label`."""
    out = None
    for k, s in enumerate(streams):
        s = s.withColumn(label, F.lit(k))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def reordered(heaps: DataFrame) -> DataFrame:
    """Placed heaps that were taken, with their place in their chunk by time: what a window of open chunks puts right.
    A chunk has as many heaps as its layout says."""
    w = Window.partitionBy("chunk").orderBy("ts", "arrival")
    return heaps.where("reason is null").withColumn("place", F.row_number().over(w) - 1)


def assembled(heaps: DataFrame, keys: list[str], positions: int) -> DataFrame:
    """Placed heaps (chunk, index, ...) against the whole grid of their chunks: (keys, chunk, index,
    present). Chunks without any heap don't appear."""
    got = heaps.where("reason is null").select(*keys, "chunk", "index").distinct().withColumn("_got", F.lit(True))
    chunks = got.select(*keys, "chunk").distinct()
    grid = chunks.withColumn("index", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(positions - 1).cast("long"))))
    return grid.join(got, [*keys, "chunk", "index"], "left").withColumn("present", F.col("_got").isNotNull()).drop("_got")


def accounting(heaps: DataFrame, layout: Layout, part: list[str], block: int = 1024) -> DataFrame:
    """Placed heaps -> a row for each part and chunk with any heap, in order: heaps, samples, bytes and clipped
    (saturation of heaps, each once), and missing: by how much expected-so-far less seen-so-far
    exceeds all it was before."""
    once = heaps.where("reason is null").groupBy(*part, "chunk", "ts").agg(F.max("saturated").alias("saturated"))
    per = once.groupBy(*part, "chunk").agg(F.count(F.lit(1)).alias("heaps"), F.sum("saturated").alias("clipped"))
    first = per.agg(F.min("chunk").alias("first")).first()["first"] or 0
    seen = timeline.running(per, ["chunk"], {"_seen": ("sum", F.col("heaps"))}, block, part)
    behind = seen.withColumn("_behind", (F.col("chunk") - first + 1) * (layout.chunk_batches * layout.batch_heaps) - F.col("_seen"))
    mark = timeline.running(behind, ["chunk"], {"_mark": ("max", F.col("_behind"))}, block, part, strictly=True)
    missing = F.greatest(F.col("_behind") - F.greatest(F.coalesce("_mark", F.lit(0)), F.lit(0)), F.lit(0))
    return mark.select(*part, "chunk", "heaps", (F.col("heaps") * layout.heap_samples).alias("samples"), (F.col("heaps") * layout.heap_bytes).alias("bytes"), "clipped", missing.alias("missing"))


def heap_ids(rows: DataFrame, sender: int, engine: int, engines: int, order: list[str]) -> DataFrame:
    """rows (ordinal, ...) with ids no other sender uses: from (sender << 40) + engine in steps of `engines`."""
    return rows.withColumn("heap_id", F.lit((sender << 40) + engine) + F.col("ordinal") * engines)


def send_rate(packet_header: int, packet_payload: int, heap_payload: Column, interval: Column, factor: float) -> Column:
    """Bytes a second that a sender is paced to; 0: as fast as it can."""
    packets = F.ceil(heap_payload / packet_payload)
    return F.when(interval == 0, F.lit(0.0)).otherwise((heap_payload + packets * packet_header) / interval * factor)


def tolerance_ticks(seconds: float, rate: float) -> int:
    return math.ceil(seconds * rate)
