"""Digitiser simulator: signals sampled over a period, quantised, turned to a timestamp, repeated, counted and packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from .dsl import Signal


def sample(spark: SparkSession, signals: list[Signal], timestamp: int, period: int | None, samples: int, rate: float, bits: int, dither_seed: int | None = 0, digits: int | None = None) -> DataFrame:
    """(pol, i, x): `samples` quantised values of each signal from `timestamp` on; the signal repeats
    every `period` (all samples if None), which must divide their number. Signals that allow it get
    dither (none at all with dither_seed None)."""
    period = samples if period is None else period
    if samples % period:
        raise ValueError(f"period {period} does not divide into {samples} samples")
    out = None
    for pol, signal in enumerate(signals):
        i = F.col("i")
        src = F.pmod(i + timestamp, F.lit(period))
        value = signal.column(src, period, rate)
        value = value if digits is None else F.round(value, digits)
        noise = X.dither(F.lit(pol), src, seed=dither_seed) if signal.dithered and dither_seed is not None else None
        rows = spark.range(samples).select(F.col("id").alias("i")).select(F.lit(pol).alias("pol"), "i", X.quantise_digitiser(value, bits, noise).alias("x"))
        out = rows if out is None else out.unionByName(rows)
    return out


def saturation(samples: DataFrame, group: int, bits: int) -> DataFrame:
    """(pol, heap, saturated): values at or beyond the limit in each group of samples."""
    return samples.groupBy("pol", F.floor(F.col("i") / group).alias("heap")).agg(F.count_if(X.at_limit(F.col("x"), bits)).alias("saturated"))


def packed(samples: DataFrame, group: int, bits: int) -> DataFrame:
    """(pol, heap, payload): each group's values as big-endian bit fields."""
    if group * bits % 8:
        raise ValueError("a heap must fill whole bytes")
    rows = samples.groupBy("pol", F.floor(F.col("i") / group).alias("heap")).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select("pol", "heap", X.pack_bits(F.col("v.x"), bits).alias("payload"))


def replayed(window: DataFrame, ticks: DataFrame, period: int) -> DataFrame:
    """ticks (ts, ...) with the values of a periodic window (i, ...): one join on ts mod period."""
    return ticks.withColumn("i", F.pmod("ts", F.lit(period))).join(window, "i").drop("i")
