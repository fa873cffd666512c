"""After the transform: fine delay, phase and gain, quantising, clip counts, corner turn, output heaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from . import timeline


def corrected(spectra: DataFrame, fine: DataFrame, gains: DataFrame, channels: int, digits: int | None = None, bits: int = 8) -> DataFrame:
    """spectra (spectrum, pol, chan, re, im), fine (spectrum, pol, delay, phase), gains (chan, pol,
    g_re, g_im) -> (spectrum, pol, chan, re, im, clipped) in whole numbers. gains has a row for each channel
    and polarisation of the instrument; digits rounds before quantising."""
    angle = X.phase_slope(F.col("chan"), channels, F.col("delay"), F.col("phase"))
    turned = X.rotate((F.col("re"), F.col("im")), angle)
    re, im = X.cmul(turned, (F.col("g_re"), F.col("g_im")))
    tidy = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    met = spectra.join(fine, ["spectrum", "pol"]).join(gains, ["chan", "pol"])
    out = met.select("spectrum", "pol", "chan", tidy(re).alias("re"), tidy(im).alias("im"))
    return out.select("spectrum", "pol", "chan", X.quantise(F.col("re"), bits).alias("re"), X.quantise(F.col("im"), bits).alias("im"), (X.saturated(F.col("re"), bits) | X.saturated(F.col("im"), bits)).alias("clipped"))


def clip_counts(voltages: DataFrame, spectra_per_heap: int) -> DataFrame:
    """(heap, pol, clipped): complex values with a clipped part, each once."""
    return voltages.groupBy(F.floor(F.col("spectrum") / spectra_per_heap).alias("heap"), "pol").agg(F.count_if("clipped").alias("clipped"))


def corner_turn(voltages: DataFrame, spectra_per_heap: int) -> DataFrame:
    """(heap, chan, re, im): arrays in order of spectrum, then polarisation; heaps that lack a value are left out."""
    cell = F.struct("spectrum", "pol", "re", "im")
    packed = voltages.groupBy(F.floor(F.col("spectrum") / spectra_per_heap).alias("heap"), "chan").agg(F.sort_array(F.collect_list(cell)).alias("v"))
    return packed.where(F.size("v") == 2 * spectra_per_heap).select("heap", "chan", F.col("v.re").alias("re"), F.col("v.im").alias("im"))


def in_force(flushes: DataFrame, changes: DataFrame, fields: list[str], bucket: int = 4096) -> DataFrame:
    """flushes (t, ...) with the fields of the latest change (start, fields) at or before each: a
    change takes effect at the next flush."""
    return timeline.as_of(flushes, changes, fields, bucket)


def output_heaps(spectra: DataFrame, spectra_per_heap: int) -> DataFrame:
    """spectra (spectrum) that could be made -> whole heaps, aligned to multiples of spectra_per_heap, with how
    many heaps were skipped before each; after a gap a heap begins at the next multiple, and
    partial heaps are dropped."""
    heap = F.floor(F.col("spectrum") / spectra_per_heap)
    whole = spectra.groupBy(heap.alias("heap")).agg(F.count_distinct("spectrum").alias("n")).where(F.col("n") == spectra_per_heap).drop("n")
    return timeline.gaps(whole, "heap", 1)


def last_step_power(samples: DataFrame, taps: int, step: int) -> DataFrame:
    """samples (i, x), i from 0 -> (k, power): sum of squares over the last step of each FIR window."""
    rows = samples.groupBy(F.floor(F.col("i") / step).alias("row")).agg(F.sum(F.col("x") * F.col("x")).alias("power"), F.count("x").alias("n"))
    return rows.where((F.col("n") == step) & (F.col("row") >= taps - 1)).select((F.col("row") - (taps - 1)).alias("k"), "power")


def inner_channels(rows: DataFrame, channels: int) -> DataFrame:
    """Of 2 * channels the inner half, numbered from 0."""
    return rows.where(F.col("chan").between(channels // 2, channels // 2 + channels - 1)).withColumn("chan", F.col("chan") - channels // 2)


def zero_absent(voltages: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of what isn't present as zeros; none is removed."""
    flagged = voltages.join(present.select(*keys, "present"), keys, "left")
    value = lambda c: F.when(F.coalesce("present", F.lit(False)), F.col(c)).otherwise(0)
    return flagged.withColumn("re", value("re")).withColumn("im", value("im")).drop("present")


def tone_gain(re: Column, im: Column, amplitude: Column) -> Column:
    """Gain that a tone of `amplitude` met."""
    return F.hypot(re, im) / amplitude
