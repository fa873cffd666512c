"""Channeliser: polyphase filter, discrete Fourier transform, mixing and decimation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pfb_weights(channels: int, taps: int, w_cutoff: float = 1.0, window: str = "hann") -> np.ndarray:
    """Windowed sinc of unit energy, 2 * channels * taps values."""
    n = 2 * channels * taps
    x = np.sinc(w_cutoff * ((np.arange(n) + 0.5) / (2 * channels) - taps / 2))
    if window == "hann":
        x = x * np.hanning(n) if n > 1 else x
    return x / np.sqrt(np.sum(x * x))


def fir(samples: DataFrame, weights, taps: int, step: int) -> DataFrame:
    """samples (i, x), i from 0 -> (k, b, y): y[k, b] = sum over tap of w[tap * step + b] *
    x[(k + tap) * step + b]; outputs that lack a sample are left out. weights(index) is an
    expression, so each sample expands to `taps` products, summed map-side first."""
    n = F.col("i")
    spread = samples.select(F.floor(n / step).alias("row"), F.pmod(n, F.lit(step)).cast("int").alias("b"), "x", F.explode(F.sequence(F.lit(0), F.lit(taps - 1))).alias("tap"))
    out = spread.select((F.col("row") - F.col("tap")).alias("k"), "b", (weights(F.col("tap") * step + F.col("b")) * F.col("x")).alias("p")).where("k >= 0")
    return out.groupBy("k", "b").agg(F.sum("p").alias("y"), F.count("p").alias("n")).where(F.col("n") == taps).drop("n")


def dft(rows: DataFrame, size: int) -> DataFrame:
    """rows (k, b, y) real, b in 0..size-1 -> (k, chan, re, im), channels below Nyquist; spectra that
    lack a b are left out. For few channels: each row becomes size / 2; spectra() is for many."""
    turned = rows.select("k", "b", "y", F.explode(F.sequence(F.lit(0), F.lit(size // 2 - 1))).alias("chan"))
    angle = F.pmod(F.col("b") * F.col("chan"), F.lit(size)) * (-2 * math.pi / size)
    return turned.groupBy("k", "chan").agg(F.sum(F.col("y") * F.cos(angle)).alias("re"), F.sum(F.col("y") * F.sin(angle)).alias("im"), F.count("y").alias("n")).where(F.col("n") == size).drop("n")


def fir_joined(samples: DataFrame, weights: DataFrame, taps: int, step: int) -> DataFrame:
    """The same by a join with a weight table (tap, b, w), for weights that change or come from elsewhere: sample
    i meets the `taps` weights of its branch. The table has taps * step rows."""
    n = F.col("i")
    rows = samples.select(F.floor(n / step).alias("row"), F.pmod(n, F.lit(step)).cast("int").alias("b"), "x")
    out = rows.join(weights, "b").select((F.col("row") - F.col("tap")).alias("k"), "b", (F.col("w") * F.col("x")).alias("p")).where("k >= 0")
    return out.groupBy("k", "b").agg(F.sum("p").alias("y"), F.count("p").alias("n")).where(F.col("n") == taps).drop("n")


def dft_joined(rows: DataFrame, twiddles: DataFrame, size: int) -> DataFrame:
    """rows (k, b, y) by a join with a table (b, chan, c, s) of turns, size * channels rows."""
    met = rows.join(twiddles, "b")
    out = met.groupBy("k", "chan").agg(F.sum(F.col("y") * F.col("c")).alias("re"), F.sum(F.col("y") * F.col("s")).alias("im"), F.count("y").alias("n"))
    return out.where(F.col("n") == size).drop("n")


def ddc(samples: DataFrame, weights, taps: int, subsample: int, num: int, den: int) -> DataFrame:
    """samples (i, x) -> (n, re, im): mix by exp(2 pi j i num / den) (an exact rational
    phase), filter, keep every subsample-th output that has all its samples."""
    tap = F.explode(F.sequence(F.pmod("i", F.lit(subsample)), F.lit(taps - 1).cast("long"), F.lit(subsample).cast("long")))
    phase = F.pmod(F.col("i") * num, F.lit(den)) * (2 * math.pi / den)
    spread = samples.where(F.pmod("i", F.lit(subsample)) < taps).select("x", phase.alias("phase"), "i", tap.alias("tap"))
    w = weights(F.col("tap")) * F.col("x")
    out = spread.select(F.expr(f"(i - tap) div {subsample}").alias("n"), (w * F.cos("phase")).alias("r"), (w * F.sin("phase")).alias("m")).where("n >= 0")
    return out.groupBy("n").agg(F.sum("r").alias("re"), F.sum("m").alias("im"), F.count("r").alias("c")).where(F.col("c") == taps).drop("c")


def _stretches(samples: DataFrame, columns: list[str], step: int, taps: int, rows: int) -> DataFrame:
    """samples (i, columns), i from 0 -> (part, first, n, columns as arrays): `rows` steps at a time with the taps - 1
    steps after them, in order; each sample is in one stretch, or two where stretches overlap."""
    size, ahead = step * rows, step * (taps - 1)
    own = F.floor(F.col("i") / size)
    homes = F.when((F.pmod(F.col("i"), F.lit(size)) < ahead) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    cell = F.struct("i", *columns)
    packed = samples.withColumn("part", F.explode(homes)).groupBy("part").agg(F.sort_array(F.collect_list(cell)).alias("v"))
    return packed.select("part", F.col("v.i").alias("i"), *(F.col(f"v.{c}").alias(c) for c in columns))


def _filtered(i: np.ndarray, x: np.ndarray, part: int, w: np.ndarray, taps: int, step: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(k, outputs [k, step]) of one stretch, those whose window is whole."""
    first, most = part * rows * step, (rows + taps - 1) * step
    whole, seen = np.zeros(most, x.dtype), np.zeros(most, bool)
    whole[i - first], seen[i - first] = x, True
    grid, there = whole.reshape(-1, step), seen.reshape(-1, step).all(axis=1)
    y = sum(w[t] * grid[t : t + rows] for t in range(taps))
    ok = np.logical_and.reduce([there[t : t + rows] for t in range(taps)])
    return part * rows + np.flatnonzero(ok), y[ok]


STRETCH = 1 << 16  # samples of one stretch


def spectra(samples: DataFrame, weights: np.ndarray, taps: int, channels: int) -> DataFrame:
    """samples (i, x) real -> (k, chan, re, im): filter and numpy's real FFT over stretches of samples
    packed in arrays; the path for many channels."""
    step = 2 * channels
    w, rows = np.asarray(weights, float).reshape(taps, step), max(taps, STRETCH // step)

    def run(batches):
        for at in batches:
            for part, i, x in zip(at["part"], at["i"], at["x"], strict=True):
                k, y = _filtered(np.asarray(i), np.asarray(x, float), part, w, taps, step, rows)
                z = np.fft.rfft(y, axis=1)[:, :channels]
                yield pd.DataFrame({"k": np.repeat(k, channels), "chan": np.tile(np.arange(channels, dtype=np.int32), len(k)), "re": z.real.ravel(), "im": z.imag.ravel()})

    return _stretches(samples, ["x"], step, taps, rows).mapInPandas(run, "k long, chan int, re double, im double")


def complex_spectra(samples: DataFrame, weights: np.ndarray, taps: int, channels: int) -> DataFrame:
    """samples (i, re, im) -> (k, chan, re, im), the zero frequency at channels / 2."""
    w, rows = np.asarray(weights, float).reshape(taps, channels), max(taps, STRETCH // channels)

    def run(batches):
        for at in batches:
            for part, i, re, im in zip(at["part"], at["i"], at["re"], at["im"], strict=True):
                k, y = _filtered(np.asarray(i), np.asarray(re, float) + 1j * np.asarray(im, float), part, w, taps, channels, rows)
                z = np.fft.fftshift(np.fft.fft(y, axis=1), axes=1)
                yield pd.DataFrame({"k": np.repeat(k, channels), "chan": np.tile(np.arange(channels, dtype=np.int32), len(k)), "re": z.real.ravel(), "im": z.imag.ravel()})

    return _stretches(samples, ["re", "im"], channels, taps, rows).mapInPandas(run, "k long, chan int, re double, im double")
