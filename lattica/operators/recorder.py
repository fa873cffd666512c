"""The recorder chain: channels to samples, rational resampling, sidebands, whole seconds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .channelise import STRETCH, _stretches


def inverse_transform(spectra: DataFrame, channels: int) -> DataFrame:
    """spectra (ts, pol, re array, im array) -> samples (i, pol, re, im)."""

    def run(batches):
        for at in batches:
            if not len(at):
                continue
            z = np.stack(at["re"]).astype(float) + 1j * np.stack(at["im"]).astype(float)
            x = np.fft.ifft(z, axis=1)
            i = at["ts"].to_numpy(np.int64)[:, None] * channels + np.arange(channels)
            yield pd.DataFrame({"i": i.ravel(), "pol": np.repeat(at["pol"].to_numpy(), channels), "re": x.real.ravel(), "im": x.imag.ravel()})

    return spectra.where(F.size("re") == channels).mapInPandas(run, "i long, pol long, re double, im double")


def by_second(samples: DataFrame, rate: int, fraction: float) -> DataFrame:
    """samples (i, ...) with second, and offset in it; sample 0 is `fraction` of a second late."""
    at = F.col("i") + round(fraction * rate)
    return samples.withColumn("second", F.floor(at / rate)).withColumn("offset", at - F.col("second") * rate)


def quantised_delay(delay: Column, sync: float, rate: float) -> Column:
    """The delay nearest to the one asked for with which the epoch falls on an output sample."""
    fraction = F.pmod(F.lit(sync % 1.0) + F.pmod(delay, F.lit(1.0)), F.lit(1.0))
    return delay + (F.rint(fraction * rate) / rate - fraction)


def low_pass(taps: int, cutoff: float) -> np.ndarray:
    """Hann-windowed sinc of unit gain at zero; cutoff as a share of the sample rate."""
    n = np.arange(taps) - (taps - 1) / 2
    w = np.sinc(2 * cutoff * n) * np.hanning(taps + 2)[1:-1]
    return w / w.sum()


def sidebands(samples: DataFrame, up: int, down: int, taps: int = 96, share: float = 0.9) -> DataFrame:
    """samples (i, re, im), i from 0 -> (n, usb, lsb): complex samples resampled by up / down, and the parts of
    positive and of negative frequency as real samples of that rate.

    A stretch of whole periods of `down` samples and the filter's length after it give its outputs, so
    stretches agree at their seams. Output n stands at input time n * down / up + (taps - 1) / 2; outputs that lack a
    sample are left out.
    """
    rate = up / down
    half = min(1.0, rate) * share / 2
    usb_turn = np.exp(2j * np.pi * (half / 2) * (np.arange(taps * up) - (taps * up - 1) / 2) / up)
    band = low_pass(taps * up, half / 2 / up) * up
    filters = {"usb": band * usb_turn.conj(), "lsb": band * usb_turn}  # applied from the first sample on, so back to front
    step = down
    periods = max(-(-taps // step) + 1, STRETCH // step)

    def run(batches):
        for at in batches:
            for part, i, re, im in zip(at["part"], at["i"], at["re"], at["im"], strict=True):
                i, x = np.asarray(i), np.asarray(re, float) + 1j * np.asarray(im, float)
                first, size = part * periods * step, periods * step + taps
                whole, seen = np.zeros(size, complex), np.zeros(size, bool)
                ok = i - first < size
                whole[i[ok] - first], seen[i[ok] - first] = x[ok], True
                missing = np.concatenate([[0], np.cumsum(~seen)])
                n = np.arange(periods * up)
                base, phase = n * down // up, n * down % up
                good = missing[base + taps] == missing[base]
                window = whole[base[:, None] + np.arange(taps)]
                out = {}
                for name, h in filters.items():
                    by_phase = h.reshape(taps, up)[:, ::-1].T  # [phase, tap]
                    out[name] = 2 * (window * by_phase[phase]).sum(axis=1).real
                yield pd.DataFrame({"n": part * periods * up + n, **out})[good]

    return _stretches(samples, ["re", "im"], step, -(-taps // step) + 1, periods).mapInPandas(run, "n long, usb double, lsb double")
