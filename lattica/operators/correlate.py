"""Correlation and beamforming: integer-exact products of antenna voltages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X


PART_TICKS = 256  # timestamps that are correlated at once


def _outer(ts: np.ndarray, inputs: np.ndarray, re: np.ndarray, im: np.ndarray) -> tuple[np.ndarray, ...]:
    """Samples of one channel -> (input 1, input 2, re, im) of all products that have a sample pair:
    one product of matrices, in numbers that are exact."""
    ticks, t = np.unique(ts, return_inverse=True)
    names, i = np.unique(inputs, return_inverse=True)
    most = max(int(np.abs(re).max(initial=0)), int(np.abs(im).max(initial=0)))
    kind = np.float64 if 2 * most * most * len(ticks) < 2**53 else np.int64
    r, m, there = (np.zeros((len(ticks), len(names)), k) for k in (kind, kind, np.float64))
    r[t, i], m[t, i], there[t, i] = re, im, 1
    real, imag = r.T @ r + m.T @ m, m.T @ r - r.T @ m
    x, y = np.nonzero(there.T @ there)
    return names[x], names[y], real[x, y].astype(np.int64), imag[x, y].astype(np.int64)


def _correlated(batches):
    for at in batches:
        out = []
        for acc, chan, ts, ant, pol, re, im in zip(at["acc"], at["chan"], at["ts"], at["ant"], at["pol"], at["re"], at["im"], strict=True):
            one, two, real, imag = _outer(np.asarray(ts), 2 * np.asarray(ant, np.int64) + np.asarray(pol, np.int64), np.asarray(re, np.int64), np.asarray(im, np.int64))
            keep = one // 2 <= two // 2
            one, two = one[keep], two[keep]
            out.append(pd.DataFrame({"acc": acc, "chan": chan, "a1": one // 2, "p1": one % 2, "a2": two // 2, "p2": two % 2, "re": real[keep], "im": imag[keep]}))
        if out:
            yield pd.concat(out, ignore_index=True)


def visibilities(voltages: DataFrame, batch_ticks: int, threshold: int | None = None, presence: DataFrame | None = None) -> DataFrame:
    """voltages (ts, ant, chan, pol, re, im) -> (acc, chan, prod, re, im, clipped).

    Samples of a channel are packed for PART_TICKS timestamps at a time, so that each is shuffled
    once; a task multiplies them as one matrix, and partial sums are combined before their shuffle.
    Sums are 64-bit and saturate at the end. acc is ts div batch_ticks, aligned to tick 0. With presence (ant, ts,
    present) an antenna that misses a timestamp of an accumulation, or an accumulation with fewer
    than `threshold` timestamps, gives the missing pair.
    """
    acc = F.floor(F.col("ts") / batch_ticks).alias("acc")
    cell = F.collect_list(F.struct("ts", F.col("ant").cast("int").alias("ant"), F.col("pol").cast("int").alias("pol"), F.col("re").cast("int").alias("re"), F.col("im").cast("int").alias("im")))
    packed = voltages.groupBy(acc, F.floor(F.col("ts") / PART_TICKS).alias("part"), F.col("chan").cast("int").alias("chan")).agg(cell.alias("v"))
    partial = packed.select("acc", "chan", *(F.col(f"v.{c}").alias(c) for c in ("ts", "ant", "pol", "re", "im"))).mapInPandas(_correlated, "acc long, chan int, a1 int, p1 int, a2 int, p2 int, re long, im long")
    keys = ["acc", "chan", X.product(X.baseline(F.col("a1"), F.col("a2")), F.col("p1"), F.col("p2")).alias("prod"), "a1", "a2"]
    sums = partial.groupBy(*keys).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    out = sums.withColumn("clipped", (F.abs("re") > X.INT32_MAX) | (F.abs("im") > X.INT32_MAX)).withColumn("re", X.saturate32(F.col("re"))).withColumn("im", X.saturate32(F.col("im")))
    if presence is None:
        return out.drop("a1", "a2")
    whole = complete(presence, batch_ticks, threshold)
    left, right = (whole.select(F.col("acc").alias(f"acc_{k}"), F.col("ant").alias(f"ant_{k}"), F.col("complete").alias(f"ok_{k}")) for k in "12")
    flagged = out.join(left, (F.col("acc") == F.col("acc_1")) & (F.col("a1") == F.col("ant_1"))).join(right, (F.col("acc") == F.col("acc_2")) & (F.col("a2") == F.col("ant_2")))
    ok = F.col("ok_1") & F.col("ok_2")
    return flagged.select("acc", "chan", "prod", F.when(ok, F.col("re")).otherwise(F.lit(X.MISSING[0])).alias("re"), F.when(ok, F.col("im")).otherwise(F.lit(X.MISSING[1])).alias("im"), (ok & F.col("clipped")).alias("clipped"))


def complete(presence: DataFrame, batch_ticks: int, threshold: int | None) -> DataFrame:
    """(acc, ant, complete): present at every timestamp, and as many of them as needed."""
    n = F.count_distinct("ts")
    return presence.groupBy(F.floor(F.col("ts") / batch_ticks).alias("acc"), "ant").agg((F.bool_and("present") & (n == threshold if threshold else F.lit(True))).alias("complete"))


def beams(voltages: DataFrame, weights: DataFrame, bits: int = 8, digits: int | None = None, dither_seed: int | None = None) -> DataFrame:
    """voltages (ts, ant, chan, pol, re, im), weights (beam, pol, ant, w_re, w_im, and if wanted delay in half
    turns a channel and dither) -> (ts, beam, chan, q_re, q_im, clipped). Weights are a dimension
    table: antennas x beams. Beams with dither get it before quantising, if there is a seed."""
    delayed, dithered = "delay" in weights.columns, "dither" in weights.columns and dither_seed is not None
    w = weights.select("beam", F.col("pol").alias("_p"), F.col("ant").alias("_a"), "w_re", "w_im", (F.col("delay") if delayed else F.lit(0.0)).alias("_d"), (F.col("dither") if dithered else F.lit(False)).alias("_n"))
    met = voltages.join(w, (F.col("ant") == F.col("_a")) & (F.col("pol") == F.col("_p")))
    weight = (F.col("w_re"), F.col("w_im"))
    if delayed:
        weight = X.cmul(weight, X.beam_phase(F.col("chan"), F.col("_d")))
    re, im = X.cmul((F.col("re").cast("double"), F.col("im").cast("double")), weight)
    sums = met.groupBy("ts", "beam", "chan").agg(F.sum(re).alias("re"), F.sum(im).alias("im"), F.bool_or("_n").alias("_n"))
    part = {c: F.col(c) if digits is None else F.round(c, digits) for c in ("re", "im")}
    if dithered:
        part = {c: v + F.when(F.col("_n"), X.dither(F.col("beam"), F.col("chan"), F.col("ts"), F.lit(k), seed=dither_seed)).otherwise(0.0) for k, (c, v) in enumerate(part.items())}
    sums = sums.select("ts", "beam", "chan", *(v.alias(c) for c, v in part.items()))
    return sums.select("ts", "beam", "chan", X.quantise(F.col("re"), bits).alias("q_re"), X.quantise(F.col("im"), bits).alias("q_im"), (X.saturated(F.col("re"), bits) | X.saturated(F.col("im"), bits)).alias("clipped"))


def present_antennas(presence: DataFrame) -> DataFrame:
    """(ts, beam_ants): antennas present in each batch."""
    return presence.groupBy("ts").agg(F.count_if("present").alias("beam_ants"))


def basis(voltages: DataFrame, matrix: list[list[complex]]) -> DataFrame:
    """2x2 change of polarisation basis: out[p] = sum_q matrix[p][q] * x[q], of complex factors; one pivot, no join."""
    pair = voltages.groupBy("ts", "ant", "chan").agg(*(F.sum(F.when(F.col("pol") == p, F.col(c).cast("double")).otherwise(0.0)).alias(f"{c}{p}") for p in (0, 1) for c in ("re", "im")))
    rows = F.array(*(F.struct(F.lit(p).alias("pol"), *_turned(matrix[p])) for p in (0, 1)))
    return pair.select("ts", "ant", "chan", F.explode(rows).alias("r")).select("ts", "ant", "chan", "r.pol", "r.re", "r.im")


def _turned(row: list[complex]) -> list:
    re = im = None
    for q, z in enumerate(map(complex, row)):
        x, y = X.cmul((F.lit(z.real), F.lit(z.imag)), (F.col(f"re{q}"), F.col(f"im{q}"))) if z.imag else (z.real * F.col(f"re{q}"), z.real * F.col(f"im{q}"))
        re, im = (x, y) if re is None else (re + x, im + y)
    return [re.alias("re"), im.alias("im")]
