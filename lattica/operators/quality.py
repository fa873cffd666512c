"""Qualification: figures of merit of spectra, phases, gains and beams, calibration trials, fits and searches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import timeline


def trial_class(missing: Column, throttled: Column) -> Column:
    return F.when(throttled, "throttled").when(missing == 0, "success").otherwise("failure")


def trials(rows: DataFrame) -> DataFrame:
    """rows (rate, missing, throttled, value) -> (rate, successes, trials, throttled, median)."""
    kind = trial_class(F.col("missing"), F.col("throttled"))
    return rows.groupBy("rate").agg(F.count_if(kind == "success").alias("successes"), F.count(F.lit(1)).alias("trials"), F.count_if(kind == "throttled").alias("throttled"), F.percentile("value", F.lit(0.5)).alias("median"))


def merged_dynamic_range(low: DataFrame, high: DataFrame, gain: float, limit: float) -> DataFrame:
    """Two runs' spectra (chan, power), the second with `gain` more: its power where the run wasn't near its limit,
    brought to the first one's scale."""
    h = high.select("chan", F.col("power").alias("_h"))
    met = low.join(h, "chan", "left")
    return met.select("chan", F.when(F.col("_h") <= limit, F.col("_h") / gain).otherwise(F.col("power")).alias("power"))


def phase_errors(rows: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """rows (keys, chan, error) -> largest and rms phase error over channels low..high."""
    inside = rows.where(F.col("chan").between(low, high))
    return inside.groupBy(*keys).agg(F.max(F.abs("error")).alias("worst"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rms"))


def cut_off(response: DataFrame, keys: list[str], level: float) -> DataFrame:
    """response (keys, x, db) -> (keys, low, high): where it first comes up to the level and last falls below it,
    between points on a line. A response has as many points as were measured."""
    w = Window.partitionBy(*keys).orderBy("x")
    both = response.select(*keys, "x", "db", F.lag("x").over(w).alias("_x"), F.lag("db").over(w).alias("_db"))
    at = F.col("_x") + (level - F.col("_db")) / (F.col("db") - F.col("_db")) * (F.col("x") - F.col("_x"))
    return both.groupBy(*keys).agg(F.min(F.when((F.col("_db") < level) & (F.col("db") >= level), at)).alias("low"), F.max(F.when((F.col("_db") >= level) & (F.col("db") < level), at)).alias("high"))


def total_power(spectra: DataFrame, keys: list[str], expected: Column, within: float = 0.01) -> DataFrame:
    """spectra (keys, power, ...) -> total, and whether it is within a share of what is expected."""
    return spectra.groupBy(*keys).agg(F.sum("power").alias("total"), F.max(expected).alias("expected")).withColumn("ok", F.abs(F.col("total") - F.col("expected")) <= within * F.col("expected"))


def gain_error(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, measured, wanted) -> largest relative error; nothing wanted counts for nothing."""
    return rows.groupBy(*keys).agg(F.max(F.when(F.col("wanted") != 0, F.abs(F.col("measured") - F.col("wanted")) / F.abs("wanted"))).alias("worst"))


def linearity(rows: DataFrame, step: str) -> DataFrame:
    """rows (beam, step, re, im) -> (beam, step, power): total squared magnitude over that of the middle step."""
    sums = rows.groupBy("beam", step).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))
    middle = sums.groupBy("beam").agg(F.sort_array(F.collect_list(F.struct(step, "power"))).alias("v")).select("beam", F.expr("element_at(v, cast(size(v) div 2 + 1 as int)).power").alias("_middle"))
    return sums.join(middle, "beam").select("beam", step, (F.col("power") / F.col("_middle")).alias("power"))


def correlations(rows: DataFrame, columns: list[str], reference: str) -> DataFrame:
    """One row: the correlation coefficient of every column with the reference."""
    return rows.agg(*(F.corr(c, reference).alias(c) for c in columns))


def complete(rows: DataFrame, keys: list[str], expected: int) -> DataFrame:
    """Keys of accumulations with all heaps and no missing value on the first channel of any."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("re").alias("least")).where((F.col("n") == expected) & (F.col("least") > -(2**31))).select(*keys)


def consecutive(rows: DataFrame, order: str, step: int, length: int) -> DataFrame:
    """(first, n): runs of at least `length` timestamps one step apart."""
    numbered = timeline.running(rows.withColumn("_one", F.lit(1)), [order], {"_n": ("sum", F.col("_one"))}, 4096 * step)
    found = numbered.groupBy((F.col(order) - F.col("_n") * step).alias("_island")).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= length).select("first", "n")


def first_complete(rows: DataFrame, order: str, after: int, n: int) -> DataFrame:
    """The first n rows after a time."""
    return rows.where(F.col(order) > after).orderBy(order).limit(n)


def logistic(rate: np.ndarray, successes: np.ndarray, trials: np.ndarray) -> tuple[float, float]:
    """(intercept, slope) of success on log(rate), by reweighted least squares on sums of trials."""
    x = np.column_stack([np.ones(len(rate)), np.log(rate)])
    centre, scale = x[:, 1].mean(), x[:, 1].std() or 1.0
    z = np.column_stack([x[:, 0], (x[:, 1] - centre) / scale])
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        w = trials * p * (1 - p) + 1e-12
        step = np.linalg.solve((z * w[:, None]).T @ z, z.T @ (successes - trials * p))
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-10:
            break
    return float(beta[0] - beta[1] * centre / scale), float(beta[1] / scale)


@dataclass
class Found:
    low: int
    high: int
    comparisons: int
    confidence: float


def noisy_search(n: int, noise, tolerance: float, before: Callable[[int, int], bool], widest: int = 1, most: int | None = None) -> Found:
    """Where a new element belongs among n sorted ones, by comparisons that may be wrong.

    noise: chance of a wrong answer, or [n, n + 1] chances that comparing with element i says "before" if the place
    is j. The place's distribution is updated by each answer, and the next question is the one after
    which its entropy is expected to be least."""
    says = np.asarray(noise, float)
    if says.ndim == 0:
        says = np.where(np.arange(n + 1)[None, :] <= np.arange(n)[:, None], 1 - says, says)
    place, asked = np.full(n + 1, 1 / (n + 1)), 0

    def entropy(p: np.ndarray) -> np.ndarray:
        return -(p * np.log(np.maximum(p, 1e-300))).sum(axis=1)

    while True:
        below = np.cumsum(place)
        low, high = int(np.searchsorted(below, tolerance / 2)) - 1, int(np.searchsorted(below, 1 - tolerance / 2))
        if high - low <= widest or (most is not None and asked >= most):
            top = below[high] if high < n else 1.0
            return Found(low, high, asked, float(top - (below[low] if low >= 0 else 0.0)))
        yes, no = place * says, place * (1 - says)
        chance = yes.sum(axis=1)
        expected = entropy(yes / chance[:, None]) * chance + entropy(no / (1 - chance)[:, None]) * (1 - chance)
        i = int(expected.argmin())
        asked += 1
        place = (yes[i] / chance[i]) if before(i, asked) else (no[i] / (1 - chance[i]))
