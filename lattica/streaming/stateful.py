"""State from one micro-batch to the next: samples that windows overlap by, sensors that hear nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def overlapped_fir(stream: DataFrame, weights: list[float]) -> DataFrame:
    """stream (pol, i, x), i without gaps for each pol and in order from batch to batch -> (pol, k, y): y[k] = sum of
    weights[t] * x[k + t]. The last samples of a batch, one fewer than weights, are kept for the next."""
    taps = len(weights)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        at = pd.concat(list(batches), ignore_index=True).sort_values("i")
        first, tail = state.get if state.exists else (int(at["i"].iloc[0]), [])
        x = np.concatenate([np.asarray(tail, float), at["x"].to_numpy(float)])
        n = len(x) - taps + 1
        keep = x[max(0, n) :].tolist()
        state.update((first + max(0, n), keep))
        if n > 0:
            y = sum(w * x[t : t + n] for t, w in enumerate(weights))
            yield pd.DataFrame({"pol": key[0], "k": first + np.arange(n), "y": y})

    return stream.groupBy("pol").applyInPandasWithState(run, "pol long, k long, y double", "first long, tail array<double>", "append", GroupStateTimeout.NoTimeout)


def status_timeouts(stream: DataFrame, timeout_ms: int, status: str) -> DataFrame:
    """stream (name, ts timestamp with a watermark, status, value) -> readings with, after a silence of timeout_ms,
    one of the same value and the new status."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name = key[0]

        def quiet(last: tuple) -> tuple:
            return name, last[0] + timeout_ms, status, last[2]

        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield _readings([quiet(last)])
            return
        out, last = [], state.get if state.exists else None
        rows = pd.concat(list(batches), ignore_index=True).sort_values("ts")
        for ts, own, value in zip(rows["ts"].astype("datetime64[ms]").astype("int64"), rows["status"], rows["value"], strict=True):
            if last is not None and last[1] != status and ts - last[0] > timeout_ms:
                out.append(quiet(last))
            last = (int(ts), own, float(value))
            out.append((name, *last))
        state.update(last)
        if last[1] != status and last[0] + timeout_ms > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(last[0] + timeout_ms)
        yield _readings(out)

    return stream.groupBy("name").applyInPandasWithState(run, "name string, ts long, status string, value double", "ts long, status string, value double", "append", GroupStateTimeout.EventTimeTimeout)


def _readings(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["name", "ts", "status", "value"])
