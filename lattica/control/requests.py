"""Control requests as rows of control tables: each has the time it is in force from.

A request changes nothing that is sent before `steady`, and everything from then on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import timeline
from . import parsers

REQUEST = "number long, at long, request string, target string, argument string"


class Control:
    """Requests of one session in order; tables of what they set are made from them."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, str, str, str]] = []

    def _add(self, at: int, request: str, target: str, argument: str) -> None:
        self.rows.append((len(self.rows), at, request, target, argument))

    def gain(self, at: int, target: str, values: list[str], channels: int, default: complex | None = None) -> list[complex]:
        """Set an input's gains; without values, what they are now."""
        if values:
            self._add(at, "gain", target, ";".join(map(str, parsers.gains(values, channels, default))))
        last = [r for r in self.rows if r[2] == "gain" and r[3] in (target, "*")]
        return [complex(x) for x in last[-1][4].split(";")] if last else [default if default is not None else 1.0] * channels

    def gain_all(self, at: int, values: list[str], channels: int, default: complex | None = None) -> None:
        self._add(at, "gain", "*", ";".join(map(str, parsers.gains(values, channels, default))))

    def delays(self, at: int, start: int, texts: dict[str, str]) -> None:
        for target, text in texts.items():
            parsers.delays(text)
            self._add(at, "delays", target, f"{start}:{text}")

    def beam(self, at: int, request: str, beam: str, values: list[float], antennas: int) -> None:
        """beam-weights, beam-delays or beam-quant-gains."""
        if request not in ("beam-weights", "beam-delays", "beam-quant-gains"):
            raise parsers.ParseError(f"unknown request {request}")
        if len(values) != (1 if request == "beam-quant-gains" else antennas):
            raise parsers.ParseError(f"wrong number of values for {request}")
        self._add(at, request, beam, ",".join(map(str, values)))

    def capture(self, at: int, stream: str, on: bool, since: int = 0) -> None:
        """capture-start or capture-stop; a session that runs can't be started, nor one stopped that doesn't."""
        running = self.capturing(stream)
        if on == running:
            raise parsers.ParseError("a capture is already in progress" if on else "no capture in progress")
        self._add(at, "capture-start" if on else "capture-stop", stream, str(since))

    def capturing(self, stream: str) -> bool:
        last = [r for r in self.rows if r[3] == stream and r[2].startswith("capture-")]
        return bool(last) and last[-1][2] == "capture-start"

    def recorder_delay(self, at: int, stream: str, delay: float, sync: float, rate: float) -> float:
        """vlbi-delay: the delay that the recorder takes; not while it captures."""
        if self.capturing(stream):
            raise parsers.ParseError("cannot set vlbi-delay while capturing")
        fraction = (sync % 1.0 + delay % 1.0) % 1.0
        taken = delay + (round(fraction * rate) / rate - fraction)
        self._add(at, "vlbi-delay", stream, repr(taken))
        return taken

    def signals(self, at: int, program: str) -> None:
        from ..signal import dsl

        self._add(at, "signals", "dsim", dsl.render(dsl.parse(program)))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, REQUEST)


def sessions(requests: DataFrame) -> DataFrame:
    """capture-start and -stop requests (number, at, request, target, argument) -> (target, since, until): from the
    start's timestamp or time, if later, to the stop; until is null while it runs. Requests of a stream are
    few: people make them."""
    w = Window.partitionBy("target").orderBy("number")
    rows = requests.where(F.col("request").startswith("capture-")).withColumn("_until", F.lead("at").over(w))
    return rows.where("request = 'capture-start'").select("target", F.greatest("at", F.col("argument").cast("long")).alias("since"), F.col("_until").alias("until"))


def captured(rows: DataFrame, ts: str, spans: DataFrame, key: str) -> DataFrame:
    """rows inside a session of their stream."""
    s = spans.select(F.col("target").alias("_t"), "since", "until")
    return rows.join(s, (F.col(key) == F.col("_t")) & (F.col(ts) >= F.col("since")) & (F.col("until").isNull() | (F.col(ts) < F.col("until")))).select(*rows.columns)


def steady(requests: DataFrame, step: int) -> DataFrame:
    """requests (number, at) -> with steady: the first flush, a multiple of step, after each and all before it."""
    flush = requests.withColumn("_flush", (F.floor(F.col("at") / step) + 1) * step)
    return timeline.running(flush, ["number"], {"steady": ("max", F.col("_flush"))}, 4096).drop("_flush")


def timed_out(readings: DataFrame, timeout: int, status: str, until: int, block: int = 1 << 20) -> DataFrame:
    """readings (name, ts, status, value) with, after each that no other followed within timeout, one of the same value
    and the new status; none where the status is that already or the time is after `until`."""
    back = readings.withColumn("_back", -F.col("ts"))
    later = timeline.running(back, ["_back"], {"_next": ("min", F.col("ts"))}, block, ["name"], strictly=True)
    quiet = later.where((F.col("status") != status) & (F.coalesce("_next", F.lit(until + 1)) - F.col("ts") > timeout) & (F.col("ts") + timeout <= until))
    return readings.unionByName(quiet.select("name", (F.col("ts") + timeout).alias("ts"), F.lit(status).alias("status"), "value"))


def deltas(counters: DataFrame, block: int = 1 << 20) -> DataFrame:
    """counters (stream, at, value), ever growing since before they were registered -> increments: the first reading of a stream is its
    baseline and counts nothing."""
    before = timeline.running(counters, ["at"], {"_before": ("max", F.col("value"))}, block, ["stream"], strictly=True)
    return before.withColumn("delta", F.col("value") - F.coalesce("_before", "value")).drop("_before")
