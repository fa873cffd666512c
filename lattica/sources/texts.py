"""Text and generated sources: calibration files, test reports, counters, labels, simulated payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X

CALIBRATION = r"^([0-9.]+(?:[eE][+-]?[0-9]+)?) ([0-9]+) ([0-9]+) ([0-9]+)$"


def calibration_lines(lines: DataFrame) -> DataFrame:
    """lines (number, line) "rate successes trials throttled" -> (number, rate, successes, trials,
    throttled); lines of another form are skipped."""
    part = lambda k, kind: F.regexp_extract("line", CALIBRATION, k).cast(kind)
    return lines.where(F.col("line").rlike(CALIBRATION)).select("number", part(1, "double").alias("rate"), part(2, "long").alias("successes"), part(3, "long").alias("trials"), part(4, "long").alias("throttled"))


def calibration_sums(runs: DataFrame) -> DataFrame:
    """Runs summed by rate; first_seen orders the rates."""
    return runs.groupBy("rate").agg(*(F.sum(c).alias(c) for c in ("successes", "trials", "throttled")), F.min("number").alias("first_seen"))


def report_items(lines: DataFrame, kinds: list[str]) -> DataFrame:
    """lines (number, line): JSON objects (test, kind, value) -> typed rows of the kinds listed; text
    that isn't JSON gives no row."""
    found = lines.select("number", F.from_json("line", "test long, kind string, value double").alias("x"))
    return found.where(F.col("x").isNotNull() & F.col("x.kind").isin(kinds)).select("number", "x.*")


def counter_pivot(rows: DataFrame, events: list[str]) -> DataFrame:
    """rows (run, event, event_id, value) -> (run, a column for each event): the first value of each."""
    first = lambda e: F.min_by(F.when(F.col("event") == e, F.col("value")), F.when(F.col("event") == e, F.col("event_id"))).alias(e)
    return rows.groupBy("run").agg(*map(first, events))


def scraped_counters(lines: DataFrame) -> DataFrame:
    """lines (line) of counters name_total{labels} value -> (counter, total) over all labels."""
    form = r"^([A-Za-z_:][A-Za-z0-9_:]*)_total(?:\{.*\})? ([-+0-9.eE]+)$"
    return lines.where(F.col("line").rlike(form)).groupBy(F.regexp_extract("line", form, 1).alias("counter")).agg(F.sum(F.regexp_extract("line", form, 2).cast("double")).alias("total"))


def baseline_labels(spark: SparkSession, antennas: int, pols: list[str]) -> DataFrame:
    """(prod, one, two): product index and the names of its two inputs; antennas ** 2 rows at most."""
    a2 = spark.range(antennas).select(F.col("id").alias("a2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id"))).alias("a1"))
    every = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p).alias("p")) for i, p in enumerate(pols)))
    rows = a2.select("a1", "a2", F.explode(every).alias("p1")).select("*", F.explode(every).alias("p2"))
    name = lambda a, p: F.concat(F.lit("m"), F.lpad(F.col(a).cast("string"), 3, "0"), F.col(p))
    return rows.select(X.product(X.baseline(F.col("a1"), F.col("a2")), F.col("p1.i"), F.col("p2.i")).cast("long").alias("prod"), name("a1", "p1.p").alias("one"), name("a2", "p2.p").alias("two"))


def simulated_payload(spark: SparkSession, engines: int, heaps: int, channels: int, spectra: int, angle: float) -> DataFrame:
    """Deterministic channelised voltages: amplitude (heap * spectra + 10 * chan + t) mod 127 at an angle by
    engine and polarisation."""
    i = F.col("id")
    rows = spark.range(engines * 2 * heaps * channels * spectra).select(
        F.expr(f"id div {2 * heaps * channels * spectra}").alias("feng"),
        F.expr(f"id div {heaps * channels * spectra} % 2").alias("pol"),
        F.expr(f"id div {channels * spectra} % {heaps}").alias("heap"),
        F.expr(f"id div {spectra} % {channels}").alias("chan"),
        (i % spectra).alias("t"),
    )
    amplitude = (F.col("heap") * spectra + 10 * F.col("chan") + F.col("t")) % 127
    turn = (F.col("feng") * 2 + F.col("pol")) * angle
    part = lambda f: F.rint(F.round(F.col("amplitude") * f(turn), 9)).cast("int")
    return rows.withColumn("amplitude", amplitude).withColumn("re", part(F.cos)).withColumn("im", part(F.sin))
