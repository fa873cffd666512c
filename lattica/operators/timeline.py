"""Time-ordered operators: delay models, presence, accumulation, gaps, ingest rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X


_OVER = {"max": F.max, "min": F.min, "sum": F.sum}


def running(rows: DataFrame, order: list[str], columns: dict[str, tuple[str, Column]], block: int, part: list[str] | None = None, strictly: bool = False) -> DataFrame:
    """rows with, for each name: (how, column), its running max, min, sum or last non-null
    value in `order` within `part`; strictly: of the rows before only. order[0] is a whole number.

    Prefixes are taken at three levels, within blocks of `block` order values, within `block` blocks, and over
    what is left, so no task holds a whole time line unless it is shorter than block ** 2 values.
    """
    part = part or []
    value = lambda how, c: F.when(c.isNotNull(), F.struct(F.lit(0).alias("o"), c.alias("v"))) if how == "last" else c
    tagged = rows.select("*", F.floor(F.col(order[0]) / block).alias("_b"), *(value(how, c).alias(f"_v_{k}") for k, (how, c) in columns.items())).withColumn("_s", F.floor(F.col("_b") / block))

    def of_group(how: str, k: str, by: list[str]) -> Column:
        return F.max_by(F.col(f"_v_{k}"), F.when(F.col(f"_v_{k}").isNotNull(), F.struct(*by))) if how == "last" else _OVER[how](F.col(f"_v_{k}"))

    def of_window(how: str, k: str, w) -> Column:
        return F.last(F.col(f"_v_{k}"), ignorenulls=True).over(w) if how == "last" else _OVER[how](F.col(f"_v_{k}")).over(w)

    def joined(how: str, *parts: Column) -> Column:  # from the nearest to the farthest
        if how == "sum":
            return sum((F.coalesce(p, F.lit(0)) for p in parts[1:]), F.coalesce(parts[0], F.lit(0)))
        return F.coalesce(*parts) if how == "last" else (F.greatest if how == "max" else F.least)(*parts)

    def level(frame: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
        return frame.groupBy(*part, *keys).agg(*(of_group(how, k, by).alias(f"_v_{k}") for k, (how, _) in columns.items()))

    blocks, supers = level(tagged, ["_s", "_b"], order), None
    supers = level(blocks, ["_s"], ["_b"])
    before = Window.unboundedPreceding, -1
    in_super, over_all = Window.partitionBy(*part, "_s").orderBy("_b").rowsBetween(*before), Window.partitionBy(*part).orderBy("_s").rowsBetween(*before)
    far = supers.select(*part, "_s", *(of_window(how, k, over_all).alias(f"_far_{k}") for k, (how, _) in columns.items()))
    near = blocks.select(*part, "_s", "_b", *(of_window(how, k, in_super).alias(f"_near_{k}") for k, (how, _) in columns.items()))
    carried = near.join(far, [*part, "_s"]).drop("_s")
    inside = Window.partitionBy(*part, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strictly else Window.currentRow)
    out = tagged.drop("_s").join(carried, [*part, "_b"])
    result = {k: joined(how, of_window(how, k, inside), F.col(f"_near_{k}"), F.col(f"_far_{k}")) for k, (how, _) in columns.items()}
    return out.select(*rows.columns, *((r["v"] if columns[k][0] == "last" else r).alias(k) for k, r in result.items()))


def as_of(points: DataFrame, models: DataFrame, fields: list[str], bucket: int) -> DataFrame:
    """points (t, ...) with the latest model (start, fields) of start <= t, null before the first.

    A union sorted by time instead of a range join, and a running last value over it.
    """
    tagged = points.withColumn("_at", F.col("t")).withColumn("_kind", F.lit(1)).unionByName(models.select(F.col("start").alias("_at"), F.lit(0).alias("_kind"), F.struct("start", *fields).alias("_m")), allowMissingColumns=True)
    found = running(tagged, ["_at", "_kind"], {"_found": ("last", F.col("_m"))}, bucket)
    return found.where("_kind = 1").select(*points.columns, *(F.col(f"_found.{f}").alias(f"m_{f}") for f in ["start", *fields]))


def replay(models: DataFrame, block: int = 4096) -> DataFrame:
    """models (arrival, start, ...): a model deletes those that arrived before it and start
    no earlier; what is left is what a look-up can find."""
    back = models.withColumn("_back", -F.col("arrival"))
    return running(back, ["_back"], {"_least": ("min", F.col("start"))}, block, strictly=True).where("_least is null or start < _least").drop("_least", "_back")


def coarse_fine(delay: Column) -> tuple[Column, Column]:
    coarse = F.rint(delay)
    return coarse.cast("long"), delay - coarse


def runs(rows: DataFrame, value: str, part: list[str], order: str, block: int = 4096) -> DataFrame:
    """Gaps and islands: (part, run, value, first, last, n)."""
    before = running(rows, [order], {"_before": ("last", F.struct(F.col(value).alias("x")))}, block, part, strictly=True)
    changed = F.when(F.col("_before").isNull() | ~F.col("_before.x").eqNullSafe(F.col(value)), 1).otherwise(0)
    numbered = running(before.withColumn("_c", changed), [order], {"run": ("sum", F.col("_c"))}, block, part)
    return numbered.groupBy(*part, "run").agg(F.first(value).alias(value), F.min(order).alias("first"), F.max(order).alias("last"), F.count(F.lit(1)).alias("n"))


def accumulate(ticks: DataFrame, width: int) -> DataFrame:
    """ticks (t, value null if missing) -> (window, total): null unless all `width` ticks gave a value."""
    return ticks.groupBy(F.floor(F.col("t") / width).alias("window")).agg(F.when((F.count("value") == width) & (F.count(F.lit(1)) == width), F.sum("value")).alias("total"))


def accumulate_intervals(intervals: DataFrame, width: int) -> DataFrame:
    """intervals (start, stop, value null if missing) -> (window, total) of each window with any data: null
    unless its ticks are all covered and every interval gave a value. Intervals are right by
    interval_errors(): then lengths that add up to the window cover it."""
    size = F.sum(F.col("stop") - F.col("start"))
    return intervals.groupBy(F.floor(F.col("start") / width).alias("window")).agg(F.when((size == width) & (F.count("value") == F.count(F.lit(1))), F.sum("value")).alias("total"))


def interval_errors(intervals: DataFrame, width: int, block: int = 4096) -> DataFrame:
    """intervals (number, start, stop) in order of arrival -> those that an accumulator refuses, and why."""
    before = running(intervals, ["number"], {"_end": ("max", F.col("stop"))}, block, strictly=True)
    why = F.when(F.col("start") > F.col("stop"), "reversed").when(F.col("stop") > (F.floor(F.col("start") / width) + 1) * width, "crosses a window").when(F.col("start") < F.coalesce("_end", F.lit(0)), "overlaps")
    return before.withColumn("error", why).where(F.col("error").isNotNull()).drop("_end")


def expected_grid(spark, first: int, last: int, step: int) -> DataFrame:
    return spark.range(first, last + 1, step).withColumnRenamed("id", "t")


def presence(grid: DataFrame, received: DataFrame, keys: list[str]) -> DataFrame:
    """The grid with present: a left join against the distinct keys received."""
    got = received.select(*keys).distinct().withColumn("_got", F.lit(True))
    return grid.join(got, keys, "left").withColumn("present", F.col("_got").isNotNull()).drop("_got")


def good_counts(rows: DataFrame, order: str, ahead: int, block: int = 4096, part: list[str] | None = None) -> DataFrame:
    """How many of this and the next `ahead` rows are present. Rows are dealt by blocks of `order`,
    and each block gets the first `ahead` rows of the next one as well, so counts cross the seams."""
    part = part or []
    own = F.floor(F.col(order) / block)
    homes = F.when(F.pmod(F.col(order), F.lit(block)) < ahead, F.array(own, own - 1)).otherwise(F.array(own))
    w = Window.partitionBy(*part, "_block").orderBy(order).rowsBetween(0, ahead)
    counted = rows.withColumn("_block", F.explode(homes)).withColumn("good", F.sum(F.col("present").cast("int")).over(w))
    return counted.where(F.col("_block") == own).drop("_block")


def reject_reason(heap_bytes: int, step: int, antennas: int) -> Column:
    """Why a heap of channelised data is dropped; the first rule that fits wins; null: it is taken."""
    return F.when((F.col("heap_len") != heap_bytes) | (F.col("ts") < 0) | (F.col("feng_id") < 0), "metadata").when(F.pmod("ts", F.lit(step)) != 0, "bad_timestamp").when(F.col("feng_id") >= antennas, "bad_feng_id")


def gaps(rows: DataFrame, order: str, width: int, block: int = 4096) -> DataFrame:
    """Batches skipped before each row: (order, skipped)."""
    back = running(rows, [order], {"_back": ("max", F.col(order))}, block, strictly=True)
    return back.withColumn("skipped", F.coalesce(F.expr(f"({order} - _back) div {width} - 1"), F.lit(0))).drop("_back")


def normalise_power(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, x): x over the root of its group's mean power; the group's power beside it."""
    power = rows.groupBy(*keys).agg(F.avg(F.col("x") * F.col("x")).alias("power"))
    return rows.join(power, keys).withColumn("y", F.when(F.col("power") > 0, F.col("x") / F.sqrt("power")).otherwise(0.0))


def peaks(spectra: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, peak_chan, sfdr_db): the strongest channel (ties: lowest) over the next."""
    w = Window.partitionBy(*keys).orderBy(F.desc("power"), "chan")
    two = spectra.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return two.groupBy(*keys).agg(F.max(F.when(F.col("r") == 1, F.col("chan"))).alias("peak_chan"), (10 * F.log10(F.max(F.when(F.col("r") == 1, F.col("power"))) / F.max(F.when(F.col("r") == 2, F.col("power"))))).alias("sfdr_db"))


def power_table(samples: DataFrame, width: int, bits: int) -> DataFrame:
    sums = samples.groupBy(F.floor(F.col("i") / width).alias("w")).agg(F.sum(F.col("x").cast("long") * F.col("x").cast("long")).alias("total"), F.count("x").alias("n"), F.count_if(X.at_limit(F.col("x"), bits)).alias("saturated"))
    db = X.dbfs(F.col("total"), F.col("n"), bits)
    return sums.withColumn("db", db).withColumn("status", X.dbfs_status(db))
