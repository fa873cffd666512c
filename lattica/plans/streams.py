"""Queries over streams with state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import accumulate, stateful
from .base import query


@query("""with x as (select user_id % 2 as pol, event_id, value as x, row_number() over (partition by user_id % 2 order by event_id) - 1 as k from events),
y as (select pol, k, 0.1::double * x + 0.2::double * lead(x, 1) over w + 0.3::double * lead(x, 2) over w + 0.4::double * lead(x, 3) over w as y from x window w as (partition by pol order by k))
select pol, k, round(y, 6) as y from y where y is not null""")
def stream_fir(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter over streams of samples, the last ones of each batch kept for the next."""
    x = accumulate.events(spark, sf_dir).select((F.col("user_id") % 2).alias("pol"), F.col("event_id").alias("i"), F.col("value").alias("x"))
    found = accumulate.finished(stateful.overlapped_fir(x, [0.1, 0.2, 0.3, 0.4]))
    first = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy((F.col("user_id") % 2).alias("p")).agg(F.min("event_id").alias("first"))
    return found.join(first, F.col("pol") == F.col("p")).select("pol", (F.col("k") - F.col("first")).alias("k"), F.round("y", 6).alias("y"))


@query("""with h as (select cast(date_trunc('hour', ts) as timestamp) as chunk, user_id % 2 as pol, ts from events), m as (select max(ts) as t from events)
select epoch(chunk)::bigint // 3600 as chunk, pol, count(*) as heaps from h, m where chunk + interval 1 hour <= t - interval 2 hour group by 1, 2""")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps of each chunk of a stream, chunks open for two hours after they end."""
    x = accumulate.events(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 2).alias("pol"), F.lit(1).alias("value"))
    closed = accumulate.finished(accumulate.windowed(x, ["pol"], "1 hour", "2 hours"))
    return closed.select(F.floor(F.unix_timestamp("start") / 3600).alias("chunk"), "pol", F.col("n").alias("heaps"))
