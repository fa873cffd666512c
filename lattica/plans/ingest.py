"""Queries of the receive side: scans, reject rules, assembly, accounting, texts of counters and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import timeline
from ..sources import heaps as H
from ..sources import texts
from .base import query, table

DIG = H.Layout(heap_bytes=128, step=64, chunk_batches=16, heap_samples=64, mask=True)
FENG = H.Layout(heap_bytes=128, step=32, chunk_batches=8, batch_heaps=8, heap_samples=16)
BEAM = H.Layout(heap_bytes=128, step=16, chunk_batches=8, batch_heaps=4, heap_samples=16)


def digitiser_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.expr("(event_id div 4) * 64") + F.when(F.col("value") > 80, 3).otherwise(0) - F.when(F.col("user_id") % 50 == 0, 64 * 40).otherwise(0)
    return e.select(F.col("event_id").alias("arrival"), ts.alias("ts"), F.when(F.col("event_type") == "signup", 100).otherwise(128).alias("heap_len"), (F.col("event_id") % 2).alias("digitiser_id"), X.status_word(F.col("user_id") % 5).alias("status"))


DIG_SQL = """h as (select event_id as arrival, (event_id // 4) * 64 + (case when value > 80 then 3 else 0 end) - (case when user_id % 50 = 0 then 2560 else 0 end) as raw,
  case when event_type = 'signup' then 100 else 128 end as heap_len, event_id % 2 as pol, user_id % 5 as saturated from events),
m as (select *, raw - ((raw % 64) + 64) % 64 as ts from h),
r as (select *, case when heap_len <> 128 or ts < 0 then 'metadata' when ts % 64 <> 0 then 'bad_timestamp' end as reason, ts // 1024 as chunk from m),
o as (select *, max(case when reason is null then chunk end) over (order by arrival) as newest from r),
p as (select * exclude (reason), case when reason is null and chunk <= newest - 2 then 'too_old' else reason end as reason from o)"""


def _digitised(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = H.placed(digitiser_heaps(spark, sf_dir), DIG, active=2, block=1024)
    return placed.withColumn("pol", X.status_pol(F.col("digitiser_id"))).withColumn("saturated", X.status_saturation(F.col("status")))


@query(f"with {DIG_SQL} select chunk, pol, (ts // 64) % 16 as batch, count(*) as copies, cast(max(saturated) as bigint) as saturated from p where reason is null group by 1, 2, 3")
def digitiser_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps of a digitiser by chunk, polarisation and batch, late ones dropped."""
    taken = _digitised(spark, sf_dir).where("reason is null")
    return taken.groupBy("chunk", "pol", "batch").agg(F.count(F.lit(1)).alias("copies"), F.max("saturated").alias("saturated"))


@query(f"with {DIG_SQL} select arrival, chunk, ts, row_number() over (partition by chunk order by ts, arrival) - 1 as place from p where reason is null")
def time_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps of open chunks put in order of time."""
    return H.reordered(_digitised(spark, sf_dir)).select("arrival", "chunk", "ts", F.col("place").cast("long").alias("place"))


@query(f"with {DIG_SQL} select coalesce(reason, 'taken') as reason, pol, count(*) as heaps, cast(sum(heap_len) as bigint) as bytes from p group by 1, 2")
def receive_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps taken and dropped, by reason."""
    return _digitised(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason"), "pol").agg(F.count(F.lit(1)).alias("heaps"), F.sum("heap_len").alias("bytes"))


ACCOUNT_SQL = f"""with {DIG_SQL}, u as (select pol, chunk, ts, max(saturated) as s from p where reason is null group by 1, 2, 3), c as (select pol, chunk, count(*) as heaps, cast(sum(s) as bigint) as clipped from u group by 1, 2),
b as (select *, (chunk - (select min(chunk) from c) + 1) * 16 - sum(heaps) over (partition by pol order by chunk) as behind from c),
k as (select *, greatest(coalesce(max(behind) over (partition by pol order by chunk rows between unbounded preceding and 1 preceding), 0), 0) as mark from b)
select pol, chunk, heaps, heaps * 64 as samples, heaps * 128 as bytes, clipped, cast(greatest(behind - mark, 0) as bigint) as missing from k"""


@query(ACCOUNT_SQL)
def receive_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps, samples, bytes, clipped and newly missing heaps of each chunk."""
    return H.accounting(_digitised(spark, sf_dir), DIG, ["pol"])


@query(f"""with a as ({ACCOUNT_SQL}) select pol, cast(max(chunk) * 1024 as bigint) as rx_timestamp, round(1000.0 + max(chunk) * 1024 / 1712.0, 6) as rx_unixtime, round(1000.0 + max(case when missing > 0 then chunk end) * 1024 / 1712.0, 6) as missing_unixtime,
 case when max(case when missing > 0 then chunk end) is null then 'nominal' else 'error' end as status from a group by pol""")
def receive_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest values of a receiver's sensors: last chunk, and the last at which heaps went missing."""
    rows = H.accounting(_digitised(spark, sf_dir), DIG, ["pol"])
    last = F.max(F.when(F.col("missing") > 0, F.col("chunk")))
    unix = lambda c: F.round(X.adc_to_unix(c * DIG.chunk_step, 1000.0, 1712.0), 6)
    return rows.groupBy("pol").agg((F.max("chunk") * DIG.chunk_step).alias("rx_timestamp"), unix(F.max("chunk")).alias("rx_unixtime"), unix(last).alias("missing_unixtime"), F.when(last.isNull(), "nominal").otherwise("error").alias("status"))


def channelised_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ts = F.expr("(event_id div 8) * 32") + F.when(F.col("value") > 150, 5).otherwise(0) - F.when(F.col("user_id") % 90 == 0, 32 * 30).otherwise(0)
    return e.select(F.col("event_id").alias("arrival"), ts.alias("ts"), F.when(F.col("event_type") == "error", 100).otherwise(128).alias("heap_len"), F.when(F.col("user_id") % 40 == 1, F.lit(9)).otherwise(F.col("event_id") % 8).alias("feng_id"))


# tolerance 600 ticks of chunks of 256: 3 whole chunks and one more are open
CHAN_SQL = """h as (select event_id as arrival, (event_id // 8) * 32 + (case when value > 150 then 5 else 0 end) - (case when user_id % 90 = 0 then 960 else 0 end) as ts,
  case when event_type = 'error' then 100 else 128 end as heap_len, case when user_id % 40 = 1 then 9 else event_id % 8 end as feng_id from events),
r as (select *, case when heap_len <> 128 or ts < 0 or feng_id < 0 then 'metadata' when ts % 32 <> 0 then 'bad_timestamp' when feng_id >= 8 then 'bad_feng_id' end as reason, cast(floor(ts / 256) as bigint) as chunk from h),
o as (select *, max(case when reason is null then chunk end) over (order by arrival) as newest from r),
p as (select * exclude (reason), case when reason is null and chunk <= newest - 4 then 'too_old' else reason end as reason from o)"""


def _channelised(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = H.placed(channelised_heaps(spark, sf_dir), FENG, FENG.active_chunks(600), block=1024, antennas=8)
    return placed.withColumn("index", F.col("batch") * 8 + F.col("feng_id"))


@query(f"with {CHAN_SQL} select coalesce(reason, 'taken') as reason, count(*) as heaps from p group by 1")
def channelised_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps of channelised data by what becomes of them, in a window of late chunks."""
    return _channelised(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("taken")).alias("reason")).agg(F.count(F.lit(1)).alias("heaps"))


ASSEMBLY_SQL = f"""{CHAN_SQL}, g as (select distinct chunk, (ts - chunk * 256) // 32 * 8 + feng_id as idx from p where reason is null),
x as (select c.chunk, cast(i as bigint) as idx, g.idx is not null as present from (select distinct chunk from g) c, range(64) t(i) left join g on g.chunk = c.chunk and g.idx = t.i)"""


@query(f"with {ASSEMBLY_SQL} select chunk, idx // 8 as batch, cast(sum(cast(present as int)) as bigint) as antennas, bool_and(present) as whole from x group by 1, 2")
def heap_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every heap a chunk should have, with what is there: antennas present in each batch."""
    grid = H.assembled(_channelised(spark, sf_dir), [], FENG.chunk_batches * FENG.batch_heaps)
    return grid.groupBy("chunk", F.expr("index div 8").alias("batch")).agg(F.sum(F.col("present").cast("long")).alias("antennas"), F.bool_and("present").alias("whole"))


@query(f"""with {ASSEMBLY_SQL}, c as (select generate_series as chunk from generate_series(0, (select max(chunk) from x)))
select c.chunk, coalesce(cast(sum(cast(present as int)) as bigint), 0) as heaps from c left join x on c.chunk = x.chunk group by 1 having coalesce(sum(cast(present as int)), 0) > 0""")
def dummy_chunks_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks of the time line, less those of which nothing is there."""
    grid = H.assembled(_channelised(spark, sf_dir), [], 64)
    last = grid.agg(F.max("chunk").alias("m")).first()["m"] or 0
    line = timeline.expected_grid(spark, 0, last, 1).withColumnRenamed("t", "chunk")
    counted = line.join(grid, "chunk", "left").groupBy("chunk").agg(F.coalesce(F.sum(F.col("present").cast("long")), F.lit(0)).alias("heaps"))
    return counted.where("heaps > 0")


@query("""with h as (select event_id % 2 as pol, (event_id // 8) * 16 as ts, (user_id % 40) * 4 + (case when value > 100 then 1 else 0 end) as frequency, user_id % 7 as beam_ants from events where event_type in ('view', 'click')),
p as (select *, case when frequency >= 128 or frequency % 4 <> 0 then 'bad_frequency' else 'taken' end as reason from h)
select pol, reason, ts // 128 as chunk, count(*) as heaps, min(beam_ants) as fewest_ants from p group by 1, 2, 3""")
def beam_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two single-polarisation beam streams read as one group, antennas kept for each heap."""
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    h = e.select(F.col("event_id").alias("arrival"), F.expr("(event_id div 8) * 16").alias("ts"), F.lit(128).alias("heap_len"), ((F.col("user_id") % 40) * 4 + F.when(F.col("value") > 100, 1).otherwise(0)).alias("frequency"), (F.col("user_id") % 7).alias("beam_ants"))
    both = H.merged_streams(h.where("arrival % 2 = 0"), h.where("arrival % 2 = 1")).withColumn("pol", F.col("pol").cast("long"))
    found = H.rejected(both, BEAM, channels=128, channels_per_heap=4)
    return found.groupBy("pol", F.coalesce("reason", F.lit("taken")).alias("reason"), F.floor(F.col("ts") / BEAM.chunk_step).alias("chunk")).agg(F.count(F.lit(1)).alias("heaps"), F.min("beam_ants").alias("fewest_ants"))


@query("""with h as (select event_id // 4 as acc, (event_id % 4) * 8 as chan0, case when user_id % 30 = 0 then 7 else 8 end as n, cast(round_even(value, 0) as bigint) as base from events where event_type <> 'signup')
select acc, chan0 + c as chan, base + c as re from h, range(8) t(c) where n = 8""")
def product_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibility heaps hold a block of channels from an offset; heaps of the wrong length are dropped."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    n = F.when(F.col("user_id") % 30 == 0, 7).otherwise(8)
    h = e.select(F.expr("event_id div 4").alias("acc"), ((F.col("event_id") % 4) * 8).alias("chan0"), F.transform(F.sequence(F.lit(0), n - 1), lambda c: F.rint("value").cast("long") + c).alias("re"))
    return h.where(F.size("re") == 8).select("acc", "chan0", F.posexplode("re").alias("c", "re")).select("acc", (F.col("chan0") + F.col("c")).alias("chan"), "re")


LABEL = "concat('m', lpad(cast(%s as string), 3, '0'), %s)"


@query("""with l as (select a2 * (a2 + 1) // 2 + a1 as bl, printf('m%03d', a1) || p1 as one, printf('m%03d', a2) || p2 as two, 4 * (a2 * (a2 + 1) // 2 + a1) + (p1 = 'v')::int + 2 * (p2 = 'v')::int as prod
  from range(4) x(a1), range(4) y(a2), (values ('h'), ('v')) u(p1), (values ('h'), ('v')) w(p2) where a1 <= a2),
v as (select event_id as t, user_id % 40 as prod, value from events)
select l.one, l.two, cast(l.prod as bigint) as prod, count(*) as n, round(sum(value), 4) as total from v join l on v.prod = l.prod where l.one = 'm001h' or l.two = 'm003v' group by 1, 2, 3""")
def baseline_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities of baselines chosen by the names of their inputs."""
    names = texts.baseline_labels(spark, 4, ["h", "v"])
    v = table(spark, sf_dir, "events").select((F.col("user_id") % 40).alias("prod"), "value")
    chosen = names.where("one = 'm001h' or two = 'm003v'")
    return v.join(chosen, "prod").groupBy("one", "two", "prod").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""with h as (select cast(f as bigint) as feng, cast(p as bigint) as pol, cast(k as bigint) as heap, cast(c as bigint) as chan, cast(t as bigint) as t from range(3) a(f), range(2) b(p), range(4) d(k), range(8) e(c), range(5) g(t))
select *, (heap * 5 + 10 * chan + t) % 127 as amplitude, cast(round_even(round(((heap * 5 + 10 * chan + t) % 127) * cos((feng * 2 + pol) * 0.7), 9), 0) as int) as re, cast(round_even(round(((heap * 5 + 10 * chan + t) % 127) * sin((feng * 2 + pol) * 0.7), 9), 0) as int) as im from h""")
def simulated_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payload of the channeliser simulator: amplitude by place, angle by engine and polarisation."""
    return texts.simulated_payload(spark, engines=3, heaps=4, channels=8, spectra=5, angle=0.7)


@query("""with lines as (select event_id, case when user_id % 25 = 0 then 'bad line' when user_id % 25 = 1 then '# ' || cast(user_id as varchar) else cast(user_id % 20 + 100 as varchar) || '.5 ' || cast(user_id % 7 as varchar) || ' ' || cast(user_id % 7 + 3 as varchar) || ' ' || cast(user_id % 2 as varchar) end as line from events),
k as (select event_id, string_split(line, ' ') as w from lines where regexp_full_match(line, '[0-9.]+ [0-9]+ [0-9]+ [0-9]+'))
select cast(w[1] as double) as rate, cast(sum(cast(w[2] as bigint)) as bigint) as successes, cast(sum(cast(w[3] as bigint)) as bigint) as trials, cast(sum(cast(w[4] as bigint)) as bigint) as throttled, min(event_id) as first_seen from k group by 1""")
def calibration_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration lines summed by rate, in the order rates are first seen; malformed lines are skipped."""
    rest = F.col("user_id") % 25
    num = lambda c: c.cast("string")
    line = F.when(rest == 0, "bad line").when(rest == 1, F.concat(F.lit("# "), num(F.col("user_id")))).otherwise(F.concat(num(F.col("user_id") % 20 + 100), F.lit(".5 "), num(F.col("user_id") % 7), F.lit(" "), num(F.col("user_id") % 7 + 3), F.lit(" "), num(F.col("user_id") % 2)))
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), line.alias("line"))
    return texts.calibration_sums(texts.calibration_lines(lines))


@query("""with i as (select event_id % 50 as test, event_id, event_type as kind, value from events)
select test, kind, count(*) as items, round(max(value), 6) as most, max_by(event_id, event_id) as last_line from i where kind in ('view', 'error', 'click') group by 1, 2""")
def report_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a JSON test report as typed items, collated by test and kind; unknown kinds are left out."""
    lines = table(spark, sf_dir, "events").select(F.col("event_id").alias("number"), F.to_json(F.struct((F.col("event_id") % 50).alias("test"), F.col("event_type").alias("kind"), F.col("value"))).alias("line"))
    items = texts.report_items(lines, ["view", "error", "click"])
    return items.groupBy("test", "kind").agg(F.count(F.lit(1)).alias("items"), F.round(F.max("value"), 6).alias("most"), F.max("number").alias("last_line"))


@query("""select event_id // 100 as run, round(max(case when event_type = 'click' then value end), 6) as click, round(max(case when event_type = 'view' then value end), 6) as "view" from (select *, row_number() over (partition by event_id // 100, event_type order by event_id) as r from events) where r = 1 group by 1""")
def counter_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Performance counters of runs, one row a counter, as a column each (first value counts)."""
    rows = table(spark, sf_dir, "events").select(F.expr("event_id div 100").alias("run"), F.col("event_type").alias("event"), "event_id", "value")
    return texts.counter_pivot(rows, ["click", "view"]).select("run", F.round("click", 6).alias("click"), F.round("view", 6).alias("view"))


@query("""select 'heaps_' || event_type as counter, cast(sum(user_id) as double) as total from events group by 1""")
def scraped_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposition text of counters, summed over their labels; comments and other text are passed over."""
    e = table(spark, sf_dir, "events")
    line = F.concat(F.lit("heaps_"), F.col("event_type"), F.lit('_total{stream="a",pol="'), (F.col("event_id") % 2).cast("string"), F.lit('"} '), F.col("user_id").cast("string"), F.lit(".0"))
    lines = e.select(F.explode(F.array(F.lit("# HELP heaps number of heaps"), line)).alias("line"))
    return texts.scraped_counters(lines)


@query("""select event_id as ts, event_id % 2 as digitiser_id, user_id as status, 8 + user_id % 3 as heap_len, upper(lpad(to_hex(event_id), 4, '0')) as begins from events where event_id < 1000""")
def heap_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps written to files and read from them."""
    import uuid

    from ..sources import datasource
    from ..storage import shared_dir

    datasource.register(spark)
    folder = f"{shared_dir(spark)}/heaps-{uuid.uuid4().hex}"
    zero = F.lit(0).cast("long")
    payload = F.concat(F.unhex(F.lpad(F.hex("event_id"), 4, "0")), F.unhex(F.repeat(F.lit("AB"), (F.col("user_id") % 3 + 6).cast("int"))))
    e = table(spark, sf_dir, "events").where("event_id < 1000")
    e.select(F.lit(8).cast("long").alias("heap_len"), F.col("event_id").alias("ts"), (F.col("event_id") % 2).alias("digitiser_id"), F.col("user_id").alias("status"), zero.alias("feng_id"), zero.alias("frequency"), zero.alias("beam_ants"), payload.alias("payload")).write.format("heaps").mode("append").save(folder)
    back = spark.read.format("heaps").load(folder)
    return back.select("ts", "digitiser_id", "status", "heap_len", F.upper(F.hex(F.substring("payload", 1, 2))).alias("begins"))
