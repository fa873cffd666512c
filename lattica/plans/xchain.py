"""Queries of correlator, beamformer and what they send."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import correlate, postprocess
from ..sinks import tables as sinks
from .base import query, table
from .fchain import dither_sql

ANTS, TICKS = 4, 16


def _both_pols(spark: SparkSession, sf_dir: str, gain: float, bits: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.expr("filter(embedding, (x, i) -> i % 2 = 0)").alias("re"), F.expr("filter(embedding, (x, i) -> i % 2 = 1)").alias("im"))).alias("chan", "z")).where("chan < 8")
    part = lambda c: X.quantise(F.round(F.col(f"z.{c}").cast("double") * gain, 9), bits)
    return e.select(F.expr("vec_id div 8").alias("ts"), F.expr("cast(vec_id div 2 % 4 as int)").alias("ant"), F.expr("cast(vec_id % 2 as int)").alias("pol"), "chan", part("re").alias("re"), part("im").alias("im"))


def pols_sql(gain: int, most: int) -> str:
    return f"""v as (select vec_id // 8 as ts, cast(vec_id // 2 % 4 as int) as ant, cast(vec_id % 2 as int) as pol, cast(c as int) as chan,
  cast(round_even(greatest(least(round(cast(embedding[2*c+1] as double)*{gain}, 9), {most}.0), -{most}.0), 0) as bigint) as re,
  cast(round_even(greatest(least(round(cast(embedding[2*c+2] as double)*{gain}, 9), {most}.0), -{most}.0), 0) as bigint) as im
  from embeddings, range(8) r(c))"""


def vis_sql(gain: int, most: int) -> str:
    return f"""{pols_sql(gain, most)},
s as (select a.ts // {TICKS} as acc, a.chan, cast(4 * (b.ant*(b.ant+1)//2 + a.ant) + a.pol + 2 * b.pol as int) as prod, cast(sum(a.re*b.re + a.im*b.im) as bigint) as re, cast(sum(a.im*b.re - a.re*b.im) as bigint) as im
  from v a join v b on a.ts = b.ts and a.chan = b.chan and a.ant <= b.ant group by 1, 2, 3),
o as (select acc, chan, prod, cast(least(greatest(re, -2147483647), 2147483647) as int) as re, cast(least(greatest(im, -2147483647), 2147483647) as int) as im, (abs(re) > 2147483647 or abs(im) > 2147483647) as clipped from s)"""


@query(f"with {vis_sql(200, 127)} select * from o")
def cross_polarisations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four polarisation products of each baseline."""
    return correlate.visibilities(_both_pols(spark, sf_dir, 200, 8), TICKS)


@query(f"with {vis_sql(60000, 32767)} select acc, count(*) filter (clipped) as clipped, max(re) as most, min(im) as least from o group by 1")
def saturated_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of 16-bit samples go beyond 32 bits: saturated values and their number in each accumulation."""
    v = correlate.visibilities(_both_pols(spark, sf_dir, 60000, 16), TICKS)
    return v.groupBy("acc").agg(F.count_if("clipped").alias("clipped"), F.max("re").alias("most"), F.min("im").alias("least"))


@query(f"with {vis_sql(200, 127)} select acc, chan, prod, round(sqrt(re::double * re + im::double * im), 4) as magnitude, round(atan2(im::double, re::double) + 0.0, 6) as phase, round(case when re::double * re + im::double * im > 0 then 10 * log10(re::double * re + im::double * im) end, 4) as db from o where prod % 4 = 0")
def visibility_polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = correlate.visibilities(_both_pols(spark, sf_dir, 200, 8), TICKS).where("prod % 4 = 0")
    re, im = F.col("re").cast("double"), F.col("im").cast("double")
    return v.select("acc", "chan", "prod", F.round(X.magnitude(re, im), 4).alias("magnitude"), F.round(F.atan2(im, re) + 0.0, 6).alias("phase"), F.round(X.decibel(re * re + im * im), 4).alias("db"))


BEAMS_SQL = f"""{pols_sql(200, 127)}, w as (select b as beam, b % 2 as pol, a as ant, (a + 1) * 0.25::double as weight, 1 + b * 0.5::double as gain, (a * 3 + b) * 0.4::double as phase, (a - b) * 0.03::double as delay, b >= 2 as dither from range(4) x(b), range(4) y(a)),
k as (select *, weight * gain * cos(phase) as wr, weight * gain * sin(phase) as wi from w),
d as (select v.ts, v.chan, v.re, v.im, k.beam, k.dither, wr * cos(pi() * v.chan * delay) - wi * sin(pi() * v.chan * delay) as wr, wr * sin(pi() * v.chan * delay) + wi * cos(pi() * v.chan * delay) as wi from v join k on v.ant = k.ant and v.pol = k.pol),
s as (select ts, beam, chan, bool_or(dither) as dither, round(sum(re*wr - im*wi), 6) as re, round(sum(re*wi + im*wr), 6) as im from d group by 1, 2, 3),
n as (select ts, beam, chan, re + (case when dither then {dither_sql(5, 'beam', 'chan', 'ts', '0')} else 0 end) as re, im + (case when dither then {dither_sql(5, 'beam', 'chan', 'ts', '1')} else 0 end) as im from s),
q as (select ts, cast(beam as int) as beam, chan, cast(round_even(greatest(least(re, 127.0), -127.0), 0) as int) as q_re, cast(round_even(greatest(least(im, 127.0), -127.0), 0) as int) as q_im, (abs(re) > 127 or abs(im) > 127) as clipped from n)"""


def _weights(spark: SparkSession) -> DataFrame:
    w = spark.range(16).select(F.expr("cast(id div 4 as int)").alias("beam"), (F.col("id") % 4).cast("int").alias("ant")).withColumn("pol", F.col("beam") % 2)
    re, im = X.beam_weight((F.col("ant") + 1) * 0.25, 1 + F.col("beam") * 0.5, (F.col("ant") * 3 + F.col("beam")) * 0.4)
    return w.select("beam", "pol", "ant", re.alias("w_re"), im.alias("w_im"), ((F.col("ant") - F.col("beam")) * 0.03).alias("delay"), (F.col("beam") >= 2).alias("dither"))


def _beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.beams(_both_pols(spark, sf_dir, 200, 8), _weights(spark), digits=6, dither_seed=5)


@query(f"with {BEAMS_SQL} select * from q")
def delayed_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beams with quantising gains, fringe phases, delays across channels, and dither on some."""
    return _beams(spark, sf_dir)


@query(f"with {BEAMS_SQL} select beam, count(*) filter (clipped) as clipped, count(*) as samples, count(distinct ts) * 8 * 2 as bytes, cast(max(ts) + 1 as bigint) as next_ts from q group by 1")
def beam_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipped samples, samples, bytes and next timestamp of each beam."""
    return _beams(spark, sf_dir).groupBy("beam").agg(F.count_if("clipped").alias("clipped"), F.count(F.lit(1)).alias("samples"), (F.count_distinct("ts") * 16).alias("bytes"), (F.max("ts") + 1).alias("next_ts"))


@query("select b as beam, a as ant, round((a + 1) * 0.25 * (1 + b * 0.5) * cos((a * 3 + b) * 0.4), 6) as w_re, round((a + 1) * 0.25 * (1 + b * 0.5) * sin((a * 3 + b) * 0.4) + 0.0, 6) as w_im, round(-2.0::double * 26000 * (a - b) * 0.000001::double + 0.0, 6) as kernel_delay from range(4) x(b), range(4) y(a)")
def beam_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights as the beamformer applies them, and delays in half turns a channel."""
    w = _weights(spark)
    return w.select(F.col("beam").cast("long").alias("beam"), F.col("ant").cast("long").alias("ant"), F.round("w_re", 6).alias("w_re"), F.round(F.col("w_im") + 0.0, 6).alias("w_im"), F.round(X.kernel_delay((F.col("ant") - F.col("beam")) * 1e-6, 26000.0) + 0.0, 6).alias("kernel_delay"))


def _presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.expr("event_id div 4").alias("ts"), (F.col("event_id") % 4).cast("int").alias("ant"), (F.col("event_type") != "error").alias("present"))


@query("select event_id // 4 as ts, count(*) filter (event_type <> 'error') as beam_ants from events group by 1")
def beam_antennas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correlate.present_antennas(_presence(spark, sf_dir))


@query("""with b as (select event_id // 4 as ts, count(*) filter (event_type <> 'error') as ants from events group by 1), g as (select * from (values (0, true, 100), (1, true, 20), (2, false, 0)) t(beam, enabled, since))
select cast(beam as int) as beam, ts, ants from b, g where enabled and ts >= since and ants > 0""")
def beams_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beam heaps from when their beam is enabled, batches without an antenna left out."""
    gates = spark.createDataFrame([(0, True, 100), (1, True, 20), (2, False, 0)], "beam int, enabled boolean, since long")
    heaps = correlate.present_antennas(_presence(spark, sf_dir)).where("beam_ants > 0").select("ts", F.col("beam_ants").alias("ants"), F.explode(F.array(*map(F.lit, range(3)))).alias("beam"))
    return sinks.gated(heaps, "ts", gates, ["beam"]).select("beam", "ts", "ants")


ACCS_SQL = """p as (select event_id // 4 as ts, event_id % 4 as ant, event_type <> 'error' as present from events),
c as (select ts // 2 as acc, ant, bool_and(present) and count(distinct ts) = 2 as complete from p group by 1, 2),
a as (select acc % 3 as stream, acc, count(*) filter (complete) as complete, count(*) as antennas, acc % 5 as clipped from c group by acc)"""


@query(f"with {ACCS_SQL} select stream, count(*) filter (complete > 0) as heaps, 1024 * count(*) filter (complete > 0) as bytes, 40 * count(*) filter (complete > 0) as visibilities, cast(sum(case when complete > 0 then clipped else 0 end) as bigint) as clipped, count(*) filter (complete = 0) as skipped_accs, count(*) filter (complete > 0 and complete < antennas) as incomplete_accs from a group by 1")
def product_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of what a correlator sends; wholly missing accumulations are skipped."""
    c = correlate.complete(_presence(spark, sf_dir), 2, 2)
    accs = c.groupBy("acc").agg(F.count_if("complete").alias("complete"), F.count(F.lit(1)).alias("antennas")).withColumn("stream", F.col("acc") % 3).withColumn("clipped", F.col("acc") % 5)
    return sinks.product_counters(accs, 1024, 40)


@query(f"with {ACCS_SQL} select acc, complete = antennas as synchronised, cast((acc + 1) * 2 as bigint) as next_ts from a where complete > 0 and acc >= 30")
def products_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accumulations sent since the stream was enabled, whether all antennas are in them, and the next timestamp."""
    c = correlate.complete(_presence(spark, sf_dir), 2, 2).groupBy("acc").agg(F.count_if("complete").alias("n"), F.count(F.lit(1)).alias("antennas")).where("n > 0")
    on = spark.createDataFrame([(True, 30)], "enabled boolean, since long")
    return sinks.gated(c, "acc", on).select("acc", (F.col("n") == F.col("antennas")).alias("synchronised"), ((F.col("acc") + 1) * 2).alias("next_ts"))


@query("""with v as (select event_id // 4 as ts, event_id % 4 as ant, cast(round_even(value, 0) as bigint) as re, user_id as im, event_type <> 'error' as present from events where event_type <> 'signup')
select ts, ant, case when present then re else 0 end as re, case when present then im else 0 end as im from v""")
def absent_zeroed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of absent antennas as zeros."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    v = e.select(F.expr("event_id div 4").alias("ts"), (F.col("event_id") % 4).alias("ant"), F.rint("value").cast("long").alias("re"), F.col("user_id").alias("im"))
    present = _presence(spark, sf_dir).where("present").withColumn("ant", F.col("ant").cast("long"))
    return postprocess.zero_absent(v, present, ["ts", "ant"])


SEND_SQL = """b as (select event_id as batch, event_type <> 'error' as present from events), n as (select batch, row_number() over (order by batch) - 1 as ordinal from b where present),
h as (select batch, s as substream, (cast(s as bigint) << 40) + 3 + ordinal * 8 as heap_id, s * 2 // 4 as interface, 4096 as bytes from n, range(4) t(s))"""


@query(f"with {SEND_SQL} select * from h")
def channelised_sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps of present batches by substream, with ids that no other engine uses."""
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), (F.col("event_type") != "error").alias("present"))
    return sinks.channelised(b, 4, 3, 8, 2, 4096)


@query(f"with {SEND_SQL} select substream, cast(max(batch) as bigint) as after, max(heap_id) as last_id, count(*) as heaps, count(*) * 4096 as bytes, (select count(*) from b where not present) as skipped from h group by 1")
def channelised_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heaps, bytes and skipped batches of each substream, and the heap that its end follows."""
    b = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch"), (F.col("event_type") != "error").alias("present"))
    sent = sinks.channelised(b, 4, 3, 8, 2, 4096)
    skipped = b.where(~F.col("present")).count()
    counted = sent.groupBy("substream").agg(F.count(F.lit(1)).alias("heaps"), F.sum(F.col("bytes").cast("long")).alias("bytes"))
    return sinks.stops(sent).join(counted, "substream").withColumn("skipped", F.lit(skipped).cast("long"))


@query("select c as chan, c // 8 as substream, c * 3 // 32 as interface from range(32) r(c)")
def channel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(32).select(F.col("id").alias("chan"), sinks.substream(F.col("id"), 32, 4).alias("substream"), sinks.interface(F.col("id"), 32, 3).alias("interface"))


@query("""select event_id, round(case when user_id % 10 = 0 then 0 else (user_id * 100 + ((user_id * 100 + 1023) // 1024) * 72) / (user_id % 10 * 0.001) * 1.1 end, 4) as rate from events""")
def send_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.heaps import send_rate

    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(send_rate(72, 1024, F.col("user_id") * 100, (F.col("user_id") % 10) * 0.001, 1.1), 4).alias("rate"))


@query("select a as at, cast(s as int) as substream from range(7, 1000, 60) t(a), range(3) u(s)")
def announcements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.announcements(spark, 7, 1000, 60, 3)


@query("""with e as (select event_id as "at", user_id % 3 as queue, case when event_type in ('click', 'view') then 1 else -1 end as delta from events)
select "at", queue, cast(delta as int) as delta, cast(sum(delta) over (partition by queue order by "at") as bigint) as qsize from e""")
def queue_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("at"), (F.col("user_id") % 3).alias("queue"), F.when(F.col("event_type").isin("click", "view"), 1).otherwise(-1).alias("delta"))
    return sinks.queue_events(e)


@query("""select cast(n_nationkey as varchar) || '_n_name' as key, n_name as value from nation union all select cast(n_nationkey as varchar) || '_n_regionkey', cast(n_regionkey as varchar) from nation""")
def key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Configuration as keys and values."""
    return sinks.key_values(table(spark, sf_dir, "nation"), ["n_nationkey"], ["n_name", "n_regionkey"])


@query("""with l as (select event_id // 4 as i, event_id % 4 as thread, user_id % 4 as level from events where event_id % 4000 <> 17), f as (select i // 100 as frame, thread, i, level, count(*) over (partition by i // 100, thread) as n from l),
b as (select frame, thread, i // 4 as k, cast(sum(level << cast(2 * (i % 4) as int)) as int) as byte from f where n = 100 group by 1, 2, 3)
select frame, thread, frame * 4 + thread as seq, (frame * 4 + thread) % 3 as destination, string_agg(printf('%02X', byte), '' order by k) as payload from b group by 1, 2""")
def recorder_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 2-bit samples of four threads, numbered and dealt to destinations in turn."""
    levels = table(spark, sf_dir, "events").where("event_id % 4000 <> 17").select(F.expr("event_id div 4").alias("i"), (F.col("event_id") % 4).alias("thread"), (F.col("user_id") % 4).alias("level"))
    return sinks.frames(levels, 100, 3).withColumn("payload", F.hex("payload"))


@query("""with v as (select vec_id // 2 as ts, vec_id % 2 as pol, cast(c as int) as chan, embedding[2*c+1]::double as re, embedding[2*c+2]::double as im from embeddings, range(32) r(c)),
d as (select ts, pol, t, cast(sum(re * cos(2 * pi() * (chan * t % 32) / 32) - im * sin(2 * pi() * (chan * t % 32) / 32)) / 32 as double) as re, sum(re * sin(2 * pi() * (chan * t % 32) / 32) + im * cos(2 * pi() * (chan * t % 32) / 32)) / 32 as im from v, range(32) u(t) group by 1, 2, 3)
select ts * 32 + t as i, pol, round(re + 0.0, 6) as re, round(im + 0.0, 6) as im from d""")
def time_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channels back to samples."""
    from ..operators import recorder

    e = table(spark, sf_dir, "embeddings").select(F.expr("vec_id div 2").alias("ts"), (F.col("vec_id") % 2).alias("pol"), F.expr("filter(embedding, (x, i) -> i % 2 = 0)").alias("re"), F.expr("filter(embedding, (x, i) -> i % 2 = 1)").alias("im"))
    return recorder.inverse_transform(e, 32).select("i", "pol", F.round(F.col("re") + 0.0, 6).alias("re"), F.round(F.col("im") + 0.0, 6).alias("im"))


@query("""select cast(floor((event_id + 30.0) / 100) as bigint) as second, event_id + 30 - 100 * cast(floor((event_id + 30.0) / 100) as bigint) as offset, event_id as i from events""")
def second_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by UTC second, the first chunk a part of one."""
    from ..operators import recorder

    return recorder.by_second(table(spark, sf_dir, "events").select(F.col("event_id").alias("i")), 100, 0.3).select("second", "offset", "i")


@query("""with d as (select event_id, (value - 20) * 1e-6 as delay from events), f as (select event_id, delay, (0.25 + (delay - floor(delay))) % 1.0 as frac from d)
select event_id, round(delay + (round_even(frac * 1712000.0, 0) / 1712000.0 - frac), 12) as delay from f""")
def quantised_delay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorder delays moved so that the epoch falls on a sample."""
    from ..operators import recorder

    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(recorder.quantised_delay((F.col("value") - 20) * 1e-6, 10.25, 1712000.0), 12).alias("delay"))


@query()
def sidebands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Band-pass, resampling by 3/4 and separation into two real sidebands."""
    from ..operators import recorder

    z = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.col("value") - 50).alias("re"), (F.col("user_id") - 50.0).alias("im"))
    return recorder.sidebands(z, 3, 4)


@query("""with x as (select event_id // 1000 as second, user_id % 2 as pol, event_type in ('click', 'view') as upper, value - 25 as x from events)
select second, pol, upper, round(avg(x * x), 4) as mean_power, count(*) as n from x group by 1, 2, 3""")
def sideband_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean power of each second, polarisation and sideband, as recorded."""
    x = table(spark, sf_dir, "events").select(F.expr("event_id div 1000").alias("second"), (F.col("user_id") % 2).alias("pol"), F.col("event_type").isin("click", "view").alias("upper"), (F.col("value") - 25).alias("x"))
    return x.groupBy("second", "pol", "upper").agg(F.round(F.avg(F.col("x") * F.col("x")), 4).alias("mean_power"), F.count(F.lit(1)).alias("n"))


@query(f"""with {pols_sql(200, 127)}, p as (select ts, ant, chan, sum(case when pol = 0 then re else 0 end)::double r0, sum(case when pol = 1 then re else 0 end)::double r1, sum(case when pol = 0 then im else 0 end)::double i0, sum(case when pol = 1 then im else 0 end)::double i1 from v group by 1, 2, 3)
select ts, ant, chan, cast(q as int) as pol, round(sqrt(0.5) * r0 - (case when q = 0 then 1 else -1 end) * sqrt(0.5) * i1 + 0.0, 6) as re, round(sqrt(0.5) * i0 + (case when q = 0 then 1 else -1 end) * sqrt(0.5) * r1 + 0.0, 6) as im from p, range(2) t(q)""")
def circular_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear polarisations as circular ones, by complex factors."""
    h = 0.5**0.5
    out = correlate.basis(_both_pols(spark, sf_dir, 200, 8), [[h, 1j * h], [h, -1j * h]])
    return out.select("ts", "ant", "chan", "pol", F.round(F.col("re") + 0.0, 6).alias("re"), F.round(F.col("im") + 0.0, 6).alias("im"))
