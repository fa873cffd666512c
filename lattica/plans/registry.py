"""Queries of the signal engine by name over the driver's tables, with the same in SQL.

events.event_id is a contiguous sample index; embeddings are array-packed voltages."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import channelise, correlate, timeline
from ..signal import dsl
from ..streaming import accumulate as stream_acc
from . import base, fchain, ingest, qualify, streams, xchain  # noqa: F401  (their queries register themselves)

ANTS, BATCHES = 8, 16
TAPS, STEP = 4, 16


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _voltages(spark: SparkSession, sf_dir: str, gain: float = 200.0) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.expr("filter(embedding, (x, i) -> i % 2 = 0)").alias("re"), F.expr("filter(embedding, (x, i) -> i % 2 = 1)").alias("im"))).alias("chan", "z"))
    part = lambda c: X.quantise(F.round(F.col(f"z.{c}").cast("double") * gain, 9))
    return e.select(F.expr(f"vec_id div {ANTS}").alias("ts"), (F.col("vec_id") % ANTS).cast("int").alias("ant"), "chan", F.lit(0).alias("pol"), part("re").alias("re"), part("im").alias("im"))


V_SQL = f"""v as (select vec_id // {ANTS} as ts, cast(vec_id % {ANTS} as int) as ant, cast(c as int) as chan,
  cast(round_even(greatest(least(round(cast(embedding[2*c+1] as double)*200, 9), 127.0), -127.0), 0) as bigint) as re,
  cast(round_even(greatest(least(round(cast(embedding[2*c+2] as double)*200, 9), 127.0), -127.0), 0) as bigint) as im
  from embeddings, range(32) r(c))"""


def visibilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voltages(spark, sf_dir)
    heard = v.select("ts", "ant").distinct().withColumn("present", ~((F.col("ant") == 3) & (F.col("ts") % 40 == 5)))
    return correlate.visibilities(v, BATCHES, BATCHES, heard).withColumn("acc", F.col("acc").cast("long"))


VIS_SQL = f"""with {V_SQL}, ok as (select ts // {BATCHES} as acc, ant, bool_and(not (ant = 3 and ts % 40 = 5)) and count(distinct ts) = {BATCHES} as complete from v group by 1, 2),
s as (select a.ts // {BATCHES} as acc, a.chan, a.ant a1, b.ant a2, 4 * (b.ant*(b.ant+1)//2 + a.ant) as prod,
  sum(a.re*b.re + a.im*b.im) as re, sum(a.im*b.re - a.re*b.im) as im
  from v a join v b on a.ts = b.ts and a.chan = b.chan and a.ant <= b.ant group by 1, 2, 3, 4)
select s.acc, chan, prod, cast(case when p.complete and q.complete then least(greatest(re, -2147483647), 2147483647) else -2147483648 end as int) as re,
 cast(case when p.complete and q.complete then least(greatest(im, -2147483647), 2147483647) else 1 end as int) as im,
 (p.complete and q.complete and (abs(re) > 2147483647 or abs(im) > 2147483647)) as clipped
from s join ok p on s.acc = p.acc and s.a1 = p.ant join ok q on s.acc = q.acc and s.a2 = q.ant"""


def beam_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spark.range(2 * ANTS).select((F.col("id") % 2).cast("int").alias("beam"), F.lit(0).alias("pol"), F.expr("cast(id div 2 as int)").alias("ant"))
    w = w.withColumn("w_re", (F.col("ant") + 1) * 0.25 - F.col("beam") * 0.5).withColumn("w_im", F.col("beam") * 0.125 * F.col("ant"))
    return correlate.beams(_voltages(spark, sf_dir), w, digits=9)


BEAM_SQL = f"""with {V_SQL}, w as (select b as beam, a as ant, (a+1)*0.25::double - b*0.5::double as wr, b*0.125::double*a as wi from range(2) x(b), range({ANTS}) y(a)),
s as (select ts, beam, chan, round(sum(re*wr - im*wi), 9) as re, round(sum(re*wi + im*wr), 9) as im from v join w using (ant) group by 1, 2, 3)
select ts, cast(beam as int) as beam, chan, cast(round_even(greatest(least(re, 127.0), -127.0), 0) as int) as q_re, cast(round_even(greatest(least(im, 127.0), -127.0), 0) as int) as q_im, (abs(re) > 127 or abs(im) > 127) as clipped from s"""


def jones_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voltages(spark, sf_dir).withColumn("pol", F.col("ant") % 2).withColumn("ant", F.expr("ant div 2").cast("int"))
    h = math.sqrt(0.5)
    return correlate.basis(v, [[h, h], [h, -h]]).select("ts", "ant", "chan", "pol", F.round(F.col("re") + 0.0, 6).alias("re"), F.round(F.col("im") + 0.0, 6).alias("im"))


JONES_SQL = f"""with {V_SQL}, p as (select ts, ant // 2 as ant, chan, sum(case when ant % 2 = 0 then re else 0 end)::double r0, sum(case when ant % 2 = 1 then re else 0 end)::double r1,
 sum(case when ant % 2 = 0 then im else 0 end)::double i0, sum(case when ant % 2 = 1 then im else 0 end)::double i1 from v group by 1, 2, 3)
select ts, cast(ant as int) as ant, chan, cast(q as int) as pol, round(sqrt(0.5)*r0 + (case when q = 0 then 1 else -1 end)*sqrt(0.5)*r1 + 0.0, 6) as re,
 round(sqrt(0.5)*i0 + (case when q = 0 then 1 else -1 end)*sqrt(0.5)*i1 + 0.0, 6) as im from p, range(2) t(q)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.rint((F.col("value") - 20) * 8).alias("x"))


X_SQL = "x as (select event_id as i, round_even((value - 20) * 8, 0) as x from events)"


def _weight(i):
    return F.cos(i.cast("double") * (math.pi / (TAPS * STEP)))


W_SQL = f"cos(cast(%s as double) * (pi() / {TAPS * STEP}))"
FIR_SQL = f"""{X_SQL}, f as (select i // {STEP} - t as k, cast(i % {STEP} as int) as b, sum({W_SQL % f'(t * {STEP} + i % {STEP})'} * x) as y
 from x, range({TAPS}) r(t) where i // {STEP} - t >= 0 group by 1, 2 having count(*) = {TAPS})"""


def fir_wideband(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channelise.fir(_samples(spark, sf_dir), _weight, TAPS, STEP).select("k", "b", F.round(F.col("y") + 0.0, 6).alias("y"))


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channelise.dft(channelise.fir(_samples(spark, sf_dir), _weight, TAPS, STEP), STEP)


DFT_SQL = f"""{FIR_SQL}, d as (select k, cast(c as int) as chan, sum(y * cos((b * c % {STEP}) * (-2 * pi() / {STEP}))) as re, sum(y * sin((b * c % {STEP}) * (-2 * pi() / {STEP}))) as im from f, range({STEP // 2}) r(c) group by 1, 2 having count(*) = {STEP})"""


def dft_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spectra(spark, sf_dir).select("k", "chan", F.round(F.col("re") + 0.0, 4).alias("re"), F.round(F.col("im") + 0.0, 4).alias("im"))


def peak_sfdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    power = _spectra(spark, sf_dir).select("k", "chan", F.round(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 3).alias("power")).where("power > 0")
    return timeline.peaks(power, ["k"]).select("k", "peak_chan", F.round("sfdr_db", 4).alias("sfdr_db"))


PEAK_SQL = f"""with {DFT_SQL}, p as (select k, chan, round(re*re + im*im, 3) as power from d), r as (select *, row_number() over (partition by k order by power desc, chan) as r from p where power > 0)
select k, max(case when r = 1 then chan end) as peak_chan, round(10 * log10(max(case when r = 1 then power end) / max(case when r = 2 then power end)), 4) as sfdr_db from r where r <= 2 group by k"""


def ddc_mix_decimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = channelise.ddc(_samples(spark, sf_dir), lambda t: F.cos(t.cast("double") * 0.05), 32, 8, 21, 100)
    return out.select("n", F.round(F.col("re") + 0.0, 4).alias("re"), F.round(F.col("im") + 0.0, 4).alias("im"))


DDC_SQL = f"""with {X_SQL}, s as (select (i - t) // 8 as n, cos(cast(t as double) * 0.05) * x * cos((i * 21 % 100) * (2 * pi() / 100)) as r, cos(cast(t as double) * 0.05) * x * sin((i * 21 % 100) * (2 * pi() / 100)) as m
 from x, range(32) r(t) where (i - t) % 8 = 0 and i >= t)
select n, round(sum(r) + 0.0, 4) as re, round(sum(m) + 0.0, 4) as im from s group by n having count(*) = 32"""


def quantise_saturate(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.round(F.col("x").cast("double") * 500, 9))
    return x.groupBy("label").agg(F.count_if(X.saturated(F.col("x"))).alias("n_saturated"), F.sum(X.quantise(F.col("x")).cast("long")).alias("total"), F.count_if(X.at_limit(X.quantise(F.col("x")), 8)).alias("n_at_limit"))


QUANT_SQL = """with x as (select label, round(cast(u as double) * 500, 9) as x from (select label, unnest(embedding) as u from embeddings)), q as (select label, x, cast(round_even(greatest(least(x, 127.0), -127.0), 0) as bigint) as q from x)
select label, count(*) filter (abs(x) > 127) as n_saturated, cast(sum(q) as bigint) as total, count(*) filter (abs(q) >= 127) as n_at_limit from q group by label"""


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    points = e.where("event_type = 'click'").select(F.col("event_id").alias("t"))
    models = e.where("event_type = 'view'").select(F.col("event_id").alias("start"), F.col("value").alias("delay"), (F.col("user_id") % 7).cast("double").alias("rate"))
    found = timeline.as_of(points, models, ["delay", "rate"], 4096)
    return found.withColumn("d", F.round(F.col("m_delay") + F.col("m_rate") * (F.col("t") - F.col("m_start")), 9))


ASOF_SQL = """p as (select event_id as t from events where event_type = 'click'), m as (select event_id as start, value as delay, cast(user_id % 7 as double) as rate from events where event_type = 'view'),
a as (select t, round(delay + rate * (t - start), 9) as d from p asof left join m on p.t >= m.start)"""


def delay_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    coarse, fine = timeline.coarse_fine(F.col("d"))
    return _asof(spark, sf_dir).select("t", coarse.alias("coarse"), F.round(fine + 0.0, 6).alias("fine"), F.round(X.coarse_phase(coarse), 6).alias("phase"))


DELAY_SQL = f"""with {ASOF_SQL} select t, cast(round_even(d, 0) as bigint) as coarse, round(d - round_even(d, 0) + 0.0, 6) as fine, round((((cast(round_even(d, 0) as bigint) % 4) + 4) % 4) * (pi() / 2), 6) as phase from a"""


def coarse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "events").select((F.col("user_id") % 5).alias("pol"), F.col("event_id").alias("t"), F.floor(F.col("value") / 50).cast("long").alias("coarse"))
    return timeline.runs(x, "coarse", ["pol"], "t").select("pol", F.col("run").cast("long").alias("run"), "coarse", "first", "last", "n")


RUNS_SQL = """with x as (select user_id % 5 as pol, event_id as t, cast(floor(value / 50) as bigint) as coarse from events), c as (select *, case when lag(coarse) over w is not distinct from coarse and row_number() over w > 1 then 0 else 1 end as c from x window w as (partition by pol order by t)),
r as (select *, sum(c) over (partition by pol order by t) as run from c)
select pol, cast(run as bigint) as run, any_value(coarse) as coarse, min(t) as first, max(t) as last, count(*) as n from r group by 1, 2"""


def presence_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    last = e.agg(F.max("event_id").alias("m")).first()["m"]
    grid = timeline.expected_grid(spark, 0, last, 1)
    got = timeline.presence(grid, e.where("event_type <> 'error'").select(F.col("event_id").alias("t")), ["t"])
    return timeline.good_counts(got, "t", 7, 1024).select("t", "present", F.col("good").alias("n_good"), (F.col("good") == 8).alias("valid"))


PRESENCE_SQL = """with g as (select t, (event_id is not null) as present from range((select max(event_id) + 1 from events)) r(t) left join (select event_id from events where event_type <> 'error') e on e.event_id = t)
select t, present, n_good, n_good = 8 as valid from (select t, present, cast(sum(cast(present as int)) over (order by t rows between current row and 7 following) as bigint) as n_good from g)"""


def missing_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    got = e.where("event_type <> 'error'").select(F.col("event_id").alias("t"))
    return e.select(F.col("event_id").alias("t")).join(got, "t", "left_anti").groupBy(F.expr("t div 256").alias("chunk")).agg(F.count(F.lit(1)).alias("missing"))


MISSING_SQL = "select event_id // 256 as chunk, count(*) as missing from events where event_type = 'error' group by 1"


def heap_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _table(spark, sf_dir, "events").select(F.col("event_id").alias("ts"), F.when(F.col("value") > 60, 100).otherwise(128).alias("heap_len"), (F.col("user_id") % 9).alias("feng_id"))
    return h.groupBy(F.coalesce(timeline.reject_reason(128, 2, 8), F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


REJECT_SQL = """select case when value > 60 then 'metadata' when event_id % 2 <> 0 then 'bad_timestamp' when user_id % 9 >= 8 then 'bad_feng_id' else 'accepted' end as reason, count(*) as n from events group by 1"""


def accum_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _table(spark, sf_dir, "events").select(F.col("event_id").alias("t"), F.when(F.col("event_type") != "error", F.rint(F.col("value") * 100).cast("long")).alias("value"))
    return timeline.accumulate(t, 8).select(F.col("window").cast("long").alias("win"), "total")


ACCUM_SQL = """select event_id // 8 as win, cast(case when count(case when event_type <> 'error' then value end) = 8 then sum(cast(round_even(value * 100, 0) as bigint)) end as bigint) as total from events group by 1"""


def power_dbfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir).withColumn("x", X.clamp(F.col("x"), 511.0).cast("long"))
    return timeline.power_table(s, 64, 10).select(F.col("w").cast("long").alias("w"), "total", "saturated", F.round("db", 6).alias("db"), "status")


POWER_SQL = f"""with {X_SQL}, s as (select i // 64 as w, cast(greatest(least(x, 511), -511) as bigint) as x from x), p as (select w, cast(sum(x*x) as bigint) as total, count(*) as n, count(*) filter (abs(x) >= 511) as saturated from s group by 1),
d as (select *, 10 * log10(cast(total as double) / n / (511.0::double * 511 / 2)) as db from p)
select w, total, saturated, round(db, 6) as db, case when db between -30 and -10 then 'nominal' when db between -33 and -7 then 'warn' else 'error' end as status from d"""


def norm_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"), (F.col("user_id") % 2).alias("pol"), F.col("value").alias("x"))
    return timeline.normalise_power(e, ["day", "pol"]).groupBy("day", "pol").agg(F.round(F.max("power"), 4).alias("mean_power"), F.round(F.avg(F.col("y") * F.col("y")), 6).alias("unit"), F.round(F.max("y"), 4).alias("most"))


NORM_SQL = """with p as (select cast(ts as date) as day, user_id % 2 as pol, value as x, avg(value * value) over (partition by cast(ts as date), user_id % 2) as power from events)
select day, pol, round(max(power), 4) as mean_power, round(avg(x * x / power), 6) as "unit", round(max(x / sqrt(power)), 4) as most from p group by 1, 2"""


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events").where("event_type <> 'error'").select(F.col("event_id").alias("t"), F.rint("value").cast("long").alias("v"))
    chunks = e.groupBy(F.expr("t div 4").alias("c")).agg(F.sum("v").alias("v"))
    last = e.agg(F.max("t").alias("m")).first()["m"] // 4
    grid = timeline.expected_grid(spark, 0, last, 1).withColumnRenamed("t", "c")
    return grid.join(chunks, "c", "left").select("c", F.coalesce("v", F.lit(0)).alias("v"), F.col("v").isNotNull().alias("present"))


GAP_SQL = """with e as (select event_id as t, cast(round_even(value, 0) as bigint) as v from events where event_type <> 'error'), k as (select t // 4 as c, cast(sum(v) as bigint) as v from e group by 1)
select g.c, coalesce(v, 0) as v, (v is not null) as present from range((select max(t) // 4 + 1 from e)) g(c) left join k on k.c = g.c"""


def unpack10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: X.quantise(F.round(x.cast("double") * 1000, 9), 10)).alias("x"))
    packed = rows.select("vec_id", X.pack_bits(F.col("x"), 10).alias("payload"))
    got = packed.select("vec_id", F.hex("payload").alias("payload_hex"), X.unpack_bits(F.col("payload"), 10).alias("x"))
    return got.select("vec_id", F.length("payload_hex").alias("hex_chars"), F.posexplode("x").alias("i", "value"))


UNPACK_SQL = """select vec_id, 160 as hex_chars, cast(i as int) as i, cast(round_even(greatest(least(round(cast(embedding[i + 1] as double) * 1000, 9), 511.0), -511.0), 0) as int) as value from embeddings, range(64) r(i)"""


def pack4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _voltages(spark, sf_dir, 10.0)
    part = lambda c: X.clamp(F.col(c), 7).cast("int")
    byte = X.pack4(part("re"), part("im"))
    re, im = X.unpack4(byte)
    return v.select("ts", "ant", "chan", byte.alias("byte"), re.alias("re4"), im.alias("im4"))


PACK4_SQL = f"""with {V_SQL.replace('*200', '*10')}, q as (select ts, ant, chan, cast(greatest(least(re, 7), -7) as int) as r, cast(greatest(least(im, 7), -7) as int) as m from v)
select ts, ant, chan, ((r + 16) % 16) * 16 + (m + 16) % 16 as byte, r as re4, m as im4 from q"""


def vlbi_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _table(spark, sf_dir, "events").select(F.expr("event_id div 2000").alias("frame"), F.col("value").alias("x"))
    y = timeline.normalise_power(x.withColumn("x", F.col("x") - 25), ["frame"]).withColumn("y", F.round("y", 9))
    return y.groupBy("frame", X.level2(F.col("y")).alias("level")).agg(F.count(F.lit(1)).alias("n"))


VLBI_SQL = """with x as (select event_id // 2000 as frame, value - 25 as x from events), y as (select frame, round(x / sqrt(avg(x * x) over (partition by frame)), 9) as y from x)
select frame, cast(case when y < -0.969 then 0 when y < 0 then 1 when y < 0.969 then 2 else 3 end as int) as level, count(*) as n from y group by 1, 2"""


def signal_cw_comb(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = 4096
    program = dsl.parse("a = cw(0.5, 100.0); comb(0.25, 64.0) + a * 0.5; a - 0.125;")
    frame = spark.range(n).withColumnRenamed("id", "i")
    cols = [X.quantise_digitiser(F.round(s.column(F.col("i"), n, 4096.0), 9), 8).alias(f"s{k}") for k, s in enumerate(program)]
    return frame.select("i", *cols)


CW_SQL = """with x as (select i, 0.5 * cos(2 * pi() * ((100 * i) % 4096) / 4096) as a, case when i % 64 = 0 then 0.25 else 0 end as c from range(4096) r(i))
select i, cast(round_even(greatest(least(round(round(c + a * 0.5, 9) * 127, 12), 127.0), -127.0), 0) as int) as s0, cast(round_even(greatest(least(round(round(a - 0.125, 9) * 127, 12), 127.0), -127.0), 0) as int) as s1 from x"""


def stream_accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_acc.daily(spark, sf_dir)


STREAM_SQL = """with e as (select cast(ts as date) as day, event_type, value from events), m as (select max(ts) as t from events)
select day, event_type, count(*) as n, round(sum(value), 4) as total from e, m where cast(day as timestamp) + interval 1 day <= t - interval 1 day group by 1, 2"""

QUERIES = {f.__name__: f for f in (visibilities, beam_sum, jones_basis, fir_wideband, dft_channels, peak_sfdr, ddc_mix_decimate, quantise_saturate, delay_asof, coarse_runs, presence_batches, missing_heaps, heap_rejects, accum_windows, power_dbfs, norm_power, gap_fill, unpack10, pack4_roundtrip, vlbi_levels, signal_cw_comb, stream_accum)}

ORACLES = {
    "visibilities": VIS_SQL, "beam_sum": BEAM_SQL, "jones_basis": JONES_SQL, "fir_wideband": f"with {FIR_SQL} select k, b, round(y + 0.0, 6) as y from f",
    "dft_channels": f"with {DFT_SQL} select k, chan, round(re + 0.0, 4) as re, round(im + 0.0, 4) as im from d", "peak_sfdr": PEAK_SQL, "ddc_mix_decimate": DDC_SQL, "quantise_saturate": QUANT_SQL,
    "delay_asof": DELAY_SQL, "coarse_runs": RUNS_SQL, "presence_batches": PRESENCE_SQL, "missing_heaps": MISSING_SQL, "heap_rejects": REJECT_SQL, "accum_windows": ACCUM_SQL, "power_dbfs": POWER_SQL,
    "norm_power": NORM_SQL, "gap_fill": GAP_SQL, "unpack10": UNPACK_SQL, "pack4_roundtrip": PACK4_SQL, "vlbi_levels": VLBI_SQL, "signal_cw_comb": CW_SQL, "stream_accum": STREAM_SQL,
}

QUERIES |= base.QUERIES
ORACLES |= base.ORACLES
