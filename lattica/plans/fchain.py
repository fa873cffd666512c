"""Queries of the channeliser chain: delays, filters, corrections, overlap, output heaps, simulated digitiser."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import channelise, delay, design, postprocess, timeline
from ..signal import digitise, dsl
from .base import query, table

WRAP = "(%s + pi() - floor((%s + pi()) / (2 * pi())) * 2 * pi() - pi())"


def wrapped(x: str) -> str:
    return WRAP % (x, x)


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'view'")
    start = F.col("event_id") + (F.col("user_id") % 50) * 4 - 90
    return e.select(F.col("event_id").alias("arrival"), start.alias("start"), F.col("value").alias("delay"), ((F.col("user_id") % 7) / 8.0).alias("delay_rate"), (F.col("user_id") * 0.1).alias("phase"), ((F.col("user_id") % 3) * 0.01).alias("phase_rate")).where("start >= 0")


MODEL_SQL = """m0 as (select event_id as arrival, event_id + (user_id % 50) * 4 - 90 as start, value as delay, (user_id % 7) / 8.0::double as rate, user_id * 0.1::double as phase, (user_id % 3) * 0.01::double as phase_rate from events where event_type = 'view' and event_id + (user_id % 50) * 4 - 90 >= 0),
m as (select * from (select *, min(start) over (order by arrival rows between 1 following and unbounded following) as least from m0) where least is null or start < least),
p as (select event_id as t from events where event_type = 'click'),
a as (select t, coalesce(start, -1) as start, coalesce(delay, 0) as delay, coalesce(rate, 0) as rate, coalesce(phase, 0) as phase, coalesce(phase_rate, 0) as phase_rate from p asof left join m on p.t >= m.start),
d as (select t, cast(round_even(delay + (t - start) * rate, 0) as bigint) as coarse, delay + (t - start) * rate as whole, (t - start) * phase_rate + phase as ph from a),
e as (select t, t - coarse as input, coarse, whole - coarse as fine, """ + wrapped("ph") + " as phase from d)"


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("t"))
    return delay.evaluate(points, _models(spark, sf_dir))


def _tidy(c: str | object, digits: int = 6):
    return F.round((F.col(c) if isinstance(c, str) else c) + 0.0, digits)


@query(f"with {MODEL_SQL} select t, input, coarse, round(fine + 0.0, 6) as fine, round(phase + 0.0, 6) as phase, round(fine / 8 + 0.0, 6) as narrow from e")
def delay_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delays of models that arrive out of order and delete one another: coarse, fine, phase; and the
    fine delay of a narrow output."""
    return _evaluated(spark, sf_dir).select("t", "input", "coarse", _tidy("fine").alias("fine"), _tidy("phase").alias("phase"), _tidy(X.fine_delay(F.col("fine"), 8)).alias("narrow"))


@query(f"""with {MODEL_SQL} select t, cast(floor((2 * input + 4 - sign(fine)::int) / 8) as bigint) * 4 as even, round(fine + cast(floor((2 * input + 4 - sign(fine)::int) / 8) as bigint) * 4 - input + 0.0, 6) as even_rest,
 cast(floor((input + 2) / 5) as bigint) * 5 as odd, round(fine + cast(floor((input + 2) / 5) as bigint) * 5 - input + 0.0, 6) as odd_rest from e""")
def delay_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Input times snapped to multiples of 4 and of 5."""
    e = _evaluated(spark, sf_dir)
    even, rest = delay.aligned(F.col("input"), F.col("fine"), 4)
    odd, odd_rest = delay.aligned(F.col("input"), F.col("fine"), 5)
    return e.select("t", even.alias("even"), _tidy(rest).alias("even_rest"), odd.alias("odd"), _tidy(odd_rest).alias("odd_rest"))


@query("""with q as (select event_id, event_id * 10 as target, event_id * 3 as begin, event_id * 9 as start, value as delay, (user_id % 7) / 8.0::double as rate from events),
c as (select event_id, target, unnest(range(4)) * 16 + cast(ceil(greatest(ceil((target - start + delay - 0.5) / (1 - rate)) + start, begin) / 16) as bigint) * 16 as t, start, delay, rate from q)
select event_id, min(t) as t from c where t - cast(round_even(delay + (t - start) * rate, 0) as bigint) >= target group by 1""")
def delay_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First output time whose input is at a target or later."""
    e = table(spark, sf_dir, "events")
    t = delay.skip(F.col("event_id") * 10, F.col("event_id") * 3, 16, F.col("event_id") * 9, F.col("value"), (F.col("user_id") % 7) / 8.0)
    return e.select("event_id", t.alias("t"))


def _spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.arrays_zip(F.expr("filter(embedding, (x, i) -> i % 2 = 0)").alias("re"), F.expr("filter(embedding, (x, i) -> i % 2 = 1)").alias("im"))).alias("chan", "z"))
    return e.select(F.expr("vec_id div 2").alias("spectrum"), (F.col("vec_id") % 2).alias("pol"), "chan", F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))


SPECTRA_SQL = "s as (select vec_id // 2 as spectrum, vec_id % 2 as pol, cast(c as int) as chan, cast(embedding[2*c+1] as double) as re, cast(embedding[2*c+2] as double) as im from embeddings, range(32) r(c))"
POST_SQL = f"""{SPECTRA_SQL}, f as (select *, ((spectrum * 2 + pol) % 9) * 0.125::double - 0.5 as delay, ((spectrum + pol) % 7) * 0.3::double as phase, 40.0::double + chan as g_re, pol * 3.0::double - 1 as g_im from s),
a as (select *, (-pi() / 32) * (chan - 16.0::double) * delay + phase as angle from f),
t as (select spectrum, pol, chan, g_re, g_im, re * cos(angle) - im * sin(angle) as re, re * sin(angle) + im * cos(angle) as im from a),
g as (select spectrum, pol, chan, round(re * g_re - im * g_im, 6) as re, round(re * g_im + im * g_re, 6) as im from t),
v as (select spectrum, pol, chan, cast(round_even(greatest(least(re, 127.0), -127.0), 0) as int) as re, cast(round_even(greatest(least(im, 127.0), -127.0), 0) as int) as im, (abs(re) > 127 or abs(im) > 127) as clipped from g)"""


def _corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spectra(spark, sf_dir)
    fine = s.select("spectrum", "pol").distinct().select("spectrum", "pol", (((F.col("spectrum") * 2 + F.col("pol")) % 9) * 0.125 - 0.5).alias("delay"), (((F.col("spectrum") + F.col("pol")) % 7) * 0.3).alias("phase"))
    gains = spark.range(64).select((F.col("id") % 32).cast("int").alias("chan"), F.expr("id div 32").alias("pol")).select("chan", "pol", (F.col("chan") + 40.0).alias("g_re"), (F.col("pol") * 3.0 - 1).alias("g_im"))
    return postprocess.corrected(s, fine, gains, 32, digits=6)


@query(f"with {POST_SQL} select * from v")
def fine_delay_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra turned by fine delay and phase, times gains, quantised."""
    return _corrected(spark, sf_dir)


@query(f"with {POST_SQL} select spectrum // 8 as heap, pol, count(*) filter (clipped) as clipped from v group by 1, 2")
def heap_clip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postprocess.clip_counts(_corrected(spark, sf_dir), 8)


@query(f"with {POST_SQL} select spectrum // 8 as heap, chan, string_agg(cast(re as varchar), ',' order by spectrum, pol) as re, string_agg(cast(im as varchar), ',' order by spectrum, pol) as im from v group by 1, 2 having count(*) = 16")
def corner_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel-major heaps, polarisations interleaved."""
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return postprocess.corner_turn(_corrected(spark, sf_dir), 8).select("heap", "chan", text("re"), text("im"))


@query("""with f as (select distinct event_id // 8 * 8 as t from events), c as (select event_id as start, event_id as version, value as gain from events where event_type = 'signup' and user_id % 3 = 0)
select f.t, c.version, round(c.gain, 6) as gain from f asof left join c on f.t >= c.start""")
def gain_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains in force at each flush: changes count from the next one on."""
    e = table(spark, sf_dir, "events")
    flushes = e.select(F.expr("event_id div 8 * 8").alias("t")).distinct()
    changes = e.where("event_type = 'signup' and user_id % 3 = 0").select(F.col("event_id").alias("start"), F.col("event_id").alias("version"), F.col("value").alias("gain"))
    return postprocess.in_force(flushes, changes, ["version", "gain"]).select("t", F.col("m_version").alias("version"), F.round("m_gain", 6).alias("gain"))


@query("""with k as (select event_id as spectrum from events where value < 95 or event_id % 97 > 40), h as (select spectrum // 4 as heap from k group by 1 having count(*) = 4)
select heap, coalesce(heap - lag(heap) over (order by heap) - 1, 0) as skipped from h""")
def output_heaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole output heaps after gaps, and how many were skipped before each."""
    k = table(spark, sf_dir, "events").where("value < 95 or event_id % 97 > 40").select(F.col("event_id").alias("spectrum"))
    return postprocess.output_heaps(k, 4).select("heap", "skipped")


@query("""with s as (select event_id // 8 as k, bool_and(event_type <> 'error' or value < 90) as ok, event_id // 8 % 2 as dummy from events group by 1),
w as (select k, count(*) over x as n, bool_and(ok) over x as ok from s window x as (order by k rows between current row and 3 following))
select k, n = 4 and ok as valid from w""")
def window_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A spectrum is valid if all samples of its whole FIR window are there, also where the window
    runs on into the next chunk; at the very end the tail is absent."""
    s = table(spark, sf_dir, "events").groupBy(F.expr("event_id div 8").alias("k")).agg(F.bool_and((F.col("event_type") != "error") | (F.col("value") < 90)).alias("present"))
    return timeline.good_counts(s, "k", 3, 64).select("k", (F.col("good") == 4).alias("valid"))


@query("""with x as (select event_id as i, round_even((value - 20) * 8, 0) as x from events), r as (select i // 16 as r, sum(x * x) as power, count(*) as n from x group by 1)
select r - 3 as k, power from r where n = 16 and r >= 3""")
def fir_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Power over the last step of each FIR window."""
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.rint((F.col("value") - 20) * 8).alias("x"))
    return postprocess.last_step_power(x, 4, 16)


COMPLEX_SQL = """z as (select event_id as i, value - 50 as re, user_id / 10.0::double - 5 as im from events),
f as (select i // 16 - t as k, cast(i % 16 as int) as b, sum(cos((t * 16 + i % 16) * (pi() / 64)) * re) as re, sum(cos((t * 16 + i % 16) * (pi() / 64)) * im) as im from z, range(4) r(t) where i // 16 - t >= 0 group by 1, 2 having count(*) = 4),
d as (select k, cast((c + 8) % 16 as int) as chan, sum(re * cos((b * c % 16) * (-2 * pi() / 16)) - im * sin((b * c % 16) * (-2 * pi() / 16))) as re, sum(re * sin((b * c % 16) * (-2 * pi() / 16)) + im * cos((b * c % 16) * (-2 * pi() / 16))) as im from f, range(16) r(c) group by 1, 2 having count(*) = 16)"""


def _complex_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), (F.col("value") - 50).alias("re"), (F.col("user_id") / 10.0 - 5).alias("im"))
    weights = np.cos(np.arange(64) * (math.pi / 64))
    return channelise.complex_spectra(z, weights, 4, 16)


@query(f"with {COMPLEX_SQL} select k, chan, round(re + 0.0, 4) as re, round(im + 0.0, 4) as im from d")
def complex_pfb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter bank of complex samples, channels in order of frequency."""
    return _complex_spectra(spark, sf_dir).select("k", "chan", _tidy("re", 4).alias("re"), _tidy("im", 4).alias("im"))


@query(f"with {COMPLEX_SQL} select k, cast(chan - 4 as int) as chan, round(re + 0.0, 4) as re from d where chan between 4 and 11")
def channel_discard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inner half of the channels."""
    inner = postprocess.inner_channels(_complex_spectra(spark, sf_dir), 8)
    return inner.select("k", F.col("chan").cast("int").alias("chan"), _tidy("re", 4).alias("re"))


@query("""with x as (select event_id as i, round_even((value - 20) * 8, 0) as x from events),
f as (select i // 16 - t as k, cast(i % 16 as int) as b, sum(cos((t * 16 + i % 16) * (pi() / 64)) * x) as y from x, range(4) r(t) where i // 16 - t >= 0 group by 1, 2 having count(*) = 4)
select k, cast(c as int) as chan, round(sum(y * cos((b * c % 16) * (-2 * pi() / 16))) + 0.0, 4) as re, round(sum(y * sin((b * c % 16) * (-2 * pi() / 16))) + 0.0, 4) as im from f, range(8) r(c) group by 1, 2 having count(*) = 16""")
def packed_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter bank and transform over stretches of samples with what overlaps them, a few rows a task."""
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.rint((F.col("value") - 20) * 8).alias("x"))
    return channelise.spectra(x, np.cos(np.arange(64) * (math.pi / 64)), 4, 8).select("k", "chan", _tidy("re", 4).alias("re"), _tidy("im", 4).alias("im"))


@query("""with w as (select i, pow(sin(pi() * i / 127), 2) * (case when (i + 0.5) / 32 - 2 = 0 then 1 else sin(pi() * ((i + 0.5) / 32.0::double - 2)) / (pi() * ((i + 0.5) / 32.0::double - 2)) end) as w from range(128) r(i))
select i, round(w / sqrt((select sum(w * w) from w)) + 0.0, 9) as w from w""")
def pfb_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of a filter bank of 16 channels and 4 taps."""
    w = channelise.pfb_weights(16, 4)
    return spark.createDataFrame([(i, float(x)) for i, x in enumerate(w)], "i long, w double").select("i", _tidy("w", 9).alias("w"))


@query()
def ddc_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equiripple low-pass weights with and without discarded channels."""
    kinds = {"discard": design.ddc_weights_discard(128, 8, 0.005), "no_discard": design.ddc_weights_no_discard(128, 8, 0.6, 0.005)}
    return spark.createDataFrame([(k, i, float(x)) for k, w in kinds.items() for i, x in enumerate(w)], "kind string, tap long, w double")


PROGRAM = "a = cw(0.75, 100.0); nodither(a + 0.375); nodither(multicw(3, 0.25, 0.125, 64.0, 32.0) + delay(comb(0.5, 64.0), 7));"
SIM_SQL = """with j as (select i, (i + 100) % 512 as s from range(2048) r(i)),
v as (select i, 0.75 * cos(2 * pi() * ((s * 100) % 512) / 512) + 0.375 as p0, 0.25 * cos(2 * pi() * ((s * 64) % 512) / 512) + 0.375 * cos(2 * pi() * ((s * 96) % 512) / 512) + 0.5 * cos(2 * pi() * ((s * 128) % 512) / 512) + (case when ((s - 7 + 512) % 512) % 8 = 0 then 0.5 else 0 end) as p1 from j),
q as (select 0 as pol, i, round(p0, 9) as y from v union all select 1, i, round(p1, 9) from v),
x as (select pol, i, cast(round_even(greatest(least(y * 127, 127.0), -127.0), 0) as int) as x from q)"""


def _simulated(spark: SparkSession) -> DataFrame:
    return digitise.sample(spark, dsl.parse(PROGRAM), 100, 512, 2048, 512.0, 8, digits=9)


@query(f"{SIM_SQL} select pol, i // 256 as heap, count(*) filter (abs(x) >= 127) as saturated from x group by 1, 2")
def simulated_saturation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digitise.saturation(_simulated(spark), 256, 8)


@query(f"{SIM_SQL} select pol, i // 256 as heap, string_agg(printf('%02X', (x + 256) % 256), '' order by i) as payload from x group by 1, 2")
def simulated_digitiser(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals turned to timestamp 100, repeated every 512 samples, packed in heaps of 256."""
    return digitise.packed(_simulated(spark), 256, 8).select("pol", "heap", F.hex("payload").alias("payload"))


@query("""with w as (select i, cast(round_even(50 * cos(2 * pi() * 3 * i / 96), 0) as bigint) as x from range(96) r(i))
select event_id as ts, x from events e join w on e.event_id % 96 = w.i where event_type = 'click'""")
def periodic_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window of samples repeated for ever."""
    window = spark.range(96).select(F.col("id").alias("i"), F.rint(50 * F.cos(2 * math.pi * 3 * F.col("id") / 96)).cast("long").alias("x"))
    return digitise.replayed(window, table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").alias("ts")), 96)


LEHMER = "((({h}) * 48271 + {k} % 2147483647 + 11) % 2147483647)"


def dither_sql(seed: int, *keys: str) -> str:
    h = f"cast({seed} as bigint)"
    for k in keys:
        h = LEHMER.format(h=h, k=k)
    for factor in (69621, 40692, 16807):
        h = f"(({h} * {factor} + 12345) % 2147483647)"
    return f"(({h} + 0.5::double) / 2147483647.0::double - 0.5::double)"


@query(f"""select event_id, round({dither_sql(9, 'user_id', 'event_id')}, 9) as d, cast(round_even(event_id + {dither_sql(9, 'user_id', 'event_id')}, 0) as bigint) as whole, round({dither_sql(7 + 3 * 5, 'event_id')}, 9) as other from events""")
def dithered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dither by key: whole numbers survive it, and engines have sequences of their own."""
    e, d = table(spark, sf_dir, "events"), X.dither(F.col("user_id"), F.col("event_id"), seed=9)
    return e.select("event_id", F.round(d, 9).alias("d"), F.rint(F.col("event_id") + d).cast("long").alias("whole"), F.round(X.dither(F.col("event_id"), seed=7 + 3 * 5), 9).alias("other"))


JOINED_SQL = """x as (select event_id as i, round_even((value - 20) * 8, 0) as x from events), w as (select t as tap, b, (t * 8 + b + 1) / 67.3::double as w from range(4) u(t), range(8) v(b)),
f as (select i // 8 - tap as k, cast(b as int) as b, sum(w * x) as y from x join w on i % 8 = b where i // 8 - tap >= 0 group by 1, 2 having count(*) = 4)"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "events").select(F.col("event_id").alias("i"), F.rint((F.col("value") - 20) * 8).alias("x"))
    weights = spark.range(32).select(F.expr("id div 8").alias("tap"), (F.col("id") % 8).cast("int").alias("b"), ((F.col("id") + 1) / 67.3).alias("w"))
    return channelise.fir_joined(x, weights, 4, 8)


@query(f"with {JOINED_SQL} select k, b, round(y + 0.0, 6) as y from f")
def fir_weight_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter whose weights are a table."""
    return _weighted(spark, sf_dir).select("k", "b", _tidy("y").alias("y"))


@query(f"with {JOINED_SQL} select k, cast(c as int) as chan, round(sum(y * cos(b * c * (-2 * pi() / 8))) + 0.0, 4) as re, round(sum(y * sin(b * c * (-2 * pi() / 8))) + 0.0, 4) as im from f, range(4) r(c) group by 1, 2 having count(*) = 8")
def dft_twiddle_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transform whose turns are a table."""
    angle = F.expr("id div 4") * (F.col("id") % 4) * (-2 * math.pi / 8)
    turns = spark.range(32).select(F.expr("cast(id div 4 as int)").alias("b"), (F.col("id") % 4).cast("int").alias("chan"), F.cos(angle).alias("c"), F.sin(angle).alias("s"))
    return channelise.dft_joined(_weighted(spark, sf_dir), turns, 8).select("k", "chan", _tidy("re", 4).alias("re"), _tidy("im", 4).alias("im"))
