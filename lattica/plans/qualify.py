"""Queries of qualification and of control: figures of merit, trials, sensors, texts and requests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..control import parsers, requests
from ..functions import exprs as X
from ..operators import postprocess, quality, timeline
from ..sinks import tables as sinks
from .base import query, table


def _e(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query("""with t as (select user_id % 20 + 100.5::double as rate, event_id % 3 as missing, event_type = 'signup' as throttled, value from events)
select rate, count(*) filter (not throttled and missing = 0) as successes, count(*) as trials, count(*) filter (throttled) as throttled, round(median(value), 6) as median from t group by 1""")
def trial_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select((F.col("user_id") % 20 + 100.5).alias("rate"), (F.col("event_id") % 3).alias("missing"), (F.col("event_type") == "signup").alias("throttled"), "value")
    return quality.trials(rows).withColumn("median", F.round("median", 6))


@query("""with l as (select event_id as chan, value as power from events), h as (select event_id as chan, value * 16 as power from events where user_id % 5 <> 0)
select l.chan, round(case when h.power <= 800 then h.power / 16 else l.power end, 6) as power from l left join h on l.chan = h.chan""")
def dynamic_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra of two gain steps merged into one."""
    low = _e(spark, sf_dir).select(F.col("event_id").alias("chan"), F.col("value").alias("power"))
    high = _e(spark, sf_dir).where("user_id % 5 <> 0").select(F.col("event_id").alias("chan"), (F.col("value") * 16).alias("power"))
    return quality.merged_dynamic_range(low, high, 16.0, 800.0).select("chan", F.round("power", 6).alias("power"))


@query("""with r as (select user_id % 8 as run, event_id % 100 as chan, (value - 50) / 100 as error from events)
select run, round(max(abs(error)), 6) as worst, round(sqrt(avg(error * error)), 6) as rms from r where chan between 10 and 89 group by 1""")
def phase_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select((F.col("user_id") % 8).alias("run"), (F.col("event_id") % 100).alias("chan"), ((F.col("value") - 50) / 100).alias("error"))
    return quality.phase_errors(rows, ["run"], 10, 89).select("run", F.round("worst", 6).alias("worst"), F.round("rms", 6).alias("rms"))


@query("""with r as (select event_id // 50 as run, event_id % 50 as x, value - 60 as db from events), w as (select *, lag(x) over v as px, lag(db) over v as pdb from r window v as (partition by run order by x))
select run, round(min(case when pdb < -20 and db >= -20 then px + (-20 - pdb) / (db - pdb) * (x - px) end), 6) as low, round(max(case when pdb >= -20 and db < -20 then px + (-20 - pdb) / (db - pdb) * (x - px) end), 6) as high from w group by 1""")
def cut_off_bandwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _e(spark, sf_dir).select(F.expr("event_id div 50").alias("run"), (F.col("event_id") % 50).alias("x"), (F.col("value") - 60).alias("db"))
    return quality.cut_off(r, ["run"], -20.0).select("run", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@query("""with t as (select event_id // 200 as baseline, sum(value) as total from events group by 1) select baseline, round(total, 4) as total, abs(total - 10000) <= 0.01 * 10000 as ok from t""")
def power_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select(F.expr("event_id div 200").alias("baseline"), F.col("value").alias("power"))
    return quality.total_power(rows, ["baseline"], F.lit(10000.0)).select("baseline", F.round("total", 4).alias("total"), "ok")


@query("""select user_id % 4 as pol, round(max(case when user_id % 11 <> 0 then abs(value - user_id % 11 * 10) / (user_id % 11 * 10) end), 6) as worst from events group by 1""")
def gain_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select((F.col("user_id") % 4).alias("pol"), F.col("value").alias("measured"), (F.col("user_id") % 11 * 10.0).alias("wanted"))
    return quality.gain_error(rows, ["pol"]).select("pol", F.round("worst", 6).alias("worst"))


@query("""with s as (select user_id % 3 as beam, event_id % 7 as step, sum((value * value) + (user_id * user_id)) as power from events group by 1, 2) select s.beam, s.step, round(s.power / m.power, 6) as power from s join s m on s.beam = m.beam and m.step = 3""")
def beam_linearity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).select((F.col("user_id") % 3).alias("beam"), (F.col("event_id") % 7).alias("step"), F.col("value").alias("re"), F.col("user_id").cast("double").alias("im"))
    return quality.linearity(rows, "step").select("beam", "step", F.round("power", 6).alias("power"))


@query("select round(corr(value, value), 6) as value, round(corr(user_id, value), 6) as user_id, round(corr(event_id, value), 6) as event_id from events")
def column_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = quality.correlations(_e(spark, sf_dir), ["value", "user_id", "event_id"], "value")
    return r.select(*(F.round(c, 6).alias(c) for c in r.columns))


@query("""with r as (select event_id // 8 as acc, case when event_type = 'error' and value > 100 then -2147483648 else cast(round_even(value, 0) as bigint) end as re from events where user_id % 60 <> 3)
select acc from r group by 1 having count(*) = 8 and min(re) > -2147483648""")
def complete_accumulations(spark: SparkSession, sf_dir: str) -> DataFrame:
    re = F.when((F.col("event_type") == "error") & (F.col("value") > 100), F.lit(-(2**31))).otherwise(F.rint("value").cast("long"))
    rows = _e(spark, sf_dir).where("user_id % 60 <> 3").select(F.expr("event_id div 8").alias("acc"), re.alias("re"))
    return quality.complete(rows, ["acc"], 8)


@query("""with t as (select event_id * 16 as ts from events where event_type <> 'error'), g as (select ts, ts - row_number() over (order by ts) * 16 as island from t)
select min(ts) as first, count(*) as n from g group by island having count(*) >= 5""")
def consecutive_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _e(spark, sf_dir).where("event_type <> 'error'").select((F.col("event_id") * 16).alias("ts"))
    return quality.consecutive(rows, "ts", 16, 5)


@query("select event_id as ts, round(value, 6) as value from events where event_type = 'click' and event_id > 100 order by event_id limit 10")
def first_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten whole chunks after a time: what a test waits for."""
    rows = _e(spark, sf_dir).where("event_type = 'click'").select(F.col("event_id").alias("ts"), F.round("value", 6).alias("value"))
    return quality.first_complete(rows, "ts", 100, 10)


@query("select event_id, round(sqrt(value * value + user_id * user_id) / 2.5, 6) as gain from events")
def tone_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _e(spark, sf_dir).select("event_id", F.round(postprocess.tone_gain(F.col("value"), F.col("user_id").cast("double"), F.lit(2.5)), 6).alias("gain"))


@query()
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logistic fit of success on log(rate), from sums by rate."""
    rows = _e(spark, sf_dir).select((F.col("user_id") % 20 + 100.0).alias("rate"), (F.col("value") > F.col("user_id") % 20 * 5).cast("long").alias("ok"))
    sums = rows.groupBy("rate").agg(F.sum("ok").alias("s"), F.count("ok").alias("n")).toPandas()  # a row a rate
    a, b = quality.logistic(sums["rate"].to_numpy(), sums["s"].to_numpy(float), sums["n"].to_numpy(float))
    return spark.createDataFrame([(a, b, float(np.exp(-a / b)))], "intercept double, slope double, critical_rate double")


@query()
def rate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The critical rate among 64 candidates by comparisons that are wrong one time in ten."""
    truth, rnd = 41, np.random.default_rng(3)
    found = quality.noisy_search(64, 0.1, 0.01, lambda i, k: bool((truth <= i) ^ (rnd.random() < 0.1)))
    return spark.createDataFrame([(found.low, found.high, found.comparisons, found.confidence)], "low long, high long, comparisons long, confidence double")


@query("""with i as (select event_id * 4 as start, event_id * 4 + (case when user_id % 50 = 0 then 3 else 4 end) as stop, case when event_type <> 'error' or value > 20 then cast(round_even(value, 0) as bigint) end as value from events)
select start // 16 as win, cast(case when sum(stop - start) = 16 and count(value) = count(*) then sum(value) end as bigint) as total from i group by 1""")
def interval_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements over intervals summed by window, null where any is missing."""
    i = _e(spark, sf_dir).select((F.col("event_id") * 4).alias("start"), (F.col("event_id") * 4 + F.when(F.col("user_id") % 50 == 0, 3).otherwise(4)).alias("stop"), F.when((F.col("event_type") != "error") | (F.col("value") > 20), F.rint("value").cast("long")).alias("value"))
    return timeline.accumulate_intervals(i, 16).withColumnRenamed("window", "win")


@query("""with i as (select event_id as number, event_id * 4 - (case when user_id % 31 = 0 then 2 else 0 end) as start, event_id * 4 + (case user_id % 37 when 1 then -9 when 2 then 9 else 4 end) as stop from events),
b as (select *, max(stop) over (order by number rows between unbounded preceding and 1 preceding) as before from i),
e as (select number, start, stop, case when start > stop then 'reversed' when stop > (cast(floor(start / 16) as bigint) + 1) * 16 then 'crosses a window' when start < coalesce(before, 0) then 'overlaps' end as error from b)
select * from e where error is not null""")
def interval_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals that an accumulator refuses."""
    u = F.col("user_id")
    i = _e(spark, sf_dir).select(F.col("event_id").alias("number"), (F.col("event_id") * 4 - F.when(u % 31 == 0, 2).otherwise(0)).alias("start"), (F.col("event_id") * 4 + F.when(u % 37 == 1, -9).when(u % 37 == 2, 9).otherwise(4)).alias("stop"))
    return timeline.interval_errors(i, 16)


# -- scalar functions by themselves


@query("""select event_id, round(((value * 3 + pi()) - floor((value * 3 + pi()) / (2 * pi())) * 2 * pi()) - pi() + 0.0, 6) as wrapped, round(-pi() / 64 * (event_id % 64 - 32.0) * (value / 100) + 0.5 + 0.0, 6) as slope,
 round(value * cos(user_id * 0.1) - user_id * sin(user_id * 0.1) + 0.0, 6) as turned_re, round(value * sin(user_id * 0.1) + user_id * cos(user_id * 0.1) + 0.0, 6) as turned_im,
 round((event_id % 64 - 32) * (856e6 / 64) + 1284e6, 4) as frequency, (event_id + 32) % 64 as shifted, (event_id + 32) % 64 >= 16 and (event_id + 32) % 64 < 48 as valid,
 round(cos(pi() * (event_id % 64) * user_id / 100) + 0.0, 6) as beam_re, round(sin(pi() * (event_id % 64) * user_id / 100) + 0.0, 6) as beam_im from events""")
def phase_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wrapped angles, slopes over channels, rotations, channel frequencies and numbers."""
    chan = F.col("event_id") % 64
    re, im = X.rotate((F.col("value"), F.col("user_id").cast("double")), F.col("user_id") * 0.1)
    shifted = X.fft_shift(chan, 64)
    b_re, b_im = X.beam_phase(chan, F.col("user_id") / 100)
    tidy = lambda c, d=6: F.round(c + 0.0, d)
    return _e(spark, sf_dir).select(
        "event_id", tidy(X.wrap_angle(F.col("value") * 3)).alias("wrapped"), tidy(X.phase_slope(chan, 64, F.col("value") / 100, F.lit(0.5))).alias("slope"), tidy(re).alias("turned_re"), tidy(im).alias("turned_im"),
        tidy(X.channel_frequency(chan, 64, 856e6, 1284e6), 4).alias("frequency"), shifted.alias("shifted"), X.valid_channel(shifted, 16, 32).alias("valid"), tidy(b_re).alias("beam_re"), tidy(b_im).alias("beam_im"),
    )


@query("""select event_id, cast(round_even((1000 + event_id * 0.001::double - 999.5::double) * 1712.0::double, 0) as bigint) as ticks, round(event_id / 1712.0 + 999.5, 6) as unix, (event_id + 15) // 16 as up, (event_id + 15) // 16 * 16 as rounded, event_id - event_id % 64 as masked,
 user_id % 2 as pol, event_id % 7 as saturated, (event_id % 7) * 4294967296 + (case when event_id % 7 > 0 then 2 else 0 end) as status, (event_id // 8) * 16 + event_id % 16 as flat from events""")
def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of the clock and of the digitiser, rounding up, masks, status words."""
    status = X.status_word(F.col("event_id") % 7)
    return _e(spark, sf_dir).select(
        "event_id", X.unix_to_adc(F.lit(1000) + F.col("event_id") * 0.001, 999.5, 1712.0).alias("ticks"), F.round(X.adc_to_unix(F.col("event_id"), 999.5, 1712.0), 6).alias("unix"), X.div_up(F.col("event_id"), 16).alias("up"), X.round_up(F.col("event_id"), 16).alias("rounded"), X.mask_timestamp(F.col("event_id"), 64).alias("masked"),
        X.status_pol(F.col("user_id")).alias("pol"), X.status_saturation(status).alias("saturated"), status.alias("status"), X.flat_time(F.expr("event_id div 8"), 16, F.col("event_id") % 16).alias("flat"),
    )


@query("""select case user_id % 3 when 0 then 'ok' when 1 then 'error' else 'ins' end as state, case user_id % 3 when 0 then 'nominal' when 1 then 'error' else 'warn' end as state_status, case when value < 30 then 'nominal' when value < 90 then 'warn' else 'error' end as error_status, count(*) as n from events group by 1, 2, 3""")
def clock_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("user_id") % 3 == 0, "ok").when(F.col("user_id") % 3 == 1, "error").otherwise("ins")
    a, b = X.clock_status(F.col("state"), F.col("value"), 30.0, 90.0)
    return _e(spark, sf_dir).withColumn("state", state).groupBy("state", a.alias("state_status"), b.alias("error_status")).agg(F.count(F.lit(1)).alias("n"))


# -- texts


@query("""with t as (select event_id, case user_id % 4 when 0 then cast(value as varchar) || '+' || cast(user_id as varchar) || '.5j' when 1 then cast(value as varchar) when 2 then '-' || cast(user_id as varchar) || 'j' else 'no number' end as text, user_id % 4 as kind, value, user_id from events)
select event_id, case kind when 0 then value when 1 then value when 2 then 0.0 end as re, case kind when 0 then user_id + 0.5::double when 1 then 0.0 when 2 then -user_id::double end as im from t""")
def gain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, v, u = F.col("user_id") % 4, F.col("value").cast("string"), F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(v, F.lit("+"), u, F.lit(".5j"))).when(k == 1, v).when(k == 2, F.concat(F.lit("-"), u, F.lit("j"))).otherwise("no number")
    re, im = parsers.complex_columns(F.col("text"))
    return _e(spark, sf_dir).withColumn("text", text).select("event_id", re.alias("re"), im.alias("im"))


@query("""select event_id, case when user_id % 9 > 0 then value end as delay, case when user_id % 9 > 0 then 0.001::double end as delay_rate, case when user_id % 9 > 0 then user_id::double end as phase, case when user_id % 9 > 0 then -0.5::double end as phase_rate, value as beam_delay, user_id::double as beam_phase from events""")
def delay_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, u = F.col("value").cast("string"), F.col("user_id").cast("string")
    text = F.when(F.col("user_id") % 9 > 0, F.concat(v, F.lit(",0.001:"), u, F.lit(",-0.5"))).otherwise(F.concat(v, F.lit(":"), u))
    d, dr, p, pr = parsers.delay_columns(F.col("text"))
    bd, bp = parsers.beam_delay_columns(F.concat(v, F.lit(":"), u))
    return _e(spark, sf_dir).withColumn("text", text).select("event_id", d.alias("delay"), dr.alias("delay_rate"), p.alias("phase"), pr.alias("phase_rate"), bd.alias("beam_delay"), bp.alias("beam_phase"))


@query("""select event_id, case user_id % 5 when 1 then 'unknown key' when 2 then 'key twice' when 3 then 'missing =' end as error, case when user_id % 5 in (0, 4) then event_type end as name, case when user_id % 5 = 0 then cast(user_id as varchar) end as taps from events""")
def option_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u, t = F.col("user_id") % 5, F.col("user_id").cast("string"), F.col("event_type")
    text = F.when(k == 0, F.concat(F.lit("name="), t, F.lit(",taps="), u)).when(k == 1, F.lit("name=a,tops=3")).when(k == 2, F.lit("name=a,name=b")).when(k == 3, F.lit("name=a,taps")).otherwise(F.concat(F.lit("name="), t))
    values, error = parsers.field_columns(F.col("text"), ["name", "taps"])
    return _e(spark, sf_dir).withColumn("text", text).select("event_id", error.alias("error"), values["name"].alias("name"), values["taps"].alias("taps"))


@query("""select event_id, case user_id % 4 when 0 then user_id + 1.5::double + 2 when 1 then user_id * 2.0::double end as total from events""")
def list_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two values, or one for both; other counts and what isn't a number give null."""
    k, u = F.col("user_id") % 4, F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(u, F.lit(",3.5"))).when(k == 1, u).when(k == 2, F.concat(u, F.lit(",1,2"))).otherwise(F.concat(u, F.lit(",x")))
    both = parsers.comma_columns(F.col("text"), 2, single=True)
    return _e(spark, sf_dir).withColumn("text", text).select("event_id", F.aggregate(both, F.lit(0.0), lambda a, x: a + x).alias("total"))


@query("select event_type as name, count(*) as uses from events group by 1 having count(*) > 1")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that more than one output would have."""
    return _e(spark, sf_dir).groupBy(F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("uses")).where("uses > 1")


# -- sensors and requests


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", "warn").otherwise("nominal")
    return _e(spark, sf_dir).select(F.concat(F.lit("sensor"), (F.col("user_id") % 10).cast("string")).alias("name"), F.col("event_id").alias("ts"), status.alias("status"), F.round("value", 6).alias("value"))


READ_SQL = "r as (select 'sensor' || cast(user_id % 10 as varchar) as name, event_id as ts, case event_type when 'error' then 'error' when 'signup' then 'warn' else 'nominal' end as status, round(value, 6) as value from events)"


@query(f"with {READ_SQL} select name, max(ts) as ts, max_by(status, ts) as status, max_by(value, ts) as value from r group by 1")
def latest_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.latest(_readings(spark, sf_dir))


@query(f"with {READ_SQL}, l as (select name, max_by(status, ts) as status from r group by 1) select case when bool_or(status in ('warn', 'error')) then 'degraded' else 'ok' end as device_status from l")
def device_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.device_status(_readings(spark, sf_dir))


@query(f"""with {READ_SQL}, n as (select *, lead(ts) over (partition by name order by ts) as nxt from r), m as (select max(ts) as until from r)
select name, ts, status, value from r union all select name, ts + 20, 'error', value from n, m where status <> 'error' and coalesce(nxt, until + 1) - ts > 20 and ts + 20 <= until""")
def sensor_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sensors that hear nothing for 20 ticks turn to error."""
    r = _readings(spark, sf_dir)
    return requests.timed_out(r, 20, "error", r.agg(F.max("ts").alias("m")).first()["m"])


@query("""with c as (select user_id % 6 as stream, event_id as "at", event_id * 3 + 50 as value from events) select stream, "at", value, value - coalesce(lag(value) over (partition by stream order by "at"), value) as delta from c""")
def counter_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth of counters since their stream was registered."""
    return requests.deltas(_e(spark, sf_dir).select((F.col("user_id") % 6).alias("stream"), F.col("event_id").alias("at"), (F.col("event_id") * 3 + 50).alias("value")))


@query("""select event_id as number, event_id * 7 as "at", cast(max((event_id * 7 // 64 + 1) * 64) over (order by event_id) as bigint) as steady from events where event_type = 'signup'""")
def steady_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which timestamp on each request and all before it show."""
    r = _e(spark, sf_dir).where("event_type = 'signup'").select(F.col("event_id").alias("number"), (F.col("event_id") * 7).alias("at"))
    return requests.steady(r, 64)


CAPTURE = [(0, 100, "capture-start", "s1", "0"), (1, 300, "capture-stop", "s1", "0"), (2, 350, "capture-start", "s0", "400"), (3, 500, "capture-start", "s1", "650")]


@query("""with q as (select * from (values ('s1', 100, 300), ('s0', 400, 1000000000), ('s1', 650, 1000000000)) t(stream, since, until)), e as (select event_id as ts, 's' || cast(user_id % 3 as varchar) as stream from events)
select ts, e.stream from e join q on e.stream = q.stream and ts >= since and ts < until""")
def captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows inside capture sessions of their stream."""
    rows = _e(spark, sf_dir).select(F.col("event_id").alias("ts"), F.concat(F.lit("s"), (F.col("user_id") % 3).cast("string")).alias("stream"))
    return requests.captured(rows, "ts", requests.sessions(spark.createDataFrame(CAPTURE, requests.REQUEST)), "stream")


@query("""with e as (select user_id % 2 as pol, event_id // 100 as heap, round_even((value - 20) * 8, 0) as x, event_type = 'error' as clipped from events), h as (select pol, heap, cast(sum(case when abs(x) >= 511 then 1 else 0 end) as bigint) as dig, sum(least(greatest(x, -511), 511) ^ 2) as total, count(*) as n, count(*) filter (clipped) as feng from e group by 1, 2)
select pol, cast(sum(dig) as bigint) as dig_clip, cast(sum(feng) as bigint) as feng_clip, round(10 * log10(max_by(total, heap) / max_by(n, heap) / (511.0::double * 511 / 2)), 6) as rms_dbfs from h group by 1""")
def channeliser_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clip counts so far and the power of the last heap of each polarisation."""
    x = F.rint((F.col("value") - 20) * 8)
    e = _e(spark, sf_dir).select((F.col("user_id") % 2).alias("pol"), F.expr("event_id div 100").alias("heap"), x.alias("x"), (F.col("event_type") == "error").alias("clipped"))
    kept = X.clamp(F.col("x"), 511.0)
    h = e.groupBy("pol", "heap").agg(F.count_if(X.at_limit(F.col("x"), 10)).alias("dig"), F.sum(kept * kept).alias("total"), F.count(F.lit(1)).alias("n"), F.count_if("clipped").alias("feng"))
    last = F.max_by(F.struct("total", "n"), F.col("heap"))
    return h.groupBy("pol").agg(F.sum("dig").alias("dig_clip"), F.sum("feng").alias("feng_clip"), last.alias("l")).select("pol", "dig_clip", "feng_clip", F.round(X.dbfs(F.col("l.total"), F.col("l.n"), 10), 6).alias("rms_dbfs"))


@query("select * from (values ('signals', 'cw(0.5, 100.0);'), ('period', '4096'), ('max-period', '1048576'), ('sample-bits', '10'), ('adc-sample-rate', '1712000000.0'), ('sync-time', '1000.5'), ('dither-seed', '7')) t(name, value)")
def simulator_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run of the digitiser simulator is made from."""
    from ..signal import dsl

    run = {"signals": dsl.render(dsl.parse("a = 0.5; cw(0.5, 100);")), "period": 4096, "max-period": 1 << 20, "sample-bits": 10, "adc-sample-rate": 1712e6, "sync-time": 1000.5, "dither-seed": 7}
    return spark.createDataFrame([(k, str(v)) for k, v in run.items()], "name string, value string")


@query("""with a as (select event_id // 2 as ts, event_id % 2 as ant, user_id % 11 as x, user_id % 4 as chan from events), p as (select one.ts, one.x as a, two.x as b from a one join a two on one.ts = two.ts and one.ant = 0 and two.ant = 1)
select count(*) as compared, count(*) filter (a <> b) as different from p""")
def streams_compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two antennas' streams compared value by value; what only one has is different too."""
    a = _e(spark, sf_dir).select(F.expr("event_id div 2").alias("ts"), (F.col("event_id") % 2).alias("ant"), (F.col("user_id") % 11).alias("x"))
    one, two = a.where("ant = 0").select("ts", F.col("x").alias("a")), a.where("ant = 1").select("ts", F.col("x").alias("b"))
    return one.join(two, "ts", "full").agg(F.count(F.lit(1)).alias("compared"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different"))


@query("""with e as (select event_id // 4 as ts, event_id % 4 * 8 as frequency, value from events) select ts, string_agg(cast(frequency as varchar), ',' order by frequency) as blocks, count(*) * 8 as channels from e group by 1""")
def channel_concatenation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of channels from several engines put together in order of frequency."""
    parts = [_e(spark, sf_dir).where(F.col("event_id") % 4 == k).select(F.expr("event_id div 4").alias("ts"), F.lit(8 * k).alias("frequency")) for k in range(4)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    whole = every.groupBy("ts").agg(F.sort_array(F.collect_list("frequency")).alias("f"))
    return whole.select("ts", F.array_join(F.transform("f", lambda x: x.cast("string")), ",").alias("blocks"), (F.size("f") * 8).cast("long").alias("channels"))


@query("""with e as (select event_id // 2 as t, event_id % 2 as pol, cast(round_even(value, 0) as bigint) as x from events) select t, max(case when pol = 0 then x end) as pol0, max(case when pol = 1 then x end) as pol1 from e group by 1 having count(*) = 2""")
def interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of two polarisations side by side."""
    e = _e(spark, sf_dir).select(F.expr("event_id div 2").alias("t"), (F.col("event_id") % 2).alias("pol"), F.rint("value").cast("long").alias("x"))
    return e.groupBy("t").agg(F.max(F.when(F.col("pol") == 0, F.col("x"))).alias("pol0"), F.max(F.when(F.col("pol") == 1, F.col("x"))).alias("pol1"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n")


@query("""select (i - 37 + 500) % 500 as shifted, i, k as copy, 500 * k + i as tiled from range(500) a(i), range(3) b(k)""")
def rolled_and_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window shifted in a circle and repeated."""
    return spark.range(1500).select(F.pmod(F.col("id") % 500 - 37, F.lit(500)).alias("shifted"), (F.col("id") % 500).alias("i"), F.expr("id div 500").alias("copy"), F.col("id").alias("tiled"))
