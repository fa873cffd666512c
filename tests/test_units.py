"""Parts of the signal engine on small inputs: against plain versions, at limits, on odd rows."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.control import parsers, requests
from lattica.functions import exprs as X
from lattica.operators import channelise, correlate, delay, design, quality, recorder, timeline
from lattica.signal import digitise, dsl
from lattica.sources import heaps as H
from lattica.streaming import accumulate, session, stateful


def values(df):
    return [tuple(r) for r in df.collect()]


# -- signal language


@pytest.mark.parametrize(
    "text, expected",
    [
        ("cw(1, 2.0);", [dsl.CW(1.0, 2.0)]),
        ("cw(1.5, 2.5); cw(3.0, 2.0);", [dsl.CW(1.5, 2.5), dsl.CW(3.0, 2.0)]),
        ("multicw(5, 0.2, 0.1, 0.3, 0.4);", [dsl.MultiCW(5, 0.2, 0.1, 0.3, 0.4)]),
        ("comb(1.0, 2);", [dsl.Comb(1.0, 2.0)]),
        ("c = wgn(1.5, 12345); c; c;", [dsl.WGN(1.5, 12345)] * 2),
        ("c = cw(1.5, +2.5e0); c + cw(1, 2);", [dsl.Combined("+", dsl.CW(1.5, 2.5), dsl.CW(1.0, 2.0))]),
        ("cw(1, 2) - cw(3, 4) * cw(5, 6);", [dsl.Combined("-", dsl.CW(1.0, 2.0), dsl.Combined("*", dsl.CW(3.0, 4.0), dsl.CW(5.0, 6.0)))]),
        ("cw(1, 2) + 0.25;", [dsl.Combined("+", dsl.CW(1.0, 2.0), dsl.Constant(0.25))]),
        ("delay(1, -123);", [dsl.Delay(dsl.Constant(1.0), -123)]),
        ("x = nodither(1); x; x;", [dsl.NoDither(dsl.Constant(1.0))] * 2),
    ],
)
def test_programs(text, expected):
    found = dsl.parse(text)
    assert found == expected and dsl.parse(dsl.render(found)) == found


@pytest.mark.parametrize("text", ["", "cw(1, 2) +", "a = cw(1, 2)", "foo;", "cw(1, foo);", "nodither(1) + 0;", "x = nodither(1); x + 0;", "delay(nodither(1), 1);", "nodither(nodither(1));", "multicw(2.5, 1, 1, 1, 1);", "wgn(1, 0.5);", "delay(1, 1.5);", "cw(1);", "a = 1;"])
def test_programs_that_are_refused(text):
    with pytest.raises(dsl.SignalError):
        dsl.parse(text)


def test_noise_without_entropy_is_its_own(spark):
    a, b, c = dsl.parse("n = wgn(1); n; n; wgn(1);")
    assert a.entropy == b.entropy != c.entropy
    got = spark.range(4000).select(a.column(F.col("id"), 4000, 1.0).alias("a"), c.column(F.col("id"), 4000, 1.0).alias("c")).toPandas()
    assert abs(got["a"].std() - 1) < 0.05 and abs(got["a"].corr(got["c"])) < 0.06


def test_samples_turn_repeat_and_survive_packing(spark):
    one = dsl.parse("nodither(cw(0.5, 4));")
    at0 = [r["x"] for r in digitise.sample(spark, one, 0, 64, 64, 64.0, 10).orderBy("i").collect()]
    at5 = [r["x"] for r in digitise.sample(spark, one, 5, 64, 128, 64.0, 10).orderBy("i").collect()]
    assert at5 == [at0[(i + 5) % 64] for i in range(128)] and max(at0) == round(0.5 * 511)
    packed = digitise.packed(digitise.sample(spark, one, 0, None, 64, 64.0, 10), 32, 10)
    got = {r["heap"]: r["x"] for r in packed.select("heap", X.unpack_bits(F.col("payload"), 10).alias("x")).collect()}
    assert got[0] + got[1] == at0
    with pytest.raises(ValueError):
        digitise.sample(spark, one, 0, 48, 64, 64.0, 10)


# -- scalars


def test_quantise_at_limits(spark):
    x = [float("nan"), float("inf"), -1e9, 127.4, 127.6, -127.5, 0.5, 1.5, -0.5, None]
    got = values(spark.createDataFrame([(v,) for v in x], "x double").select(X.quantise(F.col("x")), X.saturated(F.col("x"))))
    assert got == [(-127, True), (127, True), (-127, True), (127, True), (127, True), (-127, True), (0, False), (2, False), (0, False), (None, None)]


@pytest.mark.parametrize("bits", [2, 3, 4, 7, 8, 10, 12, 16])
def test_bits_round_trip(spark, bits):
    rnd = random.Random(bits)
    most = 2 ** (bits - 1)
    x = [rnd.randrange(-most, most) for _ in range(32)]
    df = spark.createDataFrame([(x,), ([],)], "x array<int>")
    assert [r[0] for r in df.select(X.unpack_bits(X.pack_bits(F.col("x"), bits), bits)).collect()] == [x, []]


def test_dither_is_uniform_and_spares_whole_numbers(spark):
    d = spark.range(20000).select(X.dither(F.col("id"), F.lit(3), seed=5).alias("d"), F.rint(F.col("id") + X.dither(F.col("id"), seed=1)).cast("long").alias("w"), "id").toPandas()
    assert d["d"].between(-0.5, 0.5, inclusive="neither").all() and abs(d["d"].mean()) < 0.01 and abs(d["d"].std() - math.sqrt(1 / 12)) < 0.005 and (d["w"] == d["id"]).all()


# -- time line


def test_running_values_equal_plain_ones(spark):
    rnd = random.Random(2)
    rows = [(rnd.randrange(2), i, rnd.choice([None, rnd.randrange(-50, 50)])) for i in sorted(rnd.sample(range(2000), 300))]
    got = timeline.running(spark.createDataFrame(rows, "p long, t long, v long"), ["t"], {"m": ("max", F.col("v")), "l": ("min", F.col("v")), "s": ("sum", F.col("v")), "z": ("last", F.col("v"))}, 8, ["p"])
    found = {(r["p"], r["t"]): (r["m"], r["l"], r["s"], r["z"]) for r in got.collect()}
    for p in (0, 1):
        seen = []
        for q, t, v in rows:
            if q == p:
                seen += [] if v is None else [v]
                assert found[p, t] == (max(seen, default=None), min(seen, default=None), sum(seen), seen[-1] if seen else None)


def test_gaps_runs_and_empty_tables(spark):
    none = spark.createDataFrame([], "t long, v long, p long")
    assert timeline.gaps(none, "t", 1).count() == timeline.runs(none, "v", ["p"], "t").count() == timeline.accumulate(none.withColumnRenamed("v", "value"), 4).count() == 0
    one = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (9, None, 0), (4100, None, 0), (9000, 1, 0)], "t long, v long, p long")
    assert sorted(r["skipped"] for r in timeline.gaps(one, "t", 1).collect()) == [0, 0, 2, 4090, 4899]
    assert sorted((r["first"], r["last"], r["v"]) for r in timeline.runs(one, "v", ["p"], "t").collect()) == [(5, 6, 1), (9, 4100, None), (9000, 9000, 1)]


def test_counts_cross_block_seams(spark):
    rows = spark.range(4096).select(F.col("id").alias("t"), F.lit(True).alias("present"))
    bad = timeline.good_counts(rows, "t", 7, 64).where("good < 8")
    assert sorted(r["t"] for r in bad.collect()) == list(range(4089, 4096))


# -- delays


def test_models_delete_later_ones(spark):
    rnd = random.Random(4)
    models = delay.Models()
    for _ in range(40):
        models.add(delay.Linear(rnd.randrange(0, 3000), rnd.uniform(-50, 50), rnd.uniform(-0.1, 0.1), rnd.uniform(-9, 9), rnd.uniform(-0.01, 0.01)))
    got = {r["t"]: r for r in models.range(spark, 0, 4000, 13).collect()}
    known = models.known()
    for t in range(0, 4000, 13):
        m = [k for k in known if k.start <= t][-1]
        d = m.delay + (t - m.start) * m.delay_rate
        assert got[t]["input"] == t - round(d) and got[t]["fine"] == pytest.approx(d - round(d)) and -math.pi <= got[t]["phase"] < math.pi
        assert math.cos(got[t]["phase"]) == pytest.approx(math.cos((t - m.start) * m.phase_rate + m.phase))
    for target in range(0, 3900, 97):
        t = models.skip(target, 0, 16)
        assert t % 16 == 0 and t - round_delay(known, t) >= target


def round_delay(known, t):
    m = [k for k in known if k.start <= t][-1]
    return round(m.delay + (t - m.start) * m.delay_rate)


@pytest.mark.parametrize("align", [1, 4, 5])
def test_aligned_inputs(spark, align):
    base = delay.Linear(0, 3.3, 0.01)
    rows = delay.Aligned(base, align).range(spark, 0, 400, 7).collect()
    for r in rows:
        assert r["input"] % align == 0 and abs(r["fine"]) <= align / 2 + 0.5
        assert r["t"] - r["input"] + r["fine"] == pytest.approx(3.3 + 0.01 * r["t"])
    with pytest.raises(ValueError):
        delay.Linear(0, 0, 1.0)


# -- filters and transforms


def test_filters_are_equiripple():
    for taps, s in ((64, 4), (63, 4), (128, 8)):
        w = design.ddc_weights_no_discard(taps, s, 0.6, 0.005) / np.sqrt(s)
        f = np.linspace(0, s / 2, 2001)
        gain = np.abs(np.exp(-2j * np.pi * np.outer(f / s, np.arange(taps))) @ w)
        ripple, stop = np.abs(gain[f <= 0.3] - 1).max(), gain[f >= 0.7].max()
        assert np.allclose(w, w[::-1]) and stop == pytest.approx(0.005 * ripple, rel=0.02) and ripple < 2e-4


def test_packed_spectra_equal_numpy_over_seams(spark, monkeypatch):
    monkeypatch.setattr(channelise, "STRETCH", 128)
    rng = np.random.default_rng(1)
    x, w = rng.normal(size=1000), rng.normal(size=64)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x) if i != 700], "i long, x double")
    got = {(r["k"], r["chan"]): complex(r["re"], r["im"]) for r in channelise.spectra(df, w, 4, 8).collect()}
    grid = x[: 1000 // 16 * 16].reshape(-1, 16)
    want = {}
    for k in range(len(grid) - 3):
        if not k <= 700 // 16 < k + 4:
            z = np.fft.rfft(sum(w[16 * t : 16 * t + 16] * grid[k + t] for t in range(4)))
            want |= {(k, c): z[c] for c in range(8)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_sidebands_separate_tones(spark):
    n = np.arange(4000)
    z = np.exp(2j * np.pi * 0.15 * n) + 0.5 * np.exp(-2j * np.pi * 0.1 * n)
    df = spark.createDataFrame([(int(i), float(v.real), float(v.imag)) for i, v in zip(n, z, strict=True)], "i long, re double, im double")
    out = recorder.sidebands(df, 3, 4).orderBy("n").toPandas()
    assert len(out) > 2900 and (out["n"].diff().dropna() == 1).all()
    power = {s: np.abs(np.fft.rfft(out[s].to_numpy()[:2048] * np.hanning(2048))) for s in ("usb", "lsb")}
    assert abs(power["usb"].argmax() / 2048 - 0.15 * 4 / 3) < 0.002 and abs(power["lsb"].argmax() / 2048 - 0.1 * 4 / 3) < 0.002
    near = slice(int(0.1 * 4 / 3 * 2048) - 4, int(0.1 * 4 / 3 * 2048) + 5)
    assert power["usb"][near].max() < 0.02 * power["lsb"].max()


# -- correlation


def test_products_equal_plain_sums_and_saturate(spark):
    rng = np.random.default_rng(3)
    v = rng.integers(-30000, 30000, (40, 3, 2, 2, 2))
    rows = [(t, a, c, p, int(v[t, a, c, p, 0]), int(v[t, a, c, p, 1])) for t in range(40) for a in range(3) for c in range(2) for p in range(2) if (t, a) != (7, 1)]
    got = {(r["acc"], r["chan"], r["prod"]): (r["re"], r["im"], r["clipped"]) for r in correlate.visibilities(spark.createDataFrame(rows, "ts long, ant int, chan int, pol int, re int, im int"), 10).collect()}
    held = {(t, a, c, p): (x, y) for t, a, c, p, x, y in rows}
    clipped = 0
    for acc in range(4):
        for c in range(2):
            for a2 in range(3):
                for a1 in range(a2 + 1):
                    for p1 in range(2):
                        for p2 in range(2):
                            re = im = 0
                            for t in range(10 * acc, 10 * acc + 10):
                                if (t, a1, c, p1) in held and (t, a2, c, p2) in held:
                                    (r1, i1), (r2, i2) = held[t, a1, c, p1], held[t, a2, c, p2]
                                    re, im = re + r1 * r2 + i1 * i2, im + i1 * r2 - r1 * i2
                            big = abs(re) > 2**31 - 1 or abs(im) > 2**31 - 1
                            clipped += big
                            assert got[acc, c, 4 * (a2 * (a2 + 1) // 2 + a1) + p1 + 2 * p2] == (max(-(2**31) + 1, min(2**31 - 1, re)), max(-(2**31) + 1, min(2**31 - 1, im)), big)
    assert clipped > 0


# -- heaps


def test_layout_and_late_heaps(spark):
    layout = H.Layout(heap_bytes=8, step=4, chunk_batches=2)
    assert layout.chunk_step == 8 and layout.active_chunks(0) == 1 and layout.active_chunks(9) == 3
    rows = [(0, 0, 8), (1, 24, 8), (2, 4, 8), (3, 16, 8), (4, 25, 8), (5, -4, 8), (6, 28, 7), (7, 28, 8)]
    got = {r["arrival"]: r["reason"] for r in H.placed(spark.createDataFrame(rows, "arrival long, ts long, heap_len long"), layout, active=2).collect()}
    assert got == {0: None, 1: None, 2: "too_old", 3: None, 4: "bad_timestamp", 5: "metadata", 6: "metadata", 7: None}
    assert H.placed(spark.createDataFrame([], "arrival long, ts long, heap_len long"), layout, active=2).count() == 0
    with pytest.raises(ValueError):
        H.gaussian(7)


# -- texts and requests


def test_parsers():
    assert parsers.gains(["1+2j"], 3) == [1 + 2j] * 3 and parsers.gains(["default"], 2, 5j) == [5j, 5j]
    assert parsers.delays("1,2:3,-4e-1") == (1.0, 2.0, 3.0, -0.4)
    known = {"name": parsers.Field(str, required=True), "taps": parsers.Field(int, 16)}
    assert parsers.fields("name=a,taps=4", known) == {"name": "a", "taps": 4} and parsers.fields("name=a", known)["taps"] == 16
    assert parsers.comma_list("3", int, 2, single=True) == [3, 3] and parsers.comma_list("1,2", float, 2) == [1.0, 2.0]
    assert parsers.endpoints("239.1.0.254+2:7148,10.0.0.1", 7150) == [("239.1.0.254", 7148), ("239.1.0.255", 7148), ("239.1.1.0", 7148), ("10.0.0.1", 7150)]
    assert parsers.choice("window", "hann", parsers.WINDOWS) == "hann" and parsers.distinct_names(["a", "b"]) == ["a", "b"]


@pytest.mark.parametrize(
    "call",
    [
        lambda: parsers.gains(["x"], 1), lambda: parsers.gains(["nan"], 1), lambda: parsers.gains(["1", "2"], 3), lambda: parsers.gains(["default"], 1), lambda: parsers.delays("1:2"),
        lambda: parsers.fields("taps=4", {"taps": parsers.Field(int), "name": parsers.Field(str, required=True)}), lambda: parsers.fields("a=1", {}), lambda: parsers.fields("a=1,a=2", {"a": parsers.Field(int)}), lambda: parsers.fields("a", {"a": parsers.Field(int)}), lambda: parsers.fields("a=x", {"a": parsers.Field(int)}),
        lambda: parsers.comma_list("1,2", int, 3), lambda: parsers.choice("window", "hamming", parsers.WINDOWS), lambda: parsers.endpoints("10.0.0.1"), lambda: parsers.endpoints("300.0.0.1:1"), lambda: parsers.distinct_names(["a", "a"]),
    ],
)
def test_parsers_refuse(call):
    with pytest.raises(parsers.ParseError):
        call()


def test_requests(spark):
    c = requests.Control()
    assert c.gain(0, "m000h", ["2"], 2) == [2, 2] and c.gain(1, "m001h", [], 2, 1j) == [1j, 1j]
    c.gain_all(2, ["1", "3"], 2)
    assert c.gain(3, "m000h", [], 2) == [1, 3]
    c.delays(4, 100, {"m000h": "1,0:0,0"})
    assert c.recorder_delay(5, "v", 0.1, 0.25, 4.0) == pytest.approx(0.0)
    c.capture(6, "v", True, 50)
    for bad in (lambda: c.capture(7, "v", True), lambda: c.capture(7, "w", False), lambda: c.recorder_delay(7, "v", 0, 0, 1.0), lambda: c.beam(7, "beam-weights", "b", [1.0], 2), lambda: c.beam(7, "beam", "b", [1.0], 1)):
        with pytest.raises(parsers.ParseError):
            bad()
    c.beam(8, "beam-quant-gains", "b", [2.0], 2)
    c.signals(9, "cw(1, 2);")
    c.capture(90, "v", False)
    assert [tuple(r) for r in requests.sessions(c.table(spark)).collect()] == [("v", 50, 90)]
    assert c.table(spark).count() == len(c.rows) == 8


def test_calibration(tmp_path):
    rate = np.array([1.0, 1.1, 1.2, 1.3, 1.4])
    p = 1 / (1 + np.exp(-(3 - 15 * np.log(rate))))
    a, b = quality.logistic(rate, p * 1000, np.full(5, 1000.0))
    assert a == pytest.approx(3, rel=1e-3) and b == pytest.approx(-15, rel=1e-3)
    rnd, right = np.random.default_rng(1), 0
    for truth in range(0, 33, 4):
        found = quality.noisy_search(32, 0.1, 0.01, lambda i, k, truth=truth: bool((truth <= i) ^ (rnd.random() < 0.1)))
        right += found.low < truth <= found.high
        assert found.high - found.low <= 1
    assert right >= 8
    assert quality.noisy_search(8, 0.2, 0.01, lambda i, k: True, most=3).comparisons == 3


# -- streams


def test_state_is_kept_between_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=60)
    for k in range(3):
        rows = [(i % 2, i, float(x[i])) for i in range(20 * k, 20 * k + 20)]
        spark.createDataFrame([(p, i // 2, v) for p, i, v in rows], "pol long, i long, x double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pol long, i long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r["pol"], r["k"]): r["y"] for r in accumulate.finished(stateful.overlapped_fir(stream, [1.0, 2.0, 3.0])).collect()}
    for pol in (0, 1):
        own = x[pol::2]
        assert [got[pol, k] for k in range(28)] == pytest.approx([own[k] + 2 * own[k + 1] + 3 * own[k + 2] for k in range(28)])
    assert len(got) == 56


def test_silent_sensors_and_sessions(spark, tmp_path):
    rows = [("a", 100, "nominal", 1.0), ("a", 105, "nominal", 2.0), ("a", 160, "error", 3.0), ("b", 100, "nominal", 4.0)]
    df = spark.createDataFrame(rows, "name string, s long, status string, value double").select("name", F.timestamp_seconds("s").alias("ts"), "status", "value")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 second")
    got = sorted(values(accumulate.finished(stateful.status_timeouts(stream, 10_000, "error"))))
    assert ("a", 115_000, "error", 2.0) in got and ("b", 110_000, "error", 4.0) in got and len(got) == 6

    said = []
    monitor = session.Monitor(said.append)
    spark.streams.addListener(monitor)
    heaps = spark.createDataFrame([(t,) for t in range(10)], "ts long")
    heaps.write.parquet(str(tmp_path / "heaps"))
    capture = session.Capture(spark.readStream.schema("ts long").parquet(str(tmp_path / "heaps")), str(tmp_path / "out"))
    capture.start(4, everything_there=True)
    assert sorted(r["ts"] for r in capture.stop().collect()) == [4, 5, 6, 7, 8, 9]
    with pytest.raises(RuntimeError):
        capture.stop()
    spark.streams.removeListener(monitor)
    assert all("type" in json.loads(x) for x in said)
    kept = []
    session.fan_out(heaps, [lambda b: kept.append(b.count()), lambda b: kept.append(b.where("ts > 7").count())])
    assert kept == [10, 2]
    out = {"taken": 0, "dropped": 0}

    def counts(kind):
        return lambda b: out.__setitem__(kind, out[kind] + b.count())

    marked = spark.readStream.schema("ts long").parquet(str(tmp_path / "heaps")).withColumn("reason", F.when(F.col("ts") % 3 == 0, "odd"))
    session.dispatched(marked, "reason", counts("taken"), counts("dropped"), str(tmp_path / "hook")).awaitTermination()
    assert out == {"taken": 6, "dropped": 4}
