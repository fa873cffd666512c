"""Scalar functions of the signal chain as Column builders: all stay in whole-stage codegen.

Rounding is half-to-even, saturation symmetric (the least two's-complement value is never
data), integers are widened to long before products and sums."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MAX = 2**31 - 1
MISSING = (-(2**31), 1)  # the pair that marks a visibility without data


def limit(bits: int) -> int:
    return 2 ** (bits - 1) - 1


def clamp(x: Column, most: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(most)), F.lit(-most)))  # both pass over nulls


def quantise(x: Column, bits: int = 8) -> Column:
    """Clamp to +-(2^(bits-1) - 1), then round half to even; NaN counts as below all numbers."""
    return F.rint(F.when(F.isnan(x), float(-limit(bits))).otherwise(clamp(x, float(limit(bits))))).cast("int")


def saturated(x: Column, bits: int = 8) -> Column:
    """Strictly outside the limits before quantising; NaN is."""
    return F.abs(x) > float(limit(bits))  # NaN is above all numbers


def quantise_digitiser(x: Column, bits: int, dither: Column | None = None) -> Column:
    scaled = x * float(limit(bits)) + (F.lit(0.0) if dither is None else dither)
    return quantise(scaled, bits)


def at_limit(x: Column, bits: int) -> Column:
    """The digitiser's own rule: at or beyond the limit."""
    return F.abs(x) >= limit(bits)


_PRIME = 2**31 - 1


def dither(*keys: Column, seed: int = 0) -> Column:
    """Uniform in (-0.5, 0.5), a function of seed and keys only, whatever the partitioning: a chain
    of multiplicative congruences. A whole number plus dither rounds to itself."""
    h = F.lit(seed % _PRIME).cast("long")
    for k in keys:
        h = F.pmod(h * 48271 + F.pmod(k.cast("long"), F.lit(_PRIME)) + 11, F.lit(_PRIME))
    for factor in (69621, 40692, 16807):
        h = F.pmod(h * factor + 12345, F.lit(_PRIME))
    return (h + 0.5) / float(_PRIME) - 0.5


def sequence_of(seed: int, first: int, step: int, number: Column) -> Column:
    """The random sequence of engine `number`: engines that count in steps of their number never share one."""
    return F.lit(seed) + first + number * step


def saturate32(x: Column) -> Column:
    return clamp(x, INT32_MAX).cast("int")


def pack4(re: Column, im: Column) -> Column:
    """Two 4-bit integers in one byte, real part high."""
    return F.shiftleft(re.cast("int"), 4).bitwiseAND(F.lit(0xF0)).bitwiseOR(im.cast("int").bitwiseAND(F.lit(15)))


def unpack4(byte: Column) -> tuple[Column, Column]:
    sign = lambda v: F.when(v > 7, v - 16).otherwise(v)
    return sign(F.shiftright(byte.cast("int"), 4).bitwiseAND(F.lit(15))), sign(byte.cast("int").bitwiseAND(F.lit(15)))


def let(value: Column, body) -> Column:
    """Evaluate value once and name it: body(value) without repeating its expression."""
    return F.transform(F.array(value), body)[0]


def unpack_bits(payload: Column, bits: int) -> Column:
    """Big-endian signed bit fields of a binary -> array<int>. Spare bits at the end are dropped."""
    size = -(-(bits + 3) // 4)  # hex digits that hold any field

    def field(text: Column, i: Column) -> Column:
        first = i * bits
        digits = F.rpad(F.substr(text, F.floor(first / 4).cast("int") + 1, F.lit(size)), size, "0")
        whole = F.floor(F.conv(digits, 16, 10).cast("long") / F.pow(F.lit(2.0), F.lit(size * 4 - bits) - first % 4)).cast("long")
        return let(F.pmod(whole, F.lit(1 << bits)), lambda raw: F.when(raw >= 1 << (bits - 1), raw - (1 << bits)).otherwise(raw).cast("int"))

    def fields(text: Column) -> Column:
        n = F.floor(F.length(text) * 4 / bits).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: field(text, i))).otherwise(F.array().cast("array<int>"))

    return let(F.hex(payload), fields)


def pack_bits(values: Column, bits: int) -> Column:
    """array<int> -> binary of big-endian bit fields; the bits must fill whole bytes."""

    def octets(ones: Column) -> Column:
        n = F.floor(F.length(ones) / 8).cast("int")
        digits = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.lpad(F.conv(F.substr(ones, i * 8 + 1, F.lit(8)), 2, 16), 2, "0"))
        return F.when(F.length(ones) % 8 != 0, F.raise_error(F.lit("the packed bits don't fill whole bytes")).cast("string")).when(n > 0, F.array_join(digits, "")).otherwise(F.lit(""))

    ones = F.array_join(F.transform(values, lambda v: F.lpad(F.conv(F.pmod(v.cast("long"), F.lit(1 << bits)).cast("string"), 10, 2), bits, "0")), "")
    return F.unhex(let(ones, octets))


def cmul(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def cmul_conj(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """a * conj(b)."""
    return a[0] * b[0] + a[1] * b[1], a[1] * b[0] - a[0] * b[1]


def rotate(x: tuple[Column, Column], angle: Column) -> tuple[Column, Column]:
    return cmul(x, (F.cos(angle), F.sin(angle)))


def phase_slope(channel: Column, channels: int, delay: Column, phase: Column) -> Column:
    """-pi / C * (k - C/2) * delay + phase."""
    return F.lit(-math.pi / channels) * (channel - channels / 2) * delay + phase


def wrap_angle(a: Column) -> Column:
    """Into [-pi, pi)."""
    return F.pmod(a + math.pi, F.lit(2 * math.pi)) - math.pi


def coarse_phase(coarse: Column) -> Column:
    return F.pmod(coarse, F.lit(4)) * (math.pi / 2)


def unix_to_adc(unix: Column, sync: float, rate: float) -> Column:
    return F.rint((unix - sync) * rate).cast("long")


def adc_to_unix(ticks: Column, sync: float, rate: float) -> Column:
    return ticks / rate + sync


def div_up(x: Column, step: int) -> Column:
    return F.ceil(x / step)


def round_up(x: Column, step: int) -> Column:
    return div_up(x, step) * step


def fine_delay(delay: Column, internal_decimation: int) -> Column:
    """In samples of the channeliser's input."""
    return delay / internal_decimation


def beam_phase(channel: Column, delay: Column) -> tuple[Column, Column]:
    """exp(j pi c d)."""
    angle = F.pmod(channel * delay, F.lit(2.0)) * math.pi
    return F.cos(angle), F.sin(angle)


def beam_weight(weight: Column, gain: Column, phase: Column) -> tuple[Column, Column]:
    """Weight and quantising gain of an antenna in a beam, turned by its fringe phase."""
    return weight * gain * F.cos(phase), weight * gain * F.sin(phase)


def kernel_delay(delay: Column, spacing: float) -> Column:
    """Half turns a channel of a delay in seconds, channels being `spacing` Hz apart."""
    return delay * (-2.0 * spacing)


def flat_time(batch: Column, spectra: int, t: Column) -> Column:
    return batch * spectra + t


def valid_channel(channel: Column, low: int, channels: int) -> Column:
    return (channel >= low) & (channel < low + channels)


def clock_status(state: Column, error: Column, warn: float, bad: float) -> tuple[Column, Column]:
    """Status of a clock's state (ok, error, else on its way) and of a bound on its error."""
    by_state = F.when(state == "ok", "nominal").when(state == "error", "error").otherwise("warn")
    return by_state, F.when(error < warn, "nominal").when(error < bad, "warn").otherwise("error")


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re.cast("double"), im.cast("double"))


def decibel(power: Column) -> Column:
    return F.when(power > 0, 10 * F.log10(power))


def mask_timestamp(ts: Column, step: int) -> Column:
    return ts.bitwiseAND(F.lit(~(step - 1)))


def status_pol(digitiser_id: Column) -> Column:
    return digitiser_id.bitwiseAND(F.lit(1))


def status_saturation(status: Column) -> Column:
    return F.shiftrightunsigned(status, 32)


def status_word(count: Column) -> Column:
    """The count above bit 32, and a flag (bit 1) if there is any."""
    return F.shiftleft(count.cast("long"), 32) + F.when(count > 0, F.lit(2)).otherwise(F.lit(0))


def dbfs(total: Column, n: Column, bits: int) -> Column:
    """Power in dB below a full-scale sine; the least double where there is none."""
    return F.when(total > 0, 10 * F.log10(total / n / (limit(bits) ** 2 / 2))).otherwise(F.lit(-1.7976931348623157e308))


def dbfs_status(db: Column) -> Column:
    return F.when(db.between(-30, -10), "nominal").when(db.between(-33, -7), "warn").otherwise("error")


def baseline(a1: Column, a2: Column) -> Column:
    """Index of a pair a1 <= a2."""
    return F.floor(a2 * (a2 + 1) / 2).cast("int") + a1


def product(base: Column, pol1: Column, pol2: Column) -> Column:
    return 4 * base + pol1 + 2 * pol2


def channel_frequency(channel: Column, channels: int, bandwidth: float, centre: float) -> Column:
    return (channel - channels / 2) * (bandwidth / channels) + centre


def fft_shift(k: Column, channels: int) -> Column:
    return (k + channels // 2).bitwiseAND(F.lit(channels - 1))


def level2(x: Column, threshold: float = 0.969) -> Column:
    """2-bit levels 0..3 around zero and +-threshold."""
    return F.when(x < -threshold, 0).when(x < 0, 1).when(x < threshold, 2).otherwise(3)
