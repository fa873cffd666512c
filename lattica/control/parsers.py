"""Configuration texts: on the driver for what configures a query, as columns for what comes in tables."""

from __future__ import annotations

import cmath
import ipaddress
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"[-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?"
_COMPLEX = rf"^\s*({NUMBER}(?=\s*$|[-+]))?(?:([-+]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?)[jJ])?\s*$"
WINDOWS = ("hann", "rect")
DITHERS = ("none", "uniform")


class ParseError(ValueError):
    """A text that isn't valid where it stands."""


def gains(values: list[str], channels: int, default: complex | None = None) -> list[complex]:
    """1 or `channels` complex numbers, or "default" where there is one; finite only."""
    if values == ["default"] and default is not None:
        return [default] * channels
    if len(values) not in (1, channels):
        raise ParseError(f"expected 1 or {channels} gains, not {len(values)}")
    try:
        out = [complex(v.replace(" ", "")) for v in values]
    except ValueError:
        raise ParseError("invalid formatting of complex number") from None
    if not all(map(cmath.isfinite, out)):
        raise ParseError("non-finite gains are not permitted")
    return out * channels if len(out) == 1 else out


def complex_columns(text: Column) -> tuple[Column, Column]:
    """(re, im) of "a+bj", "a", "bj"; nulls where the text is none of these."""
    ok = text.rlike(_COMPLEX) & text.rlike("[0-9]")
    found = lambda k: F.regexp_extract(text, _COMPLEX, k)
    part = lambda k: F.when(ok, F.coalesce(F.when(found(k) != "", found(k)).cast("double"), F.lit(0.0)))
    return part(1), part(2)


def delays(text: str) -> tuple[float, float, float, float]:
    """"delay,rate:phase,rate" -> four numbers."""
    try:
        (d, dr), (p, pr) = (part.split(",") for part in text.split(":"))
        return float(d), float(dr), float(p), float(pr)
    except ValueError:
        raise ParseError(f"expected delay,rate:phase,rate, not {text!r}") from None


def delay_columns(text: Column) -> tuple[Column, Column, Column, Column]:
    """The same of a column; nulls where the text has another form."""
    form = rf"^({NUMBER}),({NUMBER}):({NUMBER}),({NUMBER})$"
    return tuple(F.when(text.rlike(form), F.regexp_extract(text, form, k)).cast("double") for k in range(1, 5))


def beam_delay_columns(text: Column) -> tuple[Column, Column]:
    """"delay:phase"."""
    form = rf"^({NUMBER}):({NUMBER})$"
    return tuple(F.when(text.rlike(form), F.regexp_extract(text, form, k)).cast("double") for k in (1, 2))


@dataclass(frozen=True)
class Field:
    kind: Callable[[str], Any]
    default: Any = None
    required: bool = False


def fields(text: str, known: dict[str, Field]) -> dict[str, Any]:
    """"key=value,key=value" by known keys: types, defaults, and errors for keys that are unknown, twice there or missing."""
    out: dict[str, Any] = {}
    for part in text.split(",") if text else []:
        key, sep, value = part.partition("=")
        if not sep:
            raise ParseError(f"missing '=' in {part!r}")
        if key not in known:
            raise ParseError(f"unknown key {key}")
        if key in out:
            raise ParseError(f"{key} specified twice")
        try:
            out[key] = known[key].kind(value)
        except ValueError as e:
            raise ParseError(f"{key}: {e}") from None
    for key, field in known.items():
        if key not in out:
            if field.required:
                raise ParseError(f"{key} is missing")
            out[key] = field.default
    return out


def field_columns(text: Column, keys: list[str]) -> tuple[dict[str, Column], Column]:
    """Values of the keys of a column of such texts, and why a text is wrong (null: it isn't)."""
    parts = F.transform(F.split(text, ","), lambda p: F.split(p, "=", 2))
    names = F.transform(parts, lambda p: p[0])
    error = F.when(F.exists(parts, lambda p: F.size(p) < 2), "missing =").when(F.exists(names, lambda n: ~n.isin(keys)), "unknown key").when(F.size(F.array_distinct(names)) < F.size(names), "key twice")
    value = lambda k: F.when(error.isNull(), F.get(F.transform(F.filter(parts, lambda p: p[0] == k), lambda p: F.get(p, F.lit(1))), F.lit(0)))
    return {k: value(k) for k in keys}, error


def comma_list(text: str, kind: Callable[[str], Any] = str, count: int | None = None, single: bool = False) -> list[Any]:
    """Comma-separated values, `count` of them; with single, one stands for all."""
    out = [kind(x) for x in text.split(",")] if text else []
    if count is not None and len(out) != count:
        if single and len(out) == 1:
            return out * count
        raise ParseError(f"expected {count} values, not {len(out)}")
    return out


def comma_columns(text: Column, count: int, single: bool = False) -> Column:
    """array of `count` doubles; null where the number of values is another or one isn't a number."""
    words = F.split(text, ",")
    numbers = F.transform(words, lambda w: F.when(w.rlike(f"^{NUMBER}$"), w).cast("double"))
    fits = F.when(F.size(words) == count, numbers)
    if single:
        fits = fits.when(F.size(words) == 1, F.array_repeat(numbers[0], count))
    return F.when(~F.exists(fits, lambda x: x.isNull()), fits)


def choice(name: str, text: str, values: Iterable[str]) -> str:
    values = list(values)
    if text not in values:
        raise ParseError(f"invalid {name} value: {text!r} (valid values are {', '.join(map(repr, values))})")
    return text


def endpoints(text: str, default_port: int | None = None) -> list[tuple[str, int]]:
    """"a.b.c.d[+n][:port],..." -> addresses with ports; +n: that one and the n after it."""
    out = []
    for part in text.split(","):
        host, _, port = part.partition(":")
        host, _, more = host.partition("+")
        try:
            first, extra = ipaddress.IPv4Address(host), int(more) if more else 0
            number = int(port) if port else default_port
        except ValueError as e:
            raise ParseError(str(e)) from None
        if number is None:
            raise ParseError(f"{part} has no port")
        out += [(str(first + k), number) for k in range(extra + 1)]
    return out


def distinct_names(names: Iterable[str]) -> list[str]:
    """The names, if none comes twice."""
    names = list(names)
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ParseError(f"output name {twice[0]} used more than once")
    return names


def format_complex(re: Column, im: Column) -> Column:
    """real+imaginary j with all digits."""
    return F.concat(re.cast("string"), F.when((im < 0) | im.isNull(), "").otherwise("+"), im.cast("string"), F.lit("j"))
