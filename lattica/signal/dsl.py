"""Signal programs: text -> expression trees -> Columns over a range of sample indices.

program  := { name "=" sum ";" | sum ";" } ; at least one output
sum      := term { ("+" | "-") term } ;  term := factor { "*" factor }
factor   := number | name | name "(" arguments ")" | "(" sum ")" | "-" factor
Signals: cw(amplitude, frequency), multicw(n, a0, da, f0, df), comb(amplitude, frequency),
wgn(std[, entropy]), delay(signal, samples), nodither(signal) (outermost only)."""

from __future__ import annotations

import math
import re
import secrets
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_]\w*)|(.))", re.S)


class SignalError(ValueError):
    """A program that isn't valid."""


class Signal:
    dithered = True

    def column(self, i: Column, n: int, rate: float) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class Constant(Signal):
    value: float

    def column(self, i: Column, n: int, rate: float) -> Column:
        return F.lit(float(self.value))

    def __str__(self) -> str:
        return repr(self.value)


@dataclass(frozen=True)
class CW(Signal):
    """A cosine of a whole number of waves in n samples, one at least."""

    amplitude: float
    frequency: float

    def column(self, i: Column, n: int, rate: float) -> Column:
        waves = max(1, round(n * self.frequency / rate))
        return F.cos(2 * math.pi * F.pmod(i * waves, F.lit(n)) / n) * self.amplitude

    def __str__(self) -> str:
        return f"cw({self.amplitude!r}, {self.frequency!r})"


@dataclass(frozen=True)
class MultiCW(Signal):
    n: float
    a0: float
    da: float
    f0: float
    df: float

    def column(self, i: Column, n: int, rate: float) -> Column:
        parts = [CW(self.a0 + k * self.da, self.f0 + k * self.df).column(i, n, rate) for k in range(int(self.n))]
        return sum(parts, F.lit(0.0))

    def __str__(self) -> str:
        return f"multicw({int(self.n)}, {self.a0!r}, {self.da!r}, {self.f0!r}, {self.df!r})"


@dataclass(frozen=True)
class Comb(Signal):
    """Impulses at the samples nearest to whole cycles."""

    amplitude: float
    frequency: float

    def column(self, i: Column, n: int, rate: float) -> Column:
        waves = max(1, round(n * self.frequency / rate))
        cycle = F.rint(i * waves / n)
        return F.when(F.pmod(F.rint(cycle * n / waves), F.lit(n)) == i, float(self.amplitude)).otherwise(0.0)

    def __str__(self) -> str:
        return f"comb({self.amplitude!r}, {self.frequency!r})"


@dataclass(frozen=True)
class WGN(Signal):
    """Gaussian noise, a function of entropy and sample index: the same on any partitioning."""

    std: float
    entropy: int = field(default_factory=lambda: secrets.randbits(62))

    def column(self, i: Column, n: int, rate: float) -> Column:
        u = [(F.pmod(F.xxhash64(F.lit(self.entropy), F.lit(k), i), F.lit(1 << 52)) + 0.5) / float(1 << 52) for k in (0, 1)]
        return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1]) * self.std

    def __str__(self) -> str:
        return f"wgn({self.std!r}, {self.entropy})"


@dataclass(frozen=True)
class Delay(Signal):
    signal: Signal
    samples: float

    def column(self, i: Column, n: int, rate: float) -> Column:
        return self.signal.column(F.pmod(i - int(self.samples), F.lit(n)), n, rate)

    def __str__(self) -> str:
        return f"delay({self.signal}, {int(self.samples)})"


@dataclass(frozen=True)
class NoDither(Signal):
    signal: Signal
    dithered = False

    def column(self, i: Column, n: int, rate: float) -> Column:
        return self.signal.column(i, n, rate)

    def __str__(self) -> str:
        return f"nodither({self.signal})"


@dataclass(frozen=True)
class Combined(Signal):
    op: str
    left: Signal
    right: Signal

    def column(self, i: Column, n: int, rate: float) -> Column:
        a, b = self.left.column(i, n, rate), self.right.column(i, n, rate)
        return a + b if self.op == "+" else a - b if self.op == "-" else a * b

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


FUNCTIONS = {"cw": (CW, 2, 2), "multicw": (MultiCW, 5, 5), "comb": (Comb, 2, 2), "wgn": (WGN, 1, 2), "delay": (Delay, 2, 2), "nodither": (NoDither, 1, 1)}


#: Arguments (after signals) that are whole numbers.
WHOLE = {"multicw": (0,), "wgn": (1,), "delay": (0,)}


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens = [m.group(m.lastindex) for m in TOKEN.finditer(text) if m.lastindex and m.group(m.lastindex).strip()]
        self.at, self.names = 0, {}

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self, want: str = "") -> str:
        got = self.peek()
        if not got or (want and got != want):
            raise SignalError(f"expected {want or 'more'}, found {got or 'the end'}")
        self.at += 1
        return got

    def program(self) -> list[Signal]:
        out = []
        while self.peek():
            name = self.peek()
            if name.isidentifier() and self.tokens[self.at + 1 : self.at + 2] == ["="]:
                self.at += 2
                self.names[name] = self.total()
            else:
                out.append(self.total())
            self.take(";")
        if not out:
            raise SignalError("a program needs an output")
        return out

    def _joined(self, part, ops: str) -> Signal:
        left = part()
        while self.peek() and self.peek() in ops:
            op, right = self.take(), part()
            for side in (left, right):
                if not side.dithered:
                    raise SignalError(f"{side} can't be an operand")
            left = Combined(op, left, right)
        return left

    def total(self) -> Signal:
        return self._joined(lambda: self._joined(self.factor, "*"), "+-")

    def factor(self) -> Signal:
        token = self.take()
        if token == "(":
            inner = self.total()
            self.take(")")
            return inner
        if token == "+":
            return self.factor()
        if token == "-":
            inner = self.factor()
            return Constant(-inner.value) if isinstance(inner, Constant) else Combined("*", Constant(-1.0), inner)
        if token[0].isdigit() or token[0] == ".":
            return Constant(float(token))
        if self.peek() != "(":
            if token not in self.names:
                raise SignalError(f"unknown name {token}")
            return self.names[token]
        if token not in FUNCTIONS:
            raise SignalError(f"unknown function {token}")
        self.take("(")
        args: list = []
        while self.peek() != ")":
            args.append(self.total())
            if self.peek() != ")":
                self.take(",")
        self.take(")")
        kind, least, most = FUNCTIONS[token]
        if not least <= len(args) <= most:
            raise SignalError(f"{token} takes {least} to {most} arguments")
        first = 1 if kind in (Delay, NoDither) else 0
        if first and not args[0].dithered:
            raise SignalError(f"{args[0]} can't be an operand")
        if any(not isinstance(x, Constant) for x in args[first:]):
            raise SignalError(f"expected a number as an argument of {token}")
        values = [x.value for x in args[first:]]
        for k in WHOLE.get(token, ()):
            if k < len(values):
                if values[k] != int(values[k]) or (token != "delay" and values[k] < 0):
                    raise SignalError(f"expected a whole number as an argument of {token}")
                values[k] = int(values[k])
        return kind(*args[:first], *values)


def parse(text: str) -> list[Signal]:
    return _Parser(text).program()


def render(signals: list[Signal]) -> str:
    """A program that parses to the same signals."""
    return " ".join(f"{s};" for s in signals)
