"""Units: a graph of conversion factors, searched for the shortest chain."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeloom.errors import CompileError

#: How many of the second unit one of the first is.
FACTORS = {
    ("minute", "second"): 60.0,
    ("hour", "minute"): 60.0,
    ("day", "hour"): 24.0,
    ("week", "day"): 7.0,
    ("second", "millisecond"): 1000.0,
    ("millisecond", "microsecond"): 1000.0,
    ("kilobyte", "byte"): 1000.0,
    ("megabyte", "kilobyte"): 1000.0,
    ("gigabyte", "megabyte"): 1000.0,
    ("terabyte", "gigabyte"): 1000.0,
    ("kibibyte", "byte"): 1024.0,
    ("mebibyte", "kibibyte"): 1024.0,
    ("gibibyte", "mebibyte"): 1024.0,
    ("kilometer", "meter"): 1000.0,
    ("meter", "centimeter"): 100.0,
    ("kilogram", "gram"): 1000.0,
    ("ratio", "percent"): 100.0,
}
ALIASES = {"s": "second", "sec": "second", "ms": "millisecond", "us": "microsecond", "min": "minute", "h": "hour", "d": "day", "b": "byte", "kb": "kilobyte", "mb": "megabyte", "gb": "gigabyte", "tb": "terabyte", "kib": "kibibyte", "mib": "mebibyte", "gib": "gibibyte", "km": "kilometer", "m": "meter", "cm": "centimeter", "kg": "kilogram", "g": "gram", "%": "percent", "pct": "percent"}


class Units:
    """Known units; more can be added."""

    def __init__(self, factors: dict[tuple[str, str], float] | None = None, aliases: dict[str, str] | None = None):
        self.aliases = dict(ALIASES if aliases is None else aliases)
        self.near: dict[str, dict[str, float]] = {}
        for (a, b), x in (FACTORS if factors is None else factors).items():
            self.add(a, b, x)

    def add(self, unit: str, other: str, factor: float) -> None:
        if not factor > 0:
            raise CompileError(f"one {unit} cannot be {factor} {other}")
        self.near.setdefault(unit, {})[other] = factor
        self.near.setdefault(other, {})[unit] = 1 / factor

    def name(self, unit: str) -> str:
        low = unit.strip().lower()
        low = self.aliases.get(low, low)
        if low not in self.near and low.endswith("s") and low[:-1] in self.near:
            low = low[:-1]
        return low

    def factor(self, unit: str, other: str) -> float:
        """How many of the other unit one unit is, by the fewest steps."""
        start, goal = self.name(unit), self.name(other)
        if start == goal:
            return 1.0
        todo, seen = deque([(start, 1.0)]), {start}
        while todo:
            at, x = todo.popleft()
            for to, f in self.near.get(at, {}).items():
                if to == goal:
                    return x * f
                if to not in seen:
                    seen.add(to)
                    todo.append((to, x * f))
        raise CompileError(f"no conversion leads from {unit!r} to {other!r}")

    def convert(self, value: float, unit: str, other: str) -> float:
        return value * self.factor(unit, other)

    def column(self, c: Column, unit: str, other: str) -> Column:
        return c * F.lit(self.factor(unit, other))

    def reachable(self, unit: str) -> set[str]:
        out, todo = set(), [self.name(unit)]
        while todo:
            at = todo.pop()
            if at not in out:
                out.add(at)
                todo += self.near.get(at, ())
        return out

    def auto_pick(self, value: float, unit: str) -> tuple[float, str]:
        """The value in the largest related unit in which it is at least 1."""
        options = [(abs(self.convert(value, unit, u)), u) for u in self.reachable(unit)]
        fitting = [(x, u) for x, u in options if x >= 1]
        _, best = min(fitting) if fitting else max(options)
        return self.convert(value, unit, best), best
