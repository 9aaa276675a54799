"""Measures as aggregate Columns."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeloom.model import QUANTILES, Cube, Measure
from cubeloom.operators.fragments import column


def measure_column(cube: Cube, m: Measure, cubes: Mapping[str, Cube], context: Mapping[str, Any], within: Column | None = None) -> Column:
    """The aggregate of a measure; its own filter and ``within`` decide which rows count, a ratio guards its divisor."""
    if m.agg == "ratio":
        top, bottom = (measure_column(cube, cube.get(x), cubes, context, within) for x in (m.numerator, m.denominator))
        return ratio(top, bottom)
    value = measure_value(m, cubes, context)
    value = value if within is None else F.when(within, value)
    if m.metadata.get("zero"):  # a stored count, summed without groups
        return F.coalesce(F.sum(value), F.lit(0))
    return aggregate(m.agg, value)


def measure_value(m: Measure, cubes: Mapping[str, Cube], context: Mapping[str, Any]) -> Column:
    """What a measure aggregates, null in rows that its filter leaves out."""
    value = F.lit(1) if m.agg == "count" and m.sql.strip() in ("*", "1", "") else column(m.sql, cubes, context)
    return F.when(column(m.filter, cubes, context), value) if m.filter else value


#: Aggregates as parts that can be added up, and the whole from the parts' totals.
PARTS = {
    "sum": (("sum", "sum"),),
    "count": (("count", "sum"),),
    "min": (("min", "min"),),
    "max": (("max", "max"),),
    "avg": (("sum", "sum"), ("count", "sum")),
}


def partial(agg: str, value: Column, name: str) -> list[Column]:
    """The parts of an aggregate over some of its rows."""
    return [aggregate(part, value).alias(f"{name}_{i}") for i, (part, _) in enumerate(PARTS[agg])]


def total(agg: str, parts: list[Column]) -> Column:
    """The aggregate from its parts over all groups of rows."""
    found = [aggregate(whole, p) for (_, whole), p in zip(PARTS[agg], parts, strict=True)]
    if agg == "avg":
        return ratio(found[0], found[1])
    return F.coalesce(found[0], F.lit(0)) if agg == "count" else found[0]


def aggregate(agg: str, value: Column) -> Column:
    if agg in QUANTILES:
        return F.percentile(value, F.lit(QUANTILES[agg]))
    return {"sum": F.sum, "count": F.count, "count_distinct": F.count_distinct, "avg": F.avg, "min": F.min, "max": F.max}[agg](value)


def ratio(top: Column, bottom: Column) -> Column:
    """A fraction; null where the divisor is zero."""
    return top.cast("double") / F.nullif(bottom, F.lit(0))


def combine(op: str, parts: list[Column]) -> Column:
    """A measure derived in the query from others."""
    if op == "ratio":
        return ratio(parts[0], parts[1])
    out = parts[0]
    for p in parts[1:]:
        out = out + p if op == "sum" else out - p
    return out
