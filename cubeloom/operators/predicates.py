"""Filters as Columns, with SQL's three-valued logic."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from cubeloom.instant import naive, parse_instant
from cubeloom.query import BoolExpr, Filter


def literal(value: Any, kind: str, spark_type: str | None) -> Column:
    """A bound value as the field's own type, so that comparisons reach the file reader."""
    if kind in ("time", "date"):
        if spark_type == "date" or (spark_type is None and kind == "date"):
            return F.lit(parse_instant(value).date())
        if spark_type == "timestamp":
            return F.lit(parse_instant(value).isoformat()).cast("timestamp")
        return F.lit(naive(value).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value)


def compare(op: str, c: Column, values: Sequence[Column], raw: Sequence[Any]) -> Column:
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "in":
        return c.isin(*values)
    if op == "not_in":
        return ~c.isin(*values)
    if op == "contains":
        return F.contains(F.lower(c), F.lower(values[0]))
    [v] = values
    return {"eq": c == v, "neq": c != v, "gt": c > v, "lt": c < v, "gte": c >= v, "lte": c <= v}[op]


def filter_column(f: Filter, c: Column, kind: str, spark_type: str | None = None) -> Column:
    return compare(f.op, c, [literal(v, kind, spark_type) for v in f.values], f.values)


def tree_column(node: BoolExpr | Filter, leaf: Callable[[Filter], Column]) -> Column:
    """A filter tree as one Column; walked with a stack, as trees may be deep."""
    done: dict[int, Column] = {}
    todo: list[tuple[BoolExpr | Filter, bool]] = [(node, False)]
    while todo:
        at, ready = todo.pop()
        if isinstance(at, Filter):
            done[id(at)] = leaf(at)
        elif not ready:
            todo.append((at, True))
            todo += [(c, False) for c in at.children]
        else:
            parts = [done[id(c)] for c in at.children]
            done[id(at)] = ~parts[0] if at.op == "not" else reduce((lambda a, b: a & b) if at.op == "and" else (lambda a, b: a | b), parts)
    return done[id(node)]
