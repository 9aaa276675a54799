"""The query: what to measure, by what, where, in which order."""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from cubeloom.errors import CompileError, FilterTypeError
from cubeloom.instant import parse_instant
from cubeloom.model import GRAINS

#: Filter operators and how many values each takes (None: one or more).
FILTER_OPS = {"eq": 1, "neq": 1, "in": None, "not_in": None, "gt": 1, "lt": 1, "gte": 1, "lte": 1, "contains": 1, "is_null": 0, "not_null": 0}
ORDERED_OPS = ("gt", "lt", "gte", "lte")


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise CompileError(message)


@dataclass(frozen=True, kw_only=True)
class TimeWindow:
    """A time dimension restricted to [start, end), and optionally cut into buckets."""

    dimension: str
    range: tuple[str, str] | None = None
    granularity: str | None = None
    fill_nulls_with: int | None = None

    def __post_init__(self):
        _need(self.granularity is None or self.granularity in GRAINS, f"unknown granularity {self.granularity!r}")
        if self.range is not None:
            object.__setattr__(self, "range", tuple(self.range))
            try:
                start, end = map(parse_instant, self.range)
            except ValueError as e:
                raise CompileError(f"{self.dimension}: {self.range} is no pair of ISO-8601 instants") from e
            _need(start <= end, f"{self.dimension}: the window {self.range} is reversed")


@dataclass(frozen=True, kw_only=True)
class Filter:
    dimension: str
    op: str
    values: tuple[Any, ...] = ()

    def __post_init__(self):
        _need(self.op in FILTER_OPS, f"unknown filter op {self.op!r}")
        object.__setattr__(self, "values", tuple(self.values))

    def check(self, kind: str) -> None:
        """Refuse values that do not fit the op or the field's type."""

        def refuse(why: str) -> None:
            raise FilterTypeError(f"filter on {self.dimension!r}: {why}", dimension=self.dimension, op=self.op, type=kind)

        wanted = FILTER_OPS[self.op]
        if wanted is None:
            if not self.values:
                refuse(f"{self.op} needs a value")
        elif len(self.values) != wanted:
            refuse(f"{self.op} takes {wanted} value(s), not {len(self.values)}")
        if self.op == "contains" and kind != "string":
            refuse(f"contains needs a string field, not {kind}")
        if self.op in ORDERED_OPS and kind in ("bool", "uuid"):
            refuse(f"{self.op} does not order a {kind}")
        for v in self.values:
            if kind == "number" and (isinstance(v, bool) or not isinstance(v, int | float)):
                refuse(f"{v!r} is no number")
            elif kind == "bool" and not isinstance(v, bool):
                refuse(f"{v!r} is no boolean")
            elif kind == "string" and not isinstance(v, str):
                refuse(f"{v!r} is no string")
            elif kind in ("time", "date", "uuid"):
                try:
                    parse_instant(v) if kind != "uuid" else uuid.UUID(v)
                except (ValueError, TypeError, AttributeError):
                    refuse(f"{v!r} is no {'uuid' if kind == 'uuid' else 'ISO-8601 ' + kind}")


@dataclass(frozen=True, kw_only=True)
class BoolExpr:
    """A tree of ``and``, ``or`` and ``not`` over filters."""

    op: str
    children: tuple[BoolExpr | Filter, ...]

    def __post_init__(self):
        object.__setattr__(self, "children", tuple(self.children))
        _need(self.op in ("and", "or", "not"), f"unknown connective {self.op!r}")
        n = len(self.children)
        _need(n == 1 if self.op == "not" else n >= 2, f"{self.op} has {n} children")

    def leaves(self) -> list[Filter]:
        out: list[Filter] = []
        todo: list[BoolExpr | Filter] = [self]
        while todo:
            node = todo.pop()
            if isinstance(node, Filter):
                out.append(node)
            else:
                todo.extend(reversed(node.children))
        return out


@dataclass(frozen=True, kw_only=True)
class CompareWindow:
    mode: str = "previous_period"
    range: tuple[str, str] | None = None

    def __post_init__(self):
        _need(self.mode in ("previous_period", "explicit"), f"unknown comparison {self.mode!r}")
        _need((self.mode == "explicit") == (self.range is not None), "an explicit comparison needs a range, the previous period takes none")
        if self.range is not None:
            object.__setattr__(self, "range", tuple(self.range))
            _need(parse_instant(self.range[0]) <= parse_instant(self.range[1]), f"the comparison {self.range} is reversed")


@dataclass(frozen=True, kw_only=True)
class InlineDerived:
    """A ratio (two operands), sum or diff of measures, named in the query."""

    name: str
    op: str
    operands: tuple[str, ...]
    dependencies: tuple[str, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "operands", tuple(self.operands))
        _need(self.op in ("ratio", "sum", "diff"), f"unknown derived op {self.op!r}")
        _need(len(self.operands) == 2 if self.op in ("ratio", "diff") else len(self.operands) >= 2, f"derived {self.name!r}: {self.op} of {len(self.operands)} operands")


@dataclass(frozen=True, kw_only=True)
class SemiJoin:
    """Keep rows whose dimension is (not) among the values that another query selects."""

    dimension: str
    op: str = "in"
    select: str
    source: SemanticQuery

    def __post_init__(self):
        _need(self.op in ("in", "not_in"), f"unknown semi-join op {self.op!r}")
        outputs = {r.split(".")[-1] for r in [*self.source.dimensions, *self.source.measures]} | {*self.source.dimensions, *self.source.aliases}
        _need(self.select in outputs, f"semi-join on {self.dimension!r}: its source does not select {self.select!r}")
        _need(not self.source.semi_joins, "a semi-join's source has no semi-joins of its own")


@dataclass(frozen=True, kw_only=True)
class SemanticQuery:
    measures: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    time_dimension: TimeWindow | None = None
    segments: tuple[str, ...] = ()
    filters: tuple[Filter, ...] = ()
    where: BoolExpr | Filter | None = None
    having: tuple[Filter, ...] = ()
    compare: CompareWindow | None = None
    order: tuple[tuple[str, str], ...] = ()
    limit: int | None = None
    offset: int | None = None
    ungrouped: bool = False
    derived_measures: tuple[InlineDerived, ...] = ()
    semi_joins: tuple[SemiJoin, ...] = ()
    left_joins: tuple[str, ...] = ()
    aliases: Mapping[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            if isinstance(value := getattr(self, name), list):
                object.__setattr__(self, name, tuple(tuple(x) if isinstance(x, list) else x for x in value))
        _need(not (self.ungrouped and (self.measures or self.derived_measures)), "an ungrouped query lists rows and has no measures")
        _need(self.limit is None or self.limit >= 0, "limit is negative")
        _need(self.offset is None or self.offset >= 0, "offset is negative")
        for ref, way in self.order:
            _need(way in ("asc", "desc"), f"order by {ref!r}: {way!r}")

    def with_(self, **changes: Any) -> SemanticQuery:
        return replace(self, **changes)


@dataclass(frozen=True, kw_only=True)
class SavedQuery:
    name: str
    query: SemanticQuery
    description: str = ""
    owner: str | None = None
    required_roles: tuple[str, ...] = ()
    questions: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    purpose: str = ""
    stability: str = "stable"
    replacement: str | None = None


@dataclass(frozen=True, kw_only=True)
class QueryDefaults:
    """Filled in where a query says nothing: a limit, a window, a granularity."""

    limit: int | None = None
    time_window: TimeWindow | None = None
    granularity: str | None = None

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        if q.limit is None and self.limit is not None:
            q = q.with_(limit=self.limit)
        if q.time_dimension is None and self.time_window is not None:
            q = q.with_(time_dimension=self.time_window)
        if q.time_dimension is not None and q.time_dimension.granularity is None and self.granularity and not q.ungrouped:
            q = q.with_(time_dimension=replace(q.time_dimension, granularity=self.granularity))
        return q


def from_dict(data: Mapping[str, Any]) -> SemanticQuery:
    """A query from JSON-like data, as a tool call sends it."""

    def node(x: Mapping[str, Any]) -> BoolExpr | Filter:
        return BoolExpr(op=x["op"], children=tuple(map(node, x["children"]))) if "children" in x else Filter(**x)

    known = set(SemanticQuery.__dataclass_fields__)
    if extra := set(data) - known:
        raise CompileError(f"a query has no {sorted(extra)}")
    out = dict(data)
    if out.get("time_dimension"):
        out["time_dimension"] = TimeWindow(**out["time_dimension"])
    if out.get("compare"):
        out["compare"] = CompareWindow(**out["compare"])
    if out.get("where"):
        out["where"] = node(out["where"])
    for key, kind in (("filters", Filter), ("having", Filter), ("derived_measures", InlineDerived)):
        out[key] = tuple(kind(**x) for x in out.get(key) or ())
    out["semi_joins"] = tuple(SemiJoin(**{**x, "source": from_dict(x["source"])}) for x in out.get("semi_joins") or ())
    return SemanticQuery(**out)
