"""Small changes to a query, as values that can be logged and replayed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from cubeloom.errors import CompileError
from cubeloom.query import CompareWindow, Filter, SemanticQuery, TimeWindow


@dataclass(frozen=True)
class AddFilter:
    filter: Filter

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        return q if self.filter in q.filters else q.with_(filters=(*q.filters, self.filter))


@dataclass(frozen=True)
class RemoveFilter:
    dimension: str

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        return q.with_(filters=tuple(f for f in q.filters if f.dimension != self.dimension))


@dataclass(frozen=True)
class DrillDown:
    """Group by one more dimension, in place of another if one is given."""

    dimension: str
    instead_of: str | None = None

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        kept = tuple(d for d in q.dimensions if d not in (self.instead_of, self.dimension))
        if self.instead_of and self.instead_of not in q.dimensions:
            raise CompileError(f"the query is not grouped by {self.instead_of!r}")
        return q.with_(dimensions=(*kept, self.dimension))


@dataclass(frozen=True)
class RollUp:
    dimension: str

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        gone = self.dimension.rpartition(".")[2]
        return q.with_(
            dimensions=tuple(d for d in q.dimensions if d != self.dimension),
            order=tuple(o for o in q.order if o[0] not in (self.dimension, gone)),
            aliases={k: v for k, v in q.aliases.items() if v != self.dimension},
        )


@dataclass(frozen=True)
class SwapMeasure:
    old: str
    new: str

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        if self.old not in q.measures:
            raise CompileError(f"the query does not measure {self.old!r}")
        return q.with_(measures=tuple(self.new if m == self.old else m for m in q.measures), order=tuple((self.new if r == self.old else r, w) for r, w in q.order), having=tuple(replace(h, dimension=self.new) if h.dimension == self.old else h for h in q.having))


@dataclass(frozen=True)
class SetWindow:
    window: TimeWindow | None

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        return q.with_(time_dimension=self.window)


@dataclass(frozen=True)
class SetGrain:
    granularity: str | None

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        if q.time_dimension is None:
            raise CompileError("the query has no time window")
        return q.with_(time_dimension=replace(q.time_dimension, granularity=self.granularity))


@dataclass(frozen=True)
class SetLimit:
    limit: int | None
    offset: int | None = None

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        return q.with_(limit=self.limit, offset=self.offset)


@dataclass(frozen=True)
class SetOrder:
    order: tuple[tuple[str, str], ...]

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        return q.with_(order=tuple(self.order))


@dataclass(frozen=True)
class Compare:
    window: CompareWindow | None

    def apply(self, q: SemanticQuery) -> SemanticQuery:
        return q.with_(compare=self.window)


def rewrite(q: SemanticQuery, *ops) -> SemanticQuery:
    for op in ops:
        q = op.apply(q)
    return q
