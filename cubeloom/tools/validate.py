"""All problems of a query at once, instead of the first."""

from __future__ import annotations

from dataclasses import dataclass, replace

from cubeloom.catalog import Catalog
from cubeloom.errors import EngineError
from cubeloom.federation import check_federated
from cubeloom.model import AuthContext, Dimension, Measure, Segment, TimeDimension
from cubeloom.plans.logical import Resolver, bind_kind, build_plan, check_shape
from cubeloom.query import BoolExpr, Filter, SemanticQuery


@dataclass(frozen=True)
class Problem:
    code: str
    message: str
    where: str


def validate(q: SemanticQuery, catalog: Catalog, *, viewer: AuthContext | None = None, mode: str = "raw_rows") -> list[Problem]:
    """Problems by place. A query without any compiles, over one source or several."""
    out: list[Problem] = []

    def attempt(where: str, step) -> None:
        try:
            step()
        except EngineError as e:
            if not any(p.message == str(e) for p in out):
                out.append(Problem(e.code, str(e), where))

    r = Resolver(catalog, viewer)
    attempt("query", lambda: check_shape(q))
    for m in q.measures:
        attempt("measures", lambda m=m: r.ref(m, Measure, what="measure"))
    for d in q.dimensions:
        attempt("dimensions", lambda d=d: r.ref(d, Dimension, TimeDimension, what="dimension"))
    for s in q.segments:
        attempt("segments", lambda s=s: r.ref(s, Segment, what="segment"))
    if q.time_dimension:
        attempt("time_dimension", lambda: r.ref(q.time_dimension.dimension, TimeDimension, what="time dimension"))
    leaves = [q.where] if isinstance(q.where, Filter) else q.where.leaves() if isinstance(q.where, BoolExpr) else []
    for place, filters in (("filters", q.filters), ("where", leaves)):
        for f in filters:
            attempt(place, lambda f=f: f.check(bind_kind(r.ref(f.dimension, Dimension, TimeDimension, what="dimension").field)))
    for h in q.having:
        attempt("having", lambda h=h: h.check("number"))
    for s in q.semi_joins:
        attempt("semi_joins", lambda s=s: r.ref(s.dimension, Dimension, what="dimension"))
        out += [replace(p, where=f"semi_joins.{p.where}") for p in validate(s.source, catalog, viewer=viewer, mode=mode)]
    if not out:
        flat = q.with_(semi_joins=())

        def whole() -> None:
            plan = build_plan(flat, catalog, viewer, one_source=False)
            check_federated(flat, plan, catalog, mode)

        attempt("query", whole)
    return out


