"""Queries over several sources, semi-joins and the automatic choice between them.

Spark reads all sources in one plan, so nothing is shipped and merged by hand. What is kept is the
meaning: which queries are refused and why, which side of a join between sources may be missing, and
how filters on one side restrict the other.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.catalog import Catalog
from cubeloom.engine import Compiled, Engine
from cubeloom.errors import FederationError
from cubeloom.model import ADDITIVE, AuthContext, Dimension
from cubeloom.plans.logical import LogicalPlan, Resolver, build_plan, equal_columns
from cubeloom.query import SemanticQuery, SemiJoin

MODES = ("distributive", "raw_rows")
#: Aggregates that partial results of a source can be combined from.
COMBINABLE = (*ADDITIVE, "avg", "min", "max")
SEMI_JOIN_MAX = 10_000


def _backends(plan: LogicalPlan, catalog: Catalog) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for c in plan.cubes:
        out.setdefault(catalog.cubes[c].backend, []).append(c)
    return out


def check_federated(q: SemanticQuery, plan: LogicalPlan, catalog: Catalog, mode: str) -> None:
    """Refuse what has no defined meaning over several sources."""
    if q.semi_joins:
        raise FederationError("semi-joins run before a federated query, not in it", reason="semi_joins")
    backends = _backends(plan, catalog)
    if len(backends) < 2:
        return
    if q.compare:
        raise FederationError("a comparison needs one source", reason="compare")
    if q.ungrouped:
        raise FederationError("a row listing needs one source", reason="ungrouped")
    if q.left_joins:
        raise FederationError("left_joins need one source", reason="left_joins")
    measured = {catalog.cubes[o.ref.cube].backend for o in plan.outputs if o.kind == "measure"} | {catalog.cubes[r.cube].backend for r in plan.operands.values()}
    if len(measured) > 1 and not plan.symmetric:
        raise FederationError("measures of several sources meet in no common key", reason="multi_backend_measures")
    for s in plan.steps:
        left, right = catalog.cubes[s.left], catalog.cubes[s.right]
        if left.backend != right.backend:
            _check_bridge(s.join.on, left, right)
    if mode == "distributive":
        for o in plan.outputs:
            if o.kind == "measure" and o.ref.field.agg not in COMBINABLE and o.ref.field.agg != "ratio":
                raise FederationError(f"{o.ref.key} ({o.ref.field.agg}) cannot be combined from partial results; use mode='raw_rows'", reason="non_distributive")


def _check_bridge(on: str, left: Any, right: Any) -> None:
    """Between sources a join is one equality of two declared dimensions of types that can be equal."""
    columns = equal_columns(on)
    if columns is None:
        raise FederationError(f"a join between sources must be one plain equality, not {on!r}", reason="non_simple_bridge")
    found = []
    for cube in (left, right):
        column = next((c for a, c in columns.items() if a in (cube.alias, cube.name)), None)
        d = next((d for d in cube.dimensions if d.sql.replace("`", "").replace(" ", "") in (f"{{{cube.alias}}}.{column}", f"{{{cube.name}}}.{column}")), None)
        if column is None or d is None:
            raise FederationError(f"the key {column!r} of {cube.name!r} is no declared dimension", reason="undeclared_bridge_key")
        found.append(d)
    a, b = ({d.type, d.coerce_to} - {None} for d in found)
    if not a & b:
        raise FederationError(f"keys {left.name}.{found[0].name} ({found[0].type}) and {right.name}.{found[1].name} ({found[1].type}) differ in type; declare coerce_to", reason="key_type")


def compile_federated(engine: Engine, q: SemanticQuery, *, mode: str = "distributive", viewer: AuthContext | None = None, context: Mapping[str, Any] | None = None) -> Compiled:
    """A query whose cubes may be in several sources.

    The measured side stays whole: rows without a match in another source keep a null there, unless a
    filter, where-clause or segment is on that side alone; then only matching rows count.
    """
    if mode not in MODES:
        raise FederationError(f"unknown mode {mode!r}", reason="mode")
    plan = build_plan(engine._prepared(q), engine.catalog, viewer, one_source=False)
    check_federated(q, plan, engine.catalog, mode)
    cubes = engine.catalog.cubes
    if not plan.symmetric and len(_backends(plan, engine.catalog)) > 1:
        home = cubes[plan.root].backend
        foreign = {s.right for s in plan.steps if cubes[s.right].backend != home}
        asked = {r.cube for r, _ in plan.filters} | {s.cube for s in plan.segments}
        if plan.time is not None:
            asked.add(plan.time.cube)
        for clause in plan.clauses:
            owners = {plan.where_refs[x.filter.dimension].cube for x in clause}
            if len(owners) == 1:
                asked |= owners
        # What lies on the way to an asked-for cube must be there as well.
        needed = set(asked)
        for s in reversed(plan.steps):
            if s.right in needed:
                needed.add(s.left)
        # Combinable measures are totalled by the key that joins the sources before they meet.
        plan = replace(plan, left=frozenset(foreign - needed), partial=mode == "distributive")
    return engine._lower(engine._routed(plan), viewer, context or {})


# -- semi-joins


def compile_semi_joins(engine: Engine, q: SemanticQuery, *, viewer: AuthContext | None = None, context: Mapping[str, Any] | None = None) -> Compiled:
    """A query whose semi-joins become left-semi and left-anti joins, executed by Spark in one job.

    The values of ``in`` are never collected. For ``not_in``, rows whose key is null leave unless there is
    no value at all, as SQL's NOT IN has it; null values are ignored.
    """
    plan = build_plan(engine._prepared(q.with_(semi_joins=())), engine.catalog, viewer)
    r = Resolver(engine.catalog, viewer)
    inner = []
    for i, s in enumerate(q.semi_joins):
        ref = r.ref(s.dimension, Dimension, what="dimension")
        if ref.cube not in plan.cubes:
            raise FederationError(f"semi-join on {s.dimension!r}, a cube that the query does not use", reason="semi_join_cube")
        found = compile_federated(engine, s.source, mode="raw_rows", viewer=viewer, context=context)
        name = s.select if s.select in found.df.columns else s.select.rpartition(".")[2]
        values = found.df.select(F.col(f"`{name}`").alias(f"__semi_{i}")).filter(F.col(f"__semi_{i}").isNotNull()).distinct()
        inner.append((s, ref, values))

    class _Filtered(Engine):
        """Restricts each scan that a semi-join names, below every other join."""

        def scan(self, name, plan, env):
            df = super().scan(name, plan, env)
            alias = env.cubes[name].alias
            for i, (s, ref, values) in enumerate(inner):
                if ref.cube == name:
                    df = semi_join(df, env.column(ref.field.sql), values, f"__semi_{i}", s).alias(alias)
            return df

    view = _Filtered(engine.spark, engine.catalog, engine.sources)
    return view._lower(plan, viewer, context or {})


def semi_join(df: DataFrame, key: Any, values: DataFrame, name: str, s: SemiJoin) -> DataFrame:
    if s.op == "in":
        return df.join(values, key == F.col(name), "left_semi")
    # One row that says if there is any value: without one, rows with a null key stay.
    some = values.agg((F.count("*") > 0).alias("__some"))
    kept = df.join(values, key == F.col(name), "left_anti")
    columns = kept.columns
    return kept.join(F.broadcast(some), ~F.col("__some") | key.isNotNull(), "inner").select(*[kept[c] for c in columns])


# -- automatic planning


@dataclass(frozen=True)
class AutoPlan:
    """How a flat query over several sources is to be run, and why."""

    query: SemanticQuery
    strategy: str  # single_source, semi_join or bridge_merge
    reason: str


def autoplan(q: SemanticQuery, catalog: Catalog, *, semi_join_max: int = SEMI_JOIN_MAX, collapse_unrequested_grain: bool = False, viewer: AuthContext | None = None) -> AutoPlan:
    """Turn filters on cubes of other sources, which are only filtered on, into semi-joins.

    That needs a plain key between the cubes, and a foreign cube not known to be larger than
    ``semi_join_max`` rows; otherwise the sources are joined.
    """
    if collapse_unrequested_grain:
        q = collapse_grain(q)
    plan = build_plan(q, catalog, viewer, one_source=False)
    if len(_backends(plan, catalog)) < 2:
        return AutoPlan(q, "single_source", "all cubes are in one source")
    used = {o.ref.cube for o in plan.outputs if o.ref} | {s.cube for s in plan.segments} | {r.cube for r in plan.where_refs.values()}
    if plan.time is not None:
        used.add(plan.time.cube)
    home = catalog.cubes[plan.root].backend
    only_filtered = [c for c in plan.cubes if catalog.cubes[c].backend != home and c not in used]
    if not only_filtered or len(only_filtered) < len([c for c in plan.cubes if catalog.cubes[c].backend != home]):
        return AutoPlan(q, "bridge_merge", "a cube of another source is selected from")
    semi = []
    for name in only_filtered:
        cube = catalog.cubes[name]
        step = next(s for s in plan.steps if s.right == name)
        columns = equal_columns(step.join.on)
        if columns is None:
            return AutoPlan(q, "bridge_merge", f"the join to {name!r} is no plain equality")
        if cube.size_hint is not None and cube.size_hint > semi_join_max:
            return AutoPlan(q, "bridge_merge", f"{name!r} may have more than {semi_join_max} keys")
        other = catalog.cubes[step.left]
        keys = [_dimension_of(c, columns) for c in (other, cube)]
        if None in keys:
            return AutoPlan(q, "bridge_merge", f"the key of {name!r} is no declared dimension")
        filters = tuple(f for ref, f in plan.filters if ref.cube == name)
        source = SemanticQuery(dimensions=(f"{name}.{keys[1]}",), filters=filters)
        semi.append(SemiJoin(dimension=f"{other.name}.{keys[0]}", op="in", select=keys[1], source=source))
    gone = {id(f) for ref, f in plan.filters if ref.cube in only_filtered}
    rest = tuple(f for f in q.filters if id(f) not in gone)
    return AutoPlan(q.with_(filters=rest, semi_joins=(*q.semi_joins, *semi)), "semi_join", f"{only_filtered} only restrict the rows of other cubes")


def _dimension_of(cube: Any, columns: Mapping[str, str]) -> str | None:
    column = next((c for a, c in columns.items() if a in (cube.alias, cube.name)), None)
    return next((d.name for d in cube.dimensions if d.sql.replace("`", "").replace(" ", "") in (f"{{{cube.alias}}}.{column}", f"{{{cube.name}}}.{column}")), None)


def collapse_grain(q: SemanticQuery) -> SemanticQuery:
    """Drop the time buckets of a top-n query that is not ordered by them: the n are over the whole window."""
    t = q.time_dimension
    if not (t and t.granularity and q.limit is not None and q.order and (q.dimensions)) or t.fill_nulls_with is not None or q.compare:
        return q
    bucket = f"{t.dimension.rpartition('.')[2]}_{t.granularity}"
    if any(ref in (t.dimension, bucket, t.dimension.rpartition(".")[2]) for ref, _ in q.order):
        return q
    return q.with_(time_dimension=replace(t, granularity=None))


def run(engine: Engine, q: SemanticQuery, *, viewer: AuthContext | None = None, context: Mapping[str, Any] | None = None, mode: str = "raw_rows") -> Compiled:
    """Plan automatically and compile: one source, semi-joins, or a join of sources."""
    auto = autoplan(q, engine.catalog, viewer=viewer) if not q.semi_joins else AutoPlan(q, "semi_join", "asked for")
    if auto.query.semi_joins:
        return compile_semi_joins(engine, auto.query, viewer=viewer, context=context)
    return compile_federated(engine, auto.query, mode=mode, viewer=viewer, context=context)


