"""What a query is likely to read, before it runs."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from cubeloom.catalog import Catalog
from cubeloom.engine import Compiled
from cubeloom.errors import CompileError
from cubeloom.model import AuthContext
from cubeloom.plans.logical import build_plan
from cubeloom.query import SemanticQuery


@dataclass(frozen=True)
class Cost:
    """Rows by cube (None: not known), joins, and joins that may multiply rows."""

    rows: Mapping[str, int | None]
    joins: int
    multiplying_joins: int
    windowed: bool

    @property
    def known_rows(self) -> int:
        return sum(n for n in self.rows.values() if n is not None)


@dataclass(frozen=True)
class Budget:
    max_rows: int | None = None
    max_joins: int | None = None
    require_window_above: int | None = None


def estimate(q: SemanticQuery, catalog: Catalog, viewer: AuthContext | None = None) -> Cost:
    """From the size hints of every cube that the plan reads, bridge cubes included."""
    plan = build_plan(q.with_(semi_joins=()), catalog, viewer, one_source=False)
    rows = {c: catalog.cubes[c].size_hint for c in plan.cubes}
    return Cost(rows, len(plan.steps), sum(s.multiplies for s in plan.steps), bool(q.time_dimension and q.time_dimension.range))


def check_budget(cost: Cost, budget: Budget) -> None:
    if budget.max_rows is not None and cost.known_rows > budget.max_rows:
        raise CompileError(f"the query may read {cost.known_rows} rows; the budget is {budget.max_rows}")
    if budget.max_joins is not None and cost.joins > budget.max_joins:
        raise CompileError(f"the query joins {cost.joins} times; the budget is {budget.max_joins}")
    if budget.require_window_above is not None and not cost.windowed and cost.known_rows > budget.require_window_above:
        raise CompileError(f"a query over more than {budget.require_window_above} rows needs a time window")


def optimizer_bytes(compiled: Compiled) -> int:
    """The optimiser's own estimate of the result's size, from file statistics; no job runs."""
    return int(compiled.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
