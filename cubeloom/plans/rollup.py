"""Routing a query to a table that was aggregated before."""

from __future__ import annotations

from cubeloom.model import Cube, Rollup
from cubeloom.plans.logical import LogicalPlan, aligned


def fits(plan: LogicalPlan, cube: Cube, rollup: Rollup) -> bool:
    """Whether the rollup's rows are enough: its fields cover all that is measured, grouped, filtered or
    ordered by, its grain is the query's, and a window cuts no bucket."""
    q = plan.query
    if len(plan.cubes) != 1 or q.compare or q.segments or q.left_joins or q.ungrouped or q.semi_joins:
        return False
    measured = [*(o.ref for o in (*plan.outputs, *plan.hidden) if o.kind == "measure"), *plan.operands.values()]
    if any(m.name not in rollup.measures for m in measured):
        return False
    if any(o.kind == "dimension" and o.ref.name not in rollup.dimensions for o in plan.outputs):
        return False
    if any(ref.name not in rollup.dimensions for ref, _ in plan.filters) or any(ref.name not in rollup.dimensions for ref in plan.where_refs.values()):
        return False
    if plan.time is not None:
        window = q.time_dimension
        if rollup.time_dimension != plan.time.name or (window.granularity is not None and window.granularity != rollup.granularity):
            return False
        if window.range and not aligned(window.range, rollup.granularity, cube.week_start):
            return False
        if window.range and cube.timezone:
            return False  # the window is not shifted by the zone, the buckets are
    return bool(measured)


def pick(plan: LogicalPlan, cube: Cube) -> Rollup | None:
    """The fitting rollup with the fewest dimensions, then by name."""
    found = [r for r in cube.rollups if fits(plan, cube, r)]
    return min(found, key=lambda r: (len(r.dimensions), r.name), default=None)
