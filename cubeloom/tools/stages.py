"""What the stages of a conversation about data hand one another."""

from __future__ import annotations

from dataclasses import dataclass

from cubeloom.catalog import Catalog
from cubeloom.errors import CompileError
from cubeloom.model import AuthContext
from cubeloom.query import SemanticQuery
from cubeloom.tools.charts import Chart
from cubeloom.tools.rewrite import DrillDown
from cubeloom.tools.validate import Problem, validate


@dataclass(frozen=True)
class Route:
    """Where a question goes: to a query, to the documentation, or back with a question."""

    to: str
    cubes: tuple[str, ...] = ()
    views: tuple[str, ...] = ()
    reasoning: str | None = None

    def __post_init__(self):
        if self.to not in ("query", "catalog", "clarify", "refuse"):
            raise CompileError(f"unknown route {self.to!r}")


@dataclass(frozen=True)
class Step:
    query: SemanticQuery
    intent: str = "answer"
    label: str | None = None


@dataclass(frozen=True)
class Steps:
    """Queries to be run one after another."""

    steps: tuple[Step, ...] = ()
    reasoning: str | None = None

    def problems(self, catalog: Catalog, viewer: AuthContext | None = None) -> dict[int, list[Problem]]:
        found = {i: validate(s.query, catalog, viewer=viewer) for i, s in enumerate(self.steps)}
        return {i: p for i, p in found.items() if p}


@dataclass(frozen=True)
class Presentation:
    summary: str
    highlights: tuple[str, ...] = ()
    caveats: tuple[str, ...] = ()
    chart: Chart | None = None


@dataclass(frozen=True)
class Drill:
    label: str
    query: SemanticQuery


def drills(q: SemanticQuery, catalog: Catalog) -> list[Drill]:
    """The next steps along the drill paths of the cubes that a query groups by."""
    out = []
    for d in q.dimensions:
        cube, _, name = d.partition(".")
        for path in getattr(catalog.cubes.get(cube), "drill_paths", ()):
            if name in path[:-1]:
                deeper = f"{cube}.{path[path.index(name) + 1]}"
                out.append(Drill(f"{name} by {deeper.partition('.')[2]}", DrillDown(deeper).apply(q)))
    return out
