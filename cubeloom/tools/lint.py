"""Signs of a catalog that works but will confuse people or run slowly."""

from __future__ import annotations

from dataclasses import dataclass

from cubeloom.catalog import Catalog
from cubeloom.errors import JoinPathError
from cubeloom.model import META, Dimension, TimeDimension
from cubeloom.plans.joins import find_path


@dataclass(frozen=True)
class Finding:
    rule: str
    where: str
    message: str


def lint(catalog: Catalog) -> list[Finding]:
    out: list[Finding] = []
    cubes = {n: c for n, c in catalog.cubes.items() if c.backend != META}
    owners: dict[str, set[str]] = {}
    for cube in cubes.values():
        if cube.expose_in_prompt and not cube.description:
            out.append(Finding("missing-description", cube.name, "the cube has no description"))
        for m in cube.measures:
            owners.setdefault(m.name, set()).add(cube.name)
            if m.agg == "sum" and m.unit is None and m.format is None:
                out.append(Finding("missing-unit", f"{cube.name}.{m.name}", "a sum without unit or format"))
        if cube.measures and not cube.primary_key and any(j.relationship != "many_to_one" for j in cube.joins):
            out.append(Finding("missing-key", cube.name, "a cube on the one side of a join has no primary key"))
        for d in cube.dimensions:
            if isinstance(d, Dimension) and d.type in ("time", "date") and not isinstance(d, TimeDimension):
                out.append(Finding("time-as-dimension", f"{cube.name}.{d.name}", "a time that cannot be cut into buckets; declare a time dimension"))
        if not cube.joins and not any(j.to == cube.name for c in cubes.values() for j in c.joins) and len(cubes) > 1:
            out.append(Finding("isolated-cube", cube.name, "no join reaches the cube"))
        for other in cubes:
            if other != cube.name:
                try:
                    path = find_path([cube.name], other, cubes)
                except JoinPathError:
                    continue
                if path.alternatives > 1:
                    out.append(Finding("ambiguous-path", f"{cube.name} -> {other}", f"{path.alternatives} equally cheap join paths"))
    for name, where in owners.items():
        if len(where) > 1 and name not in ("count",):
            out.append(Finding("shared-measure-name", name, f"several cubes have a measure of this name: {sorted(where)}"))
    return sorted(out, key=lambda f: (f.rule, f.where))
