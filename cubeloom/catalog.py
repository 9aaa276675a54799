"""The catalog: cubes and what belongs to them, checked as a whole."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from cubeloom.errors import CatalogError, EngineError, nearest
from cubeloom.model import (
    META,
    AuthContext,
    Cube,
    Dimension,
    Entity,
    GlossaryEntry,
    Join,
    Lookup,
    Measure,
    MutableEntity,
    ScopePredicate,
    TimeDimension,
    View,
)
from cubeloom.query import QueryDefaults, SavedQuery

ScopeFn = Callable[[Cube, AuthContext], ScopePredicate | None]
PolicyFn = Callable[[Cube, AuthContext], bool]


def flatten_extends(cubes: Iterable[Cube]) -> list[Cube]:
    """Give each cube that extends another the other's parts that it does not declare itself."""
    by_name = {c.name: c for c in cubes}
    done: dict[str, Cube] = {}

    def flat(cube: Cube, above: tuple[str, ...]) -> Cube:
        if cube.name in done or not cube.extends:
            return done.get(cube.name, cube)
        if cube.extends in above:
            raise CatalogError(f"cubes extend one another: {' -> '.join([*above, cube.extends])}")
        if cube.extends not in by_name:
            raise CatalogError(f"cube {cube.name!r} extends unknown cube {cube.extends!r}")
        base = flat(by_name[cube.extends], (*above, cube.extends))
        changes: dict[str, Any] = {"extends": None}
        for part in ("measures", "dimensions", "time_dimensions", "segments"):
            own = getattr(cube, part)
            names = {f.name for f in cube.fields()}
            changes[part] = tuple(f for f in getattr(base, part) if f.name not in names) + own
        changes["joins"] = tuple(j for j in base.joins if j.to not in {x.to for x in cube.joins}) + cube.joins
        if not (cube.table or cube.source or cube.physical_sources):
            changes |= {k: getattr(base, k) for k in ("table", "source", "physical_sources", "time_partition")}
        defaults = Cube.__dataclass_fields__
        for part in ("base_predicate", "timezone", "primary_key", "security_sql", "security_ctx_keys", "scope", "tenancy", "tenancy_columns", "required_filters", "required_roles", "rollups", "week_start", "backend", "description", "size_hint"):
            if getattr(cube, part) == defaults[part].default:
                changes[part] = getattr(base, part)
        # A base's fragments may name its alias; they must resolve to the new cube's.
        out = cube.with_(**changes)
        if base.alias != cube.alias:
            out = _realias(out, base)
        done[cube.name] = out
        return out

    return [flat(c, (c.name,)) for c in by_name.values()]


def _realias(cube: Cube, base: Cube) -> Cube:
    from dataclasses import replace

    old = re.compile(r"\{(?:" + re.escape(base.alias) + "|" + re.escape(base.name) + r")\}")
    to = "{" + cube.alias + "}"

    def sub(sql):
        return old.sub(to, sql) if sql else sql

    changes: dict[str, Any] = {k: sub(getattr(cube, k)) for k in ("base_predicate", "security_sql")}
    changes["joins"] = tuple(replace(j, on=sub(j.on)) for j in cube.joins)
    for part in ("measures", "dimensions", "time_dimensions", "segments"):
        changes[part] = tuple(replace(f, sql=sub(f.sql), **({"filter": sub(f.filter)} if isinstance(f, Measure) else {})) for f in getattr(cube, part))
    return cube.with_(**changes)


def with_foreign_keys(cubes: list[Cube]) -> list[Cube]:
    """Turn ``Dimension.foreign_key`` into many-to-one joins where none is declared."""
    by_name = {c.name: c for c in cubes}
    out = []
    for cube in cubes:
        joins = list(cube.joins)
        for d in cube.dimensions:
            if not d.foreign_key:
                continue
            to, _, column = d.foreign_key.partition(".")
            target = by_name.get(to)
            if target is None:
                raise CatalogError(f"{cube.name}.{d.name}: foreign key to unknown cube {to!r}")
            key = target.get(column or target.primary_key or "")
            if key is None:
                raise CatalogError(f"{cube.name}.{d.name}: foreign key {d.foreign_key!r} names no field of {to!r}")
            if not any(j.to == to for j in joins):
                joins.append(Join(to=to, relationship="many_to_one", on=f"{d.sql} = {key.sql}"))
        out.append(cube.with_(joins=tuple(joins)) if len(joins) > len(cube.joins) else cube)
    return out


def reflection_cubes() -> list[Cube]:
    """The catalog as data: its cubes, measures and dimensions."""

    def dims(alias: str, *names: str) -> tuple[Dimension, ...]:
        return tuple(Dimension(name=n, sql=f"{{{alias}}}.{n}", type="string") for n in names)

    def cube(name: str, alias: str, *names: str) -> Cube:
        return Cube(name=name, alias=alias, backend=META, dimensions=dims(alias, *names), measures=(Measure(name="count", sql="*", agg="count"),), expose_in_prompt=False)

    return [
        cube("meta_cubes", "mc", "name", "backend", "alias", "description", "stability"),
        cube("meta_measures", "mm", "cube", "name", "agg", "unit", "description"),
        cube("meta_dimensions", "md", "cube", "name", "type", "kind", "description"),
    ]


def reflection_rows(name: str, cubes: Iterable[Cube]) -> list[tuple]:
    cubes = [c for c in cubes if c.backend != META]
    if name == "meta_cubes":
        return [(c.name, c.backend, c.alias, c.description, c.stability) for c in cubes]
    if name == "meta_measures":
        return [(c.name, m.name, m.agg, m.unit, m.description) for c in cubes for m in c.measures]
    fields = [(c, f) for c in cubes for f in (*c.dimensions, *c.time_dimensions)]
    return [(c.name, f.name, f.type, f.kind, f.description) for c, f in fields]


@dataclass
class Catalog:
    """Everything a query can name. ``problems`` collects instead of raising if ``collect`` is set."""

    cubes: Mapping[str, Cube] | Iterable[Cube]
    views: Mapping[str, View] | Iterable[View] = ()
    lookups: Iterable[Lookup] = ()
    saved_queries: Iterable[SavedQuery] = ()
    entities: Iterable[Entity] = ()
    glossary: tuple[GlossaryEntry, ...] = ()
    policy: PolicyFn | None = None
    scope_fns: Mapping[str, ScopeFn] = field(default_factory=dict)
    defaults: QueryDefaults | None = None
    strict_tenancy: bool = False
    allow_mutations: bool = False
    max_list_limit: int = 1000
    max_mutation_rows: int = 1000
    hooks: tuple[Any, ...] = ()
    error_transform: Callable[[EngineError], EngineError] | None = None
    relations: str = ""
    collect: bool = False
    problems: list[str] = field(default_factory=list)

    def __post_init__(self):
        given = list(self.cubes.values()) if isinstance(self.cubes, Mapping) else list(self.cubes)
        names = [c.name for c in given]
        for n in sorted({n for n in names if names.count(n) > 1}):
            self._emit(f"cube {n!r} is declared twice")
        cubes = with_foreign_keys(flatten_extends(given))
        cubes += [m for m in reflection_cubes() if m.name not in names]
        self.cubes = {c.name: c for c in cubes}
        self.views = {v.name: v for v in (self.views.values() if isinstance(self.views, Mapping) else self.views)}
        self.lookups = {x.dimension: x for x in self.lookups}
        self.saved_queries = {s.name: s for s in self.saved_queries}
        self.entities = {e.name: e for e in self.entities}
        self._check()

    def _emit(self, problem: str) -> None:
        self.problems.append(problem)
        if not self.collect:
            raise CatalogError(problem)

    def _check(self) -> None:
        aliases: dict[str, str] = {}
        for cube in self.cubes.values():
            if (other := aliases.setdefault(cube.alias, cube.name)) != cube.name:
                self._emit(f"cubes {other!r} and {cube.name!r} have the alias {cube.alias!r}")
            for j in cube.joins:
                if j.to not in self.cubes:
                    self._emit(f"cube {cube.name!r} joins unknown cube {j.to!r}" + (f"; did you mean {h!r}?" if (h := nearest(j.to, self.cubes)) else ""))
                elif j.to == cube.name:
                    self._emit(f"cube {cube.name!r} joins itself")
            fields = {f.name for f in cube.fields()}
            for r in cube.required_filters:
                if r.rpartition(".")[2] not in fields:
                    self._emit(f"cube {cube.name!r} requires a filter on unknown field {r!r}")
            if cube.primary_key and cube.primary_key not in fields:
                self._emit(f"cube {cube.name!r}: primary key {cube.primary_key!r} is no field")
            for path in cube.drill_paths:
                for step in path:
                    if step not in fields:
                        self._emit(f"cube {cube.name!r}: drill path names unknown field {step!r}")
            if cube.scope and cube.scope not in self.scope_fns:
                self._emit(f"cube {cube.name!r}: no scope function {cube.scope!r} is registered")
            if self.strict_tenancy and cube.tenancy == "none" and not cube.security_sql and cube.backend != META:
                self._emit(f"cube {cube.name!r} has no tenancy, and tenancy is strict")
            if cube.replacement and cube.replacement not in self.cubes:
                self._emit(f"cube {cube.name!r}: unknown replacement {cube.replacement!r}")
        for view in self.views.values():
            if view.name in self.cubes:
                self._emit(f"view {view.name!r} has a cube's name")
            for out, ref in view.fields.items():
                if self.field(ref) is None:
                    self._emit(f"view {view.name!r}: {out!r} names unknown field {ref!r}")
        for lookup in self.lookups.values():
            f = self.field(lookup.dimension)
            if not isinstance(f, Dimension) or f.type != "string":
                self._emit(f"lookup on {lookup.dimension!r}, which is no string dimension")
        for e in self.entities.values():
            for c in e.cubes:
                if c not in self.cubes:
                    self._emit(f"entity {e.name!r}: unknown cube {c!r}")
            for ref in [*e.fields.values(), *e.list_filters, *([e.key] if e.key else [])]:
                if self.field(ref) is None:
                    self._emit(f"entity {e.name!r}: unknown field {ref!r}")
            if isinstance(e, MutableEntity) and self.cubes.get(e.target_cube) and not self.cubes[e.target_cube].table:
                self._emit(f"entity {e.name!r}: its target cube has no plain table")
        seen: dict[str, str] = {}
        ctes: dict[str, str] = {}
        for g in self.glossary:
            for term in (g.term, *g.aliases):
                if seen.setdefault(term.lower(), g.term) != g.term:
                    self._emit(f"glossary: {term!r} belongs to two entries")
        for cube in self.cubes.values():
            for cte in getattr(cube.source, "with_ctes", ()):
                if ctes.setdefault(cte.name, cte.sql) != cte.sql:
                    self._emit(f"CTE {cte.name!r} is declared with different SQL")

    def field(self, ref: str) -> Any:
        """The field that ``cube.field`` names, or None."""
        cube, _, name = ref.partition(".")
        return self.cubes[cube].get(name) if cube in self.cubes else None

    def visible(self, viewer: AuthContext | None) -> dict[str, Cube]:
        """The cubes that the viewer may see; without a viewer, all."""
        return {n: c for n, c in self.cubes.items() if self.sees(c, viewer)}

    def sees(self, cube: Cube, viewer: AuthContext | None) -> bool:
        if viewer is None:
            return True
        if cube.required_roles and not set(cube.required_roles) & set(viewer.roles):
            return False
        return self.policy is None or bool(self.policy(cube, viewer))


def sees_field(f: Any, viewer: AuthContext | None) -> bool:
    return viewer is None or not f.required_roles or bool(set(f.required_roles) & set(viewer.roles))


def is_masked(f: Any, viewer: AuthContext | None) -> bool:
    return viewer is not None and bool(set(getattr(f, "mask_roles", ())) & set(viewer.roles))


def time_fields(cube: Cube) -> dict[str, TimeDimension]:
    return {t.name: t for t in cube.time_dimensions}
