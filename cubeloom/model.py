"""The catalog's value types: cubes with their fields, joins, sources, rollups and access rules.

All are frozen and check themselves when made. SQL fragments are Spark SQL in which ``{alias}`` or
``{cube}`` stands for a cube's alias and ``{key}`` for a value of the compile context.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from cubeloom.errors import CatalogError
from cubeloom.instant import parse_instant

#: The vocabulary of the model.
AGGREGATES = ("sum", "count", "count_distinct", "avg", "min", "max", "ratio", "median", "p75", "p90", "p95")
QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
ADDITIVE = ("sum", "count")
DISTRIBUTIVE = ("sum", "count", "min", "max")
FIELD_TYPES = ("string", "number", "time", "date", "bool", "uuid")
GRAINS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
SUB_DAY_GRAINS = GRAINS[:3]
RELATIONSHIPS = ("one_to_one", "one_to_many", "many_to_one")
TENANCY_MODES = ("none", "schema", "discriminator")
STABILITIES = ("stable", "beta", "deprecated")
META = "meta"


class RawSQL(str):
    """SQL written by the catalog's author; nothing from a query ever becomes one."""


def _need(ok: Any, message: str) -> None:
    if not ok:
        raise CatalogError(message)


def _one_of(what: str, value: str, known: tuple[str, ...]) -> None:
    _need(value in known, f"{what} {value!r} is not one of {list(known)}")


@dataclass(frozen=True, kw_only=True)
class BaseField:
    name: str
    sql: str = ""
    description: str = ""
    display_name: str | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)
    required_roles: tuple[str, ...] = ()

    kind = "field"

    def __post_init__(self):
        _need(re.fullmatch(r"[A-Za-z_]\w*", self.name), f"{self.name!r} is not a field name")
        object.__setattr__(self, "sql", RawSQL(self.sql))
        object.__setattr__(self, "required_roles", tuple(self.required_roles))


@dataclass(frozen=True, kw_only=True)
class _Masked(BaseField):
    mask_roles: tuple[str, ...] = ()
    mask_value: str | None = None
    unit: str | None = None
    display_unit: str | None = None
    format: str | None = None

    def __post_init__(self):
        super().__post_init__()
        object.__setattr__(self, "mask_roles", tuple(self.mask_roles))
        _need(set(self.mask_roles) <= set(self.required_roles), f"{self.name!r}: a role in mask_roles must be in required_roles too")


@dataclass(frozen=True, kw_only=True)
class Measure(_Masked):
    agg: str
    filter: str | None = None
    numerator: str | None = None
    denominator: str | None = None
    non_additive: bool = False

    kind = "measure"

    def __post_init__(self):
        super().__post_init__()
        _one_of(f"measure {self.name!r}: agg", self.agg, AGGREGATES)
        if self.agg == "ratio":
            _need(self.numerator and self.denominator, f"ratio measure {self.name!r} needs numerator and denominator")
        else:
            _need(not (self.numerator or self.denominator), f"measure {self.name!r}: only a ratio has numerator and denominator")

    @property
    def additive(self) -> bool:
        return self.agg in ADDITIVE and not self.non_additive


@dataclass(frozen=True, kw_only=True)
class Dimension(_Masked):
    type: str
    foreign_key: str | None = None
    aliases: tuple[str, ...] = ()
    coerce_to: str | None = None
    ordinal: bool = False

    kind = "dimension"

    def __post_init__(self):
        super().__post_init__()
        _one_of(f"dimension {self.name!r}: type", self.type, FIELD_TYPES)
        _need(self.coerce_to != self.type, f"dimension {self.name!r}: coerce_to is its own type")
        object.__setattr__(self, "aliases", tuple(self.aliases))


@dataclass(frozen=True, kw_only=True)
class TimeDimension(BaseField):
    type: str = "time"
    granularities: tuple[str, ...] | None = None

    kind = "time"

    def __post_init__(self):
        super().__post_init__()
        _one_of(f"time dimension {self.name!r}: type", self.type, ("time", "date"))
        fitting = GRAINS if self.type == "time" else GRAINS[3:]
        object.__setattr__(self, "granularities", fitting if self.granularities is None else tuple(self.granularities))
        for g in self.granularities:
            _one_of(f"time dimension {self.name!r}: grain", g, fitting)


@dataclass(frozen=True, kw_only=True)
class Segment(BaseField):
    kind = "segment"


@dataclass(frozen=True, kw_only=True)
class Join:
    to: str
    relationship: str
    on: str
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        _one_of(f"join to {self.to!r}: relationship", self.relationship, RELATIONSHIPS)
        object.__setattr__(self, "on", RawSQL(self.on))


@dataclass(frozen=True)
class PhysicalTable:
    table: str


@dataclass(frozen=True)
class NamedCTE:
    name: str
    sql: str


@dataclass(frozen=True)
class DerivedTable:
    """A cube over a SQL query; its named CTEs are put before it as one WITH clause."""

    sql: str
    with_ctes: tuple[NamedCTE, ...] = ()

    def __post_init__(self):
        object.__setattr__(self, "with_ctes", tuple(self.with_ctes))
        names = [c.name for c in self.with_ctes]
        _need(len(set(names)) == len(names), f"a CTE is named twice: {names}")
        _need(not re.match(r"\s*with\b", self.sql, re.I), "a derived table's sql may not begin with WITH; use with_ctes")


@dataclass(frozen=True)
class TimePartition:
    time_dimension: str


@dataclass(frozen=True)
class TimePartitionedSource:
    """One of several tables of a cube; it covers the half-open range of its bounds."""

    name: str
    table: str
    range_start: str | None = None
    range_end: str | None = None
    column_renames: Mapping[str, str] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        if self.range_start and self.range_end:
            _need(parse_instant(self.range_start) < parse_instant(self.range_end), f"source {self.name!r}: its range is empty")

    def overlaps(self, window: tuple[str, str] | None) -> bool:
        if window is None:
            return True
        start, end = map(parse_instant, window)
        return (self.range_end is None or start < parse_instant(self.range_end)) and (self.range_start is None or parse_instant(self.range_start) < end)


@dataclass(frozen=True, kw_only=True)
class Rollup:
    """A table of rows grouped before: columns are named after fields, the bucket ``<time>_<grain>``."""

    name: str
    physical_table: str
    dimensions: tuple[str, ...] = ()
    measures: tuple[str, ...] = ()
    time_dimension: str | None = None
    granularity: str | None = None
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "dimensions", tuple(self.dimensions))
        object.__setattr__(self, "measures", tuple(self.measures))
        _need((self.time_dimension is None) == (self.granularity is None), f"rollup {self.name!r} needs both time_dimension and granularity, or neither")


@dataclass(frozen=True, kw_only=True)
class Cube:
    name: str
    alias: str
    backend: str = "main"
    table: str = ""
    source: PhysicalTable | DerivedTable | None = None
    measures: tuple[Measure, ...] = ()
    dimensions: tuple[Dimension, ...] = ()
    time_dimensions: tuple[TimeDimension, ...] = ()
    segments: tuple[Segment, ...] = ()
    joins: tuple[Join, ...] = ()
    base_predicate: str | None = None
    required_filters: tuple[str, ...] = ()
    timezone: str | None = None
    week_start: str = "monday"
    primary_key: str | None = None
    extends: str | None = None
    tenancy: str = "none"
    tenancy_columns: tuple[str, ...] = ()
    security_sql: str | None = None
    security_ctx_keys: tuple[str, ...] = ()
    scope: str | None = None
    required_roles: tuple[str, ...] = ()
    rollups: tuple[Rollup, ...] = ()
    physical_sources: tuple[TimePartitionedSource, ...] = ()
    time_partition: TimePartition | None = None
    stability: str = "stable"
    replacement: str | None = None
    size_hint: int | None = None
    description: str = ""
    display_name: str | None = None
    default_chart_type: str | None = None
    drill_paths: tuple[tuple[str, ...], ...] = ()
    questions: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    relations: str = ""
    expose_in_prompt: bool = True
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            if isinstance(value := getattr(self, name), list):
                object.__setattr__(self, name, tuple(value))
        _need(re.fullmatch(r"[A-Za-z_]\w*", self.name), f"{self.name!r} is not a cube name")
        _need(re.fullmatch(r"[A-Za-z_]\w*", self.alias), f"cube {self.name!r}: {self.alias!r} is not an alias")
        _one_of(f"cube {self.name!r}: tenancy", self.tenancy, TENANCY_MODES)
        _one_of(f"cube {self.name!r}: week_start", self.week_start, ("monday", "sunday"))
        _one_of(f"cube {self.name!r}: stability", self.stability, STABILITIES)
        _need((self.tenancy == "discriminator") == bool(self.tenancy_columns), f"cube {self.name!r}: discriminator tenancy and tenancy_columns belong together")
        _need(self.size_hint is None or self.size_hint >= 0, f"cube {self.name!r}: size_hint is negative")
        given = [bool(self.table), self.source is not None, bool(self.physical_sources)]
        _need(sum(given) == 1 or (not any(given) and (self.extends or self.backend == META)), f"cube {self.name!r} needs exactly one of table, source and physical_sources")
        names = [f.name for f in self.fields()]
        _need(len(set(names)) == len(names), f"cube {self.name!r}: a field is named twice: {sorted(n for n in names if names.count(n) > 1)}")
        self._check_parts()

    def _check_parts(self) -> None:
        _need(bool(self.physical_sources) == (self.time_partition is not None), f"cube {self.name!r}: physical_sources and time_partition belong together")
        if self.time_partition:
            _need(self.time_partition.time_dimension in {t.name for t in self.time_dimensions}, f"cube {self.name!r}: time_partition names no time dimension of it")
            names = [s.name for s in self.physical_sources]
            _need(len(set(names)) == len(names), f"cube {self.name!r}: a physical source is named twice")
        measures = {m.name: m for m in self.measures}
        for m in self.measures:
            if m.agg == "ratio" and not self.extends:
                for part in (m.numerator, m.denominator):
                    _need(part in measures, f"ratio {self.name}.{m.name}: no measure {part!r}")
                    _need(measures[part].agg != "ratio", f"ratio {self.name}.{m.name}: {part!r} is a ratio itself")
        dims, times = {d.name for d in self.dimensions}, {t.name: t for t in self.time_dimensions}
        for r in self.rollups if not self.extends else ():
            _need(len({x.name for x in self.rollups}) == len(self.rollups), f"cube {self.name!r}: a rollup is named twice")
            for d in r.dimensions:
                _need(d in dims, f"rollup {r.name!r}: no dimension {d!r}")
            for name in r.measures:
                _need(name in measures, f"rollup {r.name!r}: no measure {name!r}")
                _need(measures[name].agg in DISTRIBUTIVE, f"rollup {r.name!r}: {name!r} ({measures[name].agg}) cannot be aggregated again")
            if r.time_dimension:
                _need(r.time_dimension in times and r.granularity in times[r.time_dimension].granularities, f"rollup {r.name!r}: no {r.granularity} of {r.time_dimension!r}")

    def fields(self) -> list[BaseField]:
        return [*self.measures, *self.dimensions, *self.time_dimensions, *self.segments]

    def get(self, name: str) -> BaseField | None:
        for f in self.fields():
            if f.name == name or name in getattr(f, "aliases", ()):
                return f
        return None

    def with_(self, **changes: Any) -> Cube:
        return replace(self, **changes)


@dataclass(frozen=True, kw_only=True)
class View:
    """Renamed fields of cubes under one name."""

    name: str
    fields: Mapping[str, str] = field(hash=False)
    description: str = ""
    display_name: str | None = None

    def __post_init__(self):
        _need(self.fields, f"view {self.name!r} has no fields")
        for out, ref in self.fields.items():
            _need(re.fullmatch(r"\w+\.\w+", ref), f"view {self.name!r}: {out!r} must name cube.field, not {ref!r}")


@dataclass(frozen=True, kw_only=True)
class AuthContext:
    viewer_id: str
    tenant: str | None = None
    roles: tuple[str, ...] = ()
    attrs: Mapping[str, Any] = field(default_factory=dict, hash=False)
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        object.__setattr__(self, "roles", tuple(self.roles))


@dataclass(frozen=True)
class ScopePredicate:
    """A row-level predicate; ``{ctx.key}`` in it is a bound value."""

    sql: str
    ctx_keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class ResolutionContext:
    viewer: AuthContext | None = None
    context: Mapping[str, str] = field(default_factory=dict, hash=False)


@dataclass(frozen=True, kw_only=True)
class GlossaryEntry:
    term: str
    definition: str
    aliases: tuple[str, ...] = ()

    def __post_init__(self):
        _need(self.term.strip() and self.definition.strip() and all(a.strip() for a in self.aliases), "a glossary entry needs a term, a definition and no empty alias")


@dataclass(frozen=True, kw_only=True)
class Lookup:
    """The vocabulary of a string dimension, and how to attach labels to its values."""

    dimension: str
    values: tuple[str, ...] | None = None
    labels: Mapping[str, str] | None = field(default=None, hash=False)
    loader: Callable[[ResolutionContext], list[str]] | None = None
    enricher: Any = None
    max_inline: int = 50
    description: str = ""

    def __post_init__(self):
        _need(re.fullmatch(r"\w+\.\w+", self.dimension), f"lookup {self.dimension!r} must name cube.dimension")
        _need(any(x is not None for x in (self.values, self.labels, self.loader, self.enricher)), f"lookup {self.dimension!r} has no values, labels, loader or enricher")
        _need(self.max_inline >= 0, f"lookup {self.dimension!r}: max_inline is negative")


@dataclass(frozen=True, kw_only=True)
class Entity:
    """A business object read row by row: its key, its fields, what it may be listed by."""

    name: str
    cubes: tuple[str, ...]
    key: str | None = None
    fields: Mapping[str, str] = field(default_factory=dict, hash=False)
    list_filters: tuple[str, ...] = ()
    default_order: str | None = None
    custom_backend: bool = False
    description: str = ""
    questions: tuple[str, ...] = ()
    keywords: tuple[str, ...] = ()
    metadata: Mapping[str, Any] = field(default_factory=dict, hash=False)

    def __post_init__(self):
        _need(self.name.strip(), "an entity needs a name")
        object.__setattr__(self, "cubes", tuple(self.cubes))
        _need(self.cubes and all(self.cubes), f"entity {self.name!r} needs cubes")
        for ref in [*self.fields.values(), *self.list_filters, *([self.key] if self.key else [])]:
            _need(re.fullmatch(r"\w+\.\w+", ref), f"entity {self.name!r}: {ref!r} must name cube.field")
        if self.default_order:
            _need(re.fullmatch(r"\w+\.\w+(\s+(asc|desc))?", self.default_order), f"entity {self.name!r}: default_order {self.default_order!r}")
        _need(not self.custom_backend or len(self.cubes) == 1, f"entity {self.name!r}: a custom backend serves one cube")


@dataclass(frozen=True)
class CtxRef:
    """A value taken from the viewer: ``viewer_id``, ``tenant`` or a key of ``attrs``."""

    attr: str


@dataclass(frozen=True, kw_only=True)
class MutableField:
    type: str
    required: bool = False
    nullable: bool = True
    immutable: bool = False


@dataclass(frozen=True, kw_only=True)
class MutableEntity(Entity):
    target_cube: str
    operations: frozenset[str]
    mutable_fields: Mapping[str, MutableField] = field(default_factory=dict, hash=False)
    pinned_values: Mapping[str, CtxRef] = field(default_factory=dict, hash=False)
    required_roles: tuple[str, ...] = ()
    predicate_targeting: bool = False

    def __post_init__(self):
        super().__post_init__()
        _need(self.key, f"mutable entity {self.name!r} needs a key")
        _need(self.target_cube in self.cubes, f"mutable entity {self.name!r}: target_cube is not one of its cubes")
        _need(self.operations and set(self.operations) <= {"insert", "update", "delete", "upsert"}, f"mutable entity {self.name!r}: operations {sorted(self.operations)}")
        _need(not set(self.pinned_values) & set(self.mutable_fields), f"mutable entity {self.name!r}: a pinned column cannot be mutable")
