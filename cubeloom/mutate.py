"""Writes to an entity's table: checked, previewed, then returned as the table that would result.

Parquet has no update; so a write is a pair of DataFrames: the rows it touches, and the whole table
afterwards, ready to be written and swapped. Nothing is written before ``apply``.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.engine import Engine
from cubeloom.errors import AuthError, MutationError, unknown
from cubeloom.model import AuthContext, Cube, MutableEntity
from cubeloom.operators.predicates import filter_column, literal
from cubeloom.plans.logical import bind_kind
from cubeloom.query import Filter


@dataclass(frozen=True, kw_only=True)
class Mutation:
    entity: str
    operation: str
    values: Mapping[str, Any] | None = None
    key: Any = None
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class CompiledMutation:
    """``preview`` has the rows as they are that the write touches; ``after`` the table once it is done."""

    mutation: Mutation
    table: str
    preview: DataFrame
    after: DataFrame
    max_rows: int

    def affected(self) -> int:
        """How many rows are touched, refused above the cap."""
        n = self.preview.limit(self.max_rows + 1).count()
        if n > self.max_rows:
            raise MutationError(f"the write would touch more than {self.max_rows} rows", cap=self.max_rows)
        return n

    def apply(self, path: str) -> int:
        """Check the cap and write the new table to a fresh folder, for the caller to swap in."""
        n = self.affected()
        self.after.write.mode("error").parquet(path)
        return n


def compile_mutation(engine: Engine, m: Mutation, *, viewer: AuthContext | None = None) -> CompiledMutation:
    catalog = engine.catalog
    if not catalog.allow_mutations:
        raise MutationError("this catalog allows no writes")
    e = catalog.entities.get(m.entity)
    if e is None:
        raise unknown("entity", m.entity, catalog.entities)
    if not isinstance(e, MutableEntity):
        raise MutationError(f"entity {m.entity!r} is read-only")
    if m.operation not in e.operations:
        raise MutationError(f"entity {m.entity!r} does not allow {m.operation}")
    if e.required_roles and (viewer is None or not set(e.required_roles) & set(viewer.roles)):
        raise AuthError(f"{m.operation} of {m.entity!r} is not available", reason="role")
    cube = catalog.cubes[e.target_cube]
    if not catalog.sees(cube, viewer):
        raise AuthError(f"{m.operation} of {m.entity!r} is not available", reason="cube")
    if cube.security_sql or cube.scope:
        raise MutationError(f"the row rules of {cube.name!r} are SQL, which a write cannot keep")
    table = engine.sources.load(cube.backend, cube.table)
    tenant = _tenant(cube, viewer)
    build = {"insert": _insert, "upsert": _upsert, "update": _update, "delete": _delete}[m.operation]
    preview, after = build(engine, m, e, cube, table, tenant, viewer)
    return CompiledMutation(m, cube.table, preview, after, catalog.max_mutation_rows)


def _tenant(cube: Cube, viewer: AuthContext | None) -> dict[str, str]:
    if cube.tenancy != "discriminator":
        return {}
    if viewer is None or viewer.tenant is None:
        raise AuthError(f"writes to {cube.name!r} need a tenant", reason="tenancy")
    return dict.fromkeys(cube.tenancy_columns, viewer.tenant)


def _column_of(cube: Cube, name: str) -> str:
    """The physical column that a field is; a computed field cannot be written."""
    f = cube.get(name)
    sql = f.sql.replace("`", "").strip() if f is not None else f"{{{cube.alias}}}.{name}"
    for prefix in (f"{{{cube.alias}}}.", f"{{{cube.name}}}."):
        if sql.startswith(prefix) and sql[len(prefix) :].isidentifier():
            return sql[len(prefix) :]
    raise MutationError(f"{cube.name}.{name} is computed and cannot be written")


def _values(m: Mutation, e: MutableEntity, cube: Cube, table: DataFrame, viewer: AuthContext | None, insert: bool) -> dict[str, Column]:
    given = dict(m.values or {})
    if not given and not insert:
        raise MutationError("an update changes something")
    out: dict[str, Column] = {}
    types = {f.name: f.dataType for f in table.schema.fields}
    for name, value in given.items():
        if name in e.pinned_values:
            raise MutationError(f"{name!r} is set by the system")
        spec = e.mutable_fields.get(name)
        if spec is None:
            raise unknown("writable field", name, e.mutable_fields)
        if spec.immutable and not insert:
            raise MutationError(f"{name!r} cannot be changed")
        if value is None:
            if not spec.nullable:
                raise MutationError(f"{name!r} cannot be null")
            column = F.lit(None)
        else:
            Filter(dimension=name, op="eq", values=(value,)).check(spec.type)
            column = literal(value, spec.type, None)
        physical = _column_of(cube, name)
        out[physical] = column.cast(types[physical])
    if insert:
        for name, spec in e.mutable_fields.items():
            if spec.required and name not in given:
                raise MutationError(f"{name!r} is required")
        for name, ref in e.pinned_values.items():
            if viewer is None:
                raise AuthError(f"{name!r} is taken from the viewer, and there is none", reason="pinned")
            value = getattr(viewer, ref.attr, None) if ref.attr in ("viewer_id", "tenant") else viewer.attrs.get(ref.attr)
            if value is None:
                raise AuthError(f"the viewer has no {ref.attr!r}", reason="pinned")
            physical = _column_of(cube, name)
            out[physical] = F.lit(value).cast(types[physical])
    return out


def _key_condition(m: Mutation, e: MutableEntity, cube: Cube, engine: Engine, tenant: dict[str, str], by_predicate: bool = True) -> Column:
    conditions = [F.col(c) == F.lit(v) for c, v in tenant.items()]
    if m.key is not None:
        name = e.key.rpartition(".")[2]
        Filter(dimension=e.key, op="eq", values=(m.key,)).check(bind_kind(cube.get(name)))
        conditions.append(F.col(_column_of(cube, name)) == F.lit(m.key))
    elif m.filters and by_predicate:
        if not e.predicate_targeting:
            raise MutationError(f"entity {e.name!r} is written by key only")
        for f in m.filters:
            if f.dimension not in e.list_filters:
                raise MutationError(f"entity {e.name!r} cannot be targeted by {f.dimension!r}")
            field = engine.catalog.field(f.dimension)
            f.check(bind_kind(field))
            conditions.append(filter_column(f, F.col(_column_of(cube, field.name)), bind_kind(field)))
    else:
        raise MutationError("the write names no rows")
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def _row(table: DataFrame, values: dict[str, Column], engine: Engine) -> DataFrame:
    return engine.spark.range(1).select(*[values.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in table.schema.fields])


def _insert(engine, m, e, cube, table, tenant, viewer):
    values = _values(m, e, cube, table, viewer, True)
    types = {f.name: f.dataType for f in table.schema.fields}
    values |= {c: F.lit(v).cast(types[c]) for c, v in tenant.items()}
    row = _row(table, values, engine)
    return row, table.unionByName(row)


def _upsert(engine, m, e, cube, table, tenant, viewer):
    """Replace the row with the key in ``values``, or add it."""
    name = e.key.rpartition(".")[2]
    key = (m.values or {}).get(name, m.key)
    if key is None:
        raise MutationError(f"an upsert needs the key {name!r}")
    values = _values(m, e, cube, table, viewer, True)
    types = {f.name: f.dataType for f in table.schema.fields}
    physical = _column_of(cube, name)
    values |= {physical: F.lit(key).cast(types[physical])} | {c: F.lit(v).cast(types[c]) for c, v in tenant.items()}
    target = Mutation(entity=m.entity, operation=m.operation, key=key)
    condition = _key_condition(target, e, cube, engine, tenant)
    row = _row(table, values, engine)
    # Where there is a row, columns that are not given keep their values.
    found = table.filter(condition).select(*[values.get(c, F.col(c)).alias(c) for c in table.columns])
    fresh = row.join(table.filter(condition).limit(1).select(F.lit(True).alias("__there")), F.lit(True), "left").filter("__there is null").drop("__there")
    changed = found.unionByName(fresh)
    return changed, table.filter(~condition).unionByName(changed)


def _update(engine, m, e, cube, table, tenant, viewer):
    values = _values(m, e, cube, table, viewer, False)
    condition = _key_condition(m, e, cube, engine, tenant)
    after = table.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in table.columns])
    return table.filter(condition), after


def _delete(engine, m, e, cube, table, tenant, viewer):
    condition = _key_condition(m, e, cube, engine, tenant)
    return table.filter(condition), table.filter(~condition)


