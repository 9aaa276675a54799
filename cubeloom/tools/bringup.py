"""From tables to a first catalog, and from a catalog back to check its tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubeloom.catalog import Catalog
from cubeloom.engine import Engine
from cubeloom.model import META, Cube, Dimension, Measure, TimeDimension
from cubeloom.operators.fragments import substitute

_KEY = re.compile(r"(.+?)_?(id|key)$")


def _kind(t: T.DataType) -> str | None:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "string"
    return None


def introspect(tables: Mapping[str, DataFrame], *, backend: str = "main") -> list[Cube]:
    """A cube per table from its schema alone: a row count, sums of numbers that are no keys, times, and
    foreign keys where a column is named after another table."""
    out, aliases = [], set()
    names = {_singular(t): t for t in tables}
    keys = {t: _primary(t, df.schema) for t, df in tables.items()}
    for table, df in tables.items():
        alias = _alias(table, aliases)
        dims, times, measures = [], [], [Measure(name="row_count", sql="*", agg="count")]
        for column in df.schema.fields:
            sql = f"{{{alias}}}.{column.name}"
            if isinstance(column.dataType, T.DateType):
                times.append(TimeDimension(name=column.name, sql=sql, type="date"))
            elif isinstance(column.dataType, T.TimestampType | T.TimestampNTZType):
                times.append(TimeDimension(name=column.name, sql=sql))
            elif kind := _kind(column.dataType):
                to = _foreign(column.name, table, names, keys)
                dims.append(Dimension(name=column.name, sql=sql, type=kind, foreign_key=to))
                if kind == "number" and not _KEY.match(column.name):
                    measures.append(Measure(name=f"total_{column.name}", sql=sql, agg="sum"))
        out.append(Cube(name=table, alias=alias, backend=backend, table=table, measures=measures, dimensions=dims, time_dimensions=times, primary_key=keys[table]))
    return out


def _singular(table: str) -> str:
    return table[:-3] + "y" if table.endswith("ies") else table[:-1] if table.endswith("s") and not table.endswith("ss") else table


def _alias(table: str, taken: set[str]) -> str:
    base = "".join(p[0] for p in table.split("_") if p) or "t"
    alias, n = base, 1
    while alias in taken or alias in ("as", "on", "or", "in", "is", "by"):
        n += 1
        alias = f"{base}{n}"
    taken.add(alias)
    return alias


def _primary(table: str, schema: T.StructType) -> str | None:
    for name in ("id", f"{_singular(table)}_id", f"{table}_id", f"{_singular(table)}_key"):
        if name in schema.fieldNames():
            return name
    return None


def _foreign(column: str, table: str, names: Mapping[str, str], keys: Mapping[str, str | None]) -> str | None:
    m = _KEY.match(column)
    target = names.get(m[1]) if m else None
    return f"{target}.{keys[target]}" if target and target != table and keys[target] else None


def session_tables(spark: SparkSession, schema: str | None = None) -> dict[str, DataFrame]:
    return {t.name: spark.table(f"{schema}.{t.name}" if schema else t.name) for t in spark.catalog.listTables(schema)}


@dataclass(frozen=True)
class Drift:
    where: str
    problem: str


def check_tables(engine: Engine, context: Mapping[str, Any] | None = None) -> list[Drift]:
    """Every fragment of the catalog, analysed against the tables as they are; no job runs."""
    out: list[Drift] = []
    catalog: Catalog = engine.catalog
    for cube in catalog.cubes.values():
        if cube.backend == META:
            continue
        try:
            df = _rows(engine, cube, context or {}).alias(cube.alias)
        except Exception as e:  # whatever the source raises is what is wrong with it
            out.append(Drift(cube.name, _first_line(e)))
            continue
        parts: list[tuple[str, str | None]] = [(f"{cube.name}.{f.name}", f.sql) for f in cube.fields() if f.sql.strip() not in ("", "*", "1")]
        parts += [(f"{cube.name}.{m.name} (filter)", m.filter) for m in cube.measures]
        parts += [(f"{cube.name} (base_predicate)", cube.base_predicate)]
        for where, sql in parts:
            if sql:
                out += _analyse(df, where, substitute(sql, {cube.name: cube}, {**(context or {})}))
        for d in cube.dimensions:
            found = _type_of(df, substitute(d.sql, {cube.name: cube}, context or {}))
            if found is not None and (kind := _kind(found)) is not None and d.type in ("string", "number", "bool") and kind != d.type:
                out.append(Drift(f"{cube.name}.{d.name}", f"declared {d.type}, the column is {found.simpleString()}"))
        for j in cube.joins:
            other = catalog.cubes[j.to]
            try:
                right = _rows(engine, other, context or {}).alias(other.alias)
                df.join(right, F.expr(substitute(j.on, {cube.name: cube, other.name: other}, context or {}))).schema  # noqa: B018
            except Exception as e:
                out.append(Drift(f"{cube.name} -> {j.to}", _first_line(e)))
    return out


def _rows(engine: Engine, cube: Cube, context: Mapping[str, Any]) -> DataFrame:
    from cubeloom.engine import _Env
    from cubeloom.plans.logical import LogicalPlan
    from cubeloom.query import SemanticQuery

    plan = LogicalPlan(SemanticQuery(), cube.name, (), (cube.name,), frozenset(), (), (), None, (), {})
    return engine._source(cube, plan, _Env(engine.catalog, engine.sources, None, context, dict(engine.catalog.cubes)))


def _analyse(df: DataFrame, where: str, sql: str) -> list[Drift]:
    try:
        df.select(F.expr(sql)).schema  # noqa: B018
        return []
    except Exception as e:
        return [Drift(where, _first_line(e))]


def _type_of(df: DataFrame, sql: str) -> T.DataType | None:
    try:
        return df.select(F.expr(sql).alias("x")).schema["x"].dataType
    except Exception:
        return None


def _first_line(e: Exception) -> str:
    return str(e).strip().splitlines()[0][:300]


def missing_columns(drift: Iterable[Drift]) -> list[str]:
    return [d.where for d in drift if "UNRESOLVED_COLUMN" in d.problem]
