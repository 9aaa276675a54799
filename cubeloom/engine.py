"""From a logical plan to a lazy DataFrame.

Every source becomes a scan with its isolation predicates, scans are joined in plan order, one filter
holds all row predicates, one aggregation all measures. Nothing here runs a job; Catalyst prunes the
columns, pushes the filters and picks the joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property, reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.catalog import Catalog, reflection_rows
from cubeloom.errors import AuthError, CompileError, EngineError, unknown
from cubeloom.model import META, QUANTILES, AuthContext, Cube, DerivedTable, Dimension, Measure
from cubeloom.operators.aggregates import PARTS, combine, measure_column, measure_value, partial, total
from cubeloom.operators.fragments import column, restrict, substitute
from cubeloom.operators.predicates import filter_column, tree_column
from cubeloom.operators.timegrain import bucket, spine
from cubeloom.plans import rollup as rollups
from cubeloom.plans.logical import LogicalPlan, Output, Ref, bind_kind, build_plan, compare_column, equal_columns, output_for, overlapping
from cubeloom.query import Filter, SemanticQuery
from cubeloom.sources import Sources
from cubeloom.streaming.chunks import CHUNK_ROWS, iter_chunks, iter_rows

#: What a field is cast to where it declares another type to compare by.
CASTS = {"string": "string", "number": "double", "uuid": "string", "bool": "boolean", "date": "date", "time": "timestamp_ntz"}
_PLAIN = re.compile(r"\s*\{(\w+)\}\.`?(\w+)`?\s*")
COMPARED = ("current", "prior", "delta", "pct_change")


@dataclass(frozen=True)
class ColumnMeta:
    """What a result column is, for programs that show it."""

    name: str
    kind: str
    type: str | None = None
    field: str | None = None
    unit: str | None = None
    display_unit: str | None = None
    format: str | None = None
    display_name: str | None = None
    masked: bool = False
    additive: bool = False
    ordinal: bool = False
    grain: str | None = None


@dataclass(frozen=True)
class Compiled:
    """A query as a lazy DataFrame with what is known about it."""

    df: DataFrame
    plan: LogicalPlan
    rollup: str | None = None
    physical_sources: tuple[str, ...] = ()
    derived_sources: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()

    @cached_property
    def columns(self) -> tuple[ColumnMeta, ...]:
        """What each column is; the types are those of the analysed plan."""
        return _meta(self.plan, self.df)

    def rows(self) -> list[dict[str, Any]]:
        return [r.asDict() for r in self.df.collect()]

    def iter_rows(self) -> Iterator[dict[str, Any]]:
        return iter_rows(self.df)

    def iter_chunks(self, rows: int = CHUNK_ROWS) -> Iterator[list[dict[str, Any]]]:
        return iter_chunks(self.df, rows)


@dataclass
class _Env:
    """What lowering one plan needs, and what it notes on the way."""

    catalog: Catalog
    sources: Sources
    viewer: AuthContext | None
    context: Mapping[str, Any]
    cubes: dict[str, Cube]  # with a rollup or renames in place
    physical: list[str] = field(default_factory=list)
    derived: list[str] = field(default_factory=list)
    columns: dict[str, Column] = field(default_factory=dict)
    types: dict[str, dict[str, str]] = field(default_factory=dict)  # by alias and column

    def column(self, sql: str) -> Column:
        if sql not in self.columns:
            self.columns[sql] = column(sql, self.cubes, self.context)
        return self.columns[sql]

    def type(self, df: DataFrame, sql: str) -> str:
        """The Spark type of a fragment; of a plain column known without asking the analyser."""
        m = _PLAIN.fullmatch(sql)
        cube = next((c for n, c in self.cubes.items() if m and m[1] in (n, c.alias)), None)
        found = self.types.get(cube.alias, {}).get(m[2]) if cube is not None else None
        return found or _type(df, self.column(sql))


class Engine:
    """Answers queries about a catalog from named sources."""

    def __init__(self, spark: SparkSession, catalog: Catalog, sources: Sources | None = None, **named: Any):
        self.spark, self.catalog = spark, catalog
        self.sources = sources or Sources(spark, **named)

    def explain(self, q: SemanticQuery, viewer: AuthContext | None = None, one_source: bool = True) -> LogicalPlan:
        """The logical plan alone."""
        return self._routed(build_plan(self._prepared(q), self.catalog, viewer, one_source))

    def compile(self, q: SemanticQuery, *, viewer: AuthContext | None = None, context: Mapping[str, Any] | None = None, one_source: bool = True) -> Compiled:
        """The query as a DataFrame; no job runs. Refusals raise typed errors, through the catalog's hooks."""
        try:
            for hook in self.catalog.hooks:
                q = hook.before(q, viewer) if hasattr(hook, "before") else q
            plan = build_plan(self._prepared(q), self.catalog, viewer, one_source)
            compiled = self._lower(self._routed(plan), viewer, context or {})
            for hook in self.catalog.hooks:
                if hasattr(hook, "rewrite"):
                    compiled = replace(compiled, df=hook.rewrite(compiled.df, q, viewer))
                if hasattr(hook, "after"):
                    hook.after(q, compiled, viewer)
            return compiled
        except EngineError as e:
            for hook in self.catalog.hooks:
                if hasattr(hook, "failed"):
                    hook.failed(q, e, viewer)
            if self.catalog.error_transform:
                raise self.catalog.error_transform(e) from e
            raise

    def compile_plan(self, plan: LogicalPlan, *, viewer: AuthContext | None = None, context: Mapping[str, Any] | None = None) -> Compiled:
        """A plan made or changed by a caller: its query is planned again, so no check is skipped."""
        return self.compile(plan.query, viewer=viewer, context=context)

    def query(self, q: SemanticQuery, **how: Any) -> DataFrame:
        return self.compile(q, **how).df

    def saved(self, name: str, viewer: AuthContext | None = None, **how: Any) -> Compiled:
        """A stored query by name, if the viewer has one of its roles."""
        if name not in self.catalog.saved_queries:
            raise unknown("saved query", name, self.catalog.saved_queries)
        s = self.catalog.saved_queries[name]
        if viewer is not None and s.required_roles and not set(s.required_roles) & set(viewer.roles):
            raise AuthError(f"saved query {name!r} is not available", reason="saved_query")
        if s.stability == "deprecated":
            raise CompileError(f"saved query {name!r} is deprecated" + (f"; use {s.replacement!r}" if s.replacement else ""))
        return self.compile(s.query, viewer=viewer, **how)

    def _prepared(self, q: SemanticQuery) -> SemanticQuery:
        return self.catalog.defaults.apply(q) if self.catalog.defaults else q

    def _routed(self, plan: LogicalPlan) -> LogicalPlan:
        found = rollups.pick(plan, self.catalog.cubes[plan.root])
        return replace(plan, rollup=(plan.root, found.name)) if found else plan

    # -- lowering

    def _lower(self, plan: LogicalPlan, viewer: AuthContext | None, context: Mapping[str, Any]) -> Compiled:
        ctx = dict(context)
        if viewer is not None:
            ctx.setdefault("ctx.viewer_id", viewer.viewer_id)
            if viewer.tenant is not None:
                ctx.setdefault("tenant", viewer.tenant)
                ctx.setdefault("tenant_schema", viewer.tenant)
            for k, v in viewer.attrs.items():
                ctx.setdefault(f"ctx.{k}", v)
        env = _Env(self.catalog, self.sources, viewer, ctx, dict(self.catalog.cubes))
        if plan.rollup:
            env.cubes[plan.root] = _as_rollup(self.catalog.cubes[plan.root], plan.rollup[1], plan)
        if plan.symmetric:
            df = self._symmetric(plan, env)
        elif plan.query.compare:
            df = self._compare(plan, env)
        elif plan.query.ungrouped:
            df = self._listing(plan, env)
        else:
            df = self._grouped(plan, env)
        df = self._ordered(df, plan)
        return Compiled(df, plan, plan.rollup and plan.rollup[1], tuple(env.physical), tuple(env.derived), plan.warnings)

    def scan(self, name: str, plan: LogicalPlan, env: _Env) -> DataFrame:
        """A cube's rows that the viewer may see, under its alias."""
        cube = env.cubes[name]
        df = self._source(cube, plan, env)
        env.types[cube.alias] = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        df = df.alias(cube.alias)
        for col in cube.tenancy_columns if cube.tenancy == "discriminator" else ():
            value = env.context.get(col, env.context.get("tenant") if len(cube.tenancy_columns) == 1 else None)
            if value is None:
                raise AuthError(f"cube {name!r} needs a value for tenancy column {col!r}", reason="tenancy")
            df = df.filter(F.col(f"{cube.alias}.`{col}`") == F.lit(value)).alias(cube.alias)
        if cube.security_sql:
            if missing := [k for k in cube.security_ctx_keys if f"ctx.{k}" not in env.context]:
                raise CompileError(f"cube {name!r} needs context values {missing}")
            df = restrict(df, cube.alias, cube.security_sql, env.cubes, env.context).alias(cube.alias)
        if cube.scope and env.viewer is not None:
            fn = env.catalog.scope_fns.get(cube.scope)
            if fn is None:
                raise AuthError(f"cube {name!r}: no scope function {cube.scope!r}", reason="scope")
            found = fn(cube, env.viewer)
            if found is not None:
                if missing := [k for k in found.ctx_keys if k not in env.context and f"ctx.{k}" not in env.context]:
                    raise CompileError(f"scope {cube.scope!r} needs context values {missing}")
                df = restrict(df, cube.alias, found.sql, env.cubes, env.context).alias(cube.alias)
        return df

    def _source(self, cube: Cube, plan: LogicalPlan, env: _Env) -> DataFrame:
        if cube.backend == META:
            rows = reflection_rows(cube.name, env.catalog.visible(env.viewer).values())
            return self.spark.createDataFrame(rows, ", ".join(f"{d.name} string" for d in cube.dimensions))
        if cube.physical_sources:
            window = overlapping(cube, plan)
            found = [s for s in cube.physical_sources if s.overlaps(window)]
            env.physical += [s.name for s in found]
            parts = []
            for s in found or cube.physical_sources[:1]:
                df = self.sources.load(cube.backend, substitute(s.table, {}, env.context))
                parts.append(df.withColumnsRenamed({physical: logical for logical, physical in s.column_renames.items()}))
            union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            return union if found else union.limit(0)
        if isinstance(cube.source, DerivedTable):
            sql = substitute(cube.source.sql, {}, env.context)
            ctes = [f"{c.name} AS ({substitute(c.sql, {}, env.context)})" for c in cube.source.with_ctes]
            full = f"WITH {', '.join(ctes)} {sql}" if ctes else sql
            env.derived.append(full)
            return self.sources.query(cube.backend, full)
        table = cube.table or cube.source.table
        if cube.tenancy == "schema" and "{tenant_schema}" in table and "tenant_schema" not in env.context:
            raise AuthError(f"cube {cube.name!r} needs a tenant", reason="tenancy")
        return self.sources.load(cube.backend, substitute(table, {}, env.context))

    def joined(self, plan: LogicalPlan, env: _Env) -> DataFrame:
        """All cubes joined and all row predicates applied, but for the time window."""
        df = self.scan(plan.root, plan, env)
        for s in plan.steps:
            df = df.join(self.scan(s.right, plan, env), self._on(s, env), "left" if s.right in plan.left else "inner")
        conditions = self._conditions(plan, env, df)
        return df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df

    def _on(self, step: Any, env: _Env) -> Column:
        """The join condition; keys whose dimensions declare another type to compare by are cast on both sides."""
        columns = equal_columns(step.join.on)
        sides = []
        for name in (step.left, step.right):
            cube = env.cubes[name]
            own = next((c for a, c in (columns or {}).items() if a in (cube.alias, name)), None)
            field = next((d for d in cube.dimensions if d.coerce_to and own and d.sql.replace("`", "") in (f"{{{cube.alias}}}.{own}", f"{{{name}}}.{own}")), None)
            sides.append((f"{{{cube.alias}}}.{own}", field))
        to = next((f.coerce_to for _, f in sides if f is not None), None)
        if to is None:
            return env.column(step.join.on)
        left, right = (env.column(sql).cast(CASTS[to]) for sql, _ in sides)
        return left == right

    def _conditions(self, plan: LogicalPlan, env: _Env, df: DataFrame) -> list[Column]:
        out = [env.column(env.cubes[c].base_predicate) for c in plan.cubes if env.cubes[c].base_predicate]
        out += [self._filter(ref, f, env, df) for ref, f in plan.filters]
        if plan.where is not None:
            out.append(tree_column(plan.where, lambda f: self._filter(plan.where_refs[f.dimension], f, env, df)))
        out += [env.column(s.field.sql) for s in plan.segments]
        return out

    def _filter(self, ref: Ref, f: Filter, env: _Env, df: DataFrame) -> Column:
        sql = _field(ref, env).sql
        c = env.column(sql)
        kind = bind_kind(ref.field)
        spark_type = env.type(df, sql) if kind in ("time", "date") else None
        if isinstance(ref.field, Dimension) and ref.field.coerce_to:
            c = c.cast(CASTS[kind])
        return filter_column(f, c, kind, spark_type)

    def _windowed(self, df: DataFrame, plan: LogicalPlan, env: _Env, window: tuple[str, str] | None) -> DataFrame:
        """The half-open window, on the raw column."""
        inside = self._inside(df, plan, env, window)
        return df if inside is None else df.filter(inside)

    def _inside(self, df: DataFrame, plan: LogicalPlan, env: _Env, window: tuple[str, str] | None) -> Column | None:
        if plan.time is None or window is None:
            return None
        c = env.column(_field(plan.time, env).sql)
        t = env.type(df, _field(plan.time, env).sql)
        low, high = (filter_column(Filter(dimension=plan.time.key, op=op, values=(v,)), c, "time", t) for op, v in (("gte", window[0]), ("lt", window[1])))
        return low & high

    def _key(self, o: Output, df: DataFrame, env: _Env) -> Column:
        sql = _field(o.ref, env).sql
        c = env.column(sql)
        if o.masked:
            return _mask(o.ref.field, env.type(df, sql))
        if o.grain:
            cube = env.cubes[o.ref.cube]
            c = bucket(c, o.grain, env.type(df, sql), cube.week_start, cube.timezone) if not _stored_bucket(cube) else c
        return c

    def _listing(self, plan: LogicalPlan, env: _Env) -> DataFrame:
        df = self._windowed(self.joined(plan, env), plan, env, plan.query.time_dimension and plan.query.time_dimension.range)
        return df.select(*[self._key(o, df, env).alias(o.name) for o in (*plan.outputs, *plan.hidden)])

    def _aggregated(self, df: DataFrame, plan: LogicalPlan, env: _Env, hidden: bool = True) -> DataFrame:
        """Grouped by all dimensions and the bucket, with measures, hidden ones and operands."""
        keys = [o for o in plan.outputs if o.kind in ("dimension", "time")]
        extra = list(plan.hidden) if hidden else []
        measures = [*(o for o in plan.outputs if o.kind == "measure"), *extra]
        columns, together = self._columns(measures, env)
        columns += [measure_column(env.cubes[r.cube], _field(r, env), env.cubes, env.context).alias(f"__operand_{i}") for i, r in enumerate(plan.operands.values())]
        if not columns:
            return df.select(*[self._key(o, df, env).alias(o.name) for o in keys]).distinct()
        if not keys:
            grouped = df.agg(*columns)
        else:
            # The expression is grouped by, a mask or a bucket, never a column that has its name.
            grouped = df.groupBy(*[self._key(o, df, env).alias(o.name) for o in keys]).agg(*columns)
        return grouped.withColumns(together) if together else grouped

    def _columns(self, measures: list[Output], env: _Env, within: Column | None = None, suffix: str = "") -> tuple[list[Column], dict[str, Column]]:
        """The aggregates of measures over the rows ``within``, and those that are then taken from a shared one."""
        shared = self._quantiles(measures, env, within)
        columns = [c.alias(f"__quantiles_{i}{suffix}") for i, (c, _) in enumerate(shared)]
        together = {f"{name}{suffix}": F.col(f"`__quantiles_{i}{suffix}`")[k] for i, (_, names) in enumerate(shared) for k, name in enumerate(names)}
        columns += [self._measure(o, env, within).alias(f"{o.name}{suffix}") for o in measures if f"{o.name}{suffix}" not in together]
        return columns, together

    def _quantiles(self, measures: list[Output], env: _Env, within: Column | None = None) -> list[tuple[Column, list[str]]]:
        """Several quantiles of one expression share one pass over its values."""
        groups: dict[tuple, list[Output]] = {}
        for o in measures:
            m = _field(o.ref, env)
            if m.agg in QUANTILES and not o.masked:
                groups.setdefault((o.ref.cube, m.sql, m.filter), []).append(o)
        out = []
        for (_, sql, condition), found in groups.items():
            if len(found) > 1:
                value = env.column(sql)
                value = F.when(env.column(condition), value) if condition else value
                value = value if within is None else F.when(within, value)
                shares = F.array(*[F.lit(QUANTILES[_field(o.ref, env).agg]) for o in found])
                out.append((F.percentile(value, shares), [o.name for o in found]))
        return out

    def _measure(self, o: Output, env: _Env, within: Column | None = None) -> Column:
        m = _field(o.ref, env)
        c = measure_column(env.cubes[o.ref.cube], m, env.cubes, env.context, within)
        return _mask(o.ref.field, "double") if o.masked else c

    def _grouped(self, plan: LogicalPlan, env: _Env) -> DataFrame:
        q = plan.query
        window = q.time_dimension.range if q.time_dimension else None
        df = self._totalled_first(plan, env) if plan.partial else None
        base = None
        if df is None:
            base = self._windowed(self.joined(plan, env), plan, env, window)
            df = self._aggregated(base, plan, env)
        if any(o.masked and o.kind == "measure" for o in plan.outputs):
            df = df.withColumns({o.name: F.lit(o.ref.field.mask_value) if o.ref.field.mask_value is not None else F.lit(None).cast("double") for o in plan.outputs if o.masked and o.kind == "measure"})
        operand = {r: F.col(f"__operand_{i}") for i, r in enumerate(plan.operands)}
        by_name: dict[str, Column] = {}
        for o in plan.outputs:
            if o.kind == "derived":
                parts = [operand[x] if x in operand else by_name[x] if x in by_name else _missing(x, plan) for x in o.derived.operands]
                by_name[o.name] = combine(o.derived.op, parts)
                df = df.withColumn(o.name, by_name[o.name])
        for f in q.having:
            df = df.filter(_having(f, plan))
        if q.time_dimension and q.time_dimension.fill_nulls_with is not None:
            df = self._filled(df, plan, env, base)
        if not (plan.operands or q.time_dimension and q.time_dimension.fill_nulls_with is not None or self._quantiles([o for o in plan.outputs if o.kind == "measure"], env)):
            return df  # the columns are as asked for, in order
        return df.select(*[F.col(f"`{o.name}`") for o in (*plan.outputs, *plan.hidden)])

    def _totalled_first(self, plan: LogicalPlan, env: _Env) -> DataFrame | None:
        """The grouped result by way of totals per join key: what is joined is a row per key, not per fact.

        None where the query does not allow it: measures of other cubes or of aggregates that have no
        parts, joins that multiply rows, or a filter tree over both sides of a join.
        """
        root, cube = plan.root, env.cubes[plan.root]
        measures = [o for o in (*plan.outputs, *plan.hidden) if o.kind == "measure"]
        tree = {r.cube for r in plan.where_refs.values()}
        fits = plan.steps and measures and not plan.operands and not any(o.kind == "derived" for o in plan.outputs)
        fits = fits and all(o.ref.cube == root and o.ref.field.agg in PARTS and not o.masked for o in measures)
        fits = fits and not any(s.multiplies for s in plan.steps) and len(tree) < 2 and (plan.time is None or plan.time.cube == root)
        if not fits or plan.query.time_dimension and plan.query.time_dimension.fill_nulls_with is not None:
            return None

        def conditions(cubes: set[str], df: DataFrame) -> list[Column]:
            out = [env.column(env.cubes[c].base_predicate) for c in plan.cubes if c in cubes and env.cubes[c].base_predicate]
            out += [self._filter(r, f, env, df) for r, f in plan.filters if r.cube in cubes]
            if plan.where is not None and tree <= cubes:
                out.append(tree_column(plan.where, lambda f: self._filter(plan.where_refs[f.dimension], f, env, df)))
            return out + [env.column(x.field.sql) for x in plan.segments if x.cube in cubes]

        df = self.scan(root, plan, env)
        found = conditions({root}, df)
        df = df.filter(reduce(lambda a, b: a & b, found)) if found else df
        df = self._windowed(df, plan, env, plan.query.time_dimension and plan.query.time_dimension.range)
        keys = [o for o in plan.outputs if o.kind in ("dimension", "time")]
        own = {o.name: f"__own_{i}" for i, o in enumerate(keys) if o.ref.cube == root}
        used = [c for s in plan.steps for a, c in re.findall(r"\{(\w+)\}\.`?(\w+)`?", s.join.on) if a in (cube.alias, root)]
        by = [F.col(f"{cube.alias}.`{c}`").alias(c) for c in dict.fromkeys(used)]
        by += [self._key(o, df, env).alias(own[o.name]) for o in keys if o.name in own]
        parts = [p for i, o in enumerate(measures) for p in partial(o.ref.field.agg, measure_value(_field(o.ref, env), env.cubes, env.context), f"__part_{i}")]
        df = df.groupBy(*by).agg(*parts).alias(cube.alias)
        for s in plan.steps:
            df = df.join(self.scan(s.right, plan, env), self._on(s, env), "left" if s.right in plan.left else "inner")
        found = conditions(set(plan.cubes) - {root}, df)
        df = df.filter(reduce(lambda a, b: a & b, found)) if found else df
        totals = [total(o.ref.field.agg, [F.col(f"__part_{i}_{k}") for k in range(len(PARTS[o.ref.field.agg]))]).alias(o.name) for i, o in enumerate(measures)]
        named = [(F.col(f"{cube.alias}.{own[o.name]}") if o.name in own else self._key(o, df, env)).alias(o.name) for o in keys]
        return df.groupBy(*named).agg(*totals) if named else df.agg(*totals)

    def _filled(self, df: DataFrame, plan: LogicalPlan, env: _Env, base: DataFrame) -> DataFrame:
        o = next(o for o in plan.outputs if o.kind == "time")
        cube = env.cubes[o.ref.cube]
        kind = env.type(base, _field(o.ref, env).sql)
        all_buckets = spine(self.spark, plan.query.time_dimension.range, o.grain, kind, o.name, cube.week_start, cube.timezone)
        filled = all_buckets.join(df, o.name, "left")
        value = plan.query.time_dimension.fill_nulls_with
        # Strings (masks) are left as they are.
        return filled.fillna(value, [x.name for x in (*plan.outputs, *plan.hidden) if x.kind != "time"])

    def _compare(self, plan: LogicalPlan, env: _Env) -> DataFrame:
        """Two windows side by side, from one scan of both; equal keys meet, null keys never do."""
        base = self.joined(plan, env)
        windows = {"current": self._inside(base, plan, env, plan.query.time_dimension.range), "prior": self._inside(base, plan, env, plan.prior)}
        base = base.filter(windows["current"] | windows["prior"])
        wanted = [o for o in plan.outputs if o.kind == "measure"]
        columns, together = [], {}
        for side, inside in windows.items():
            own, shared = self._columns(wanted, env, inside, f"_{side}")
            columns += [F.count(F.when(inside, F.lit(1))).alias(f"__{side}"), *own]
            together |= shared
        named = [o for o in plan.outputs if o.kind in ("dimension", "time")]
        keys, measures = [o.name for o in named], [o.name for o in wanted]
        both = base.groupBy(*[self._key(o, base, env).alias(o.name) for o in named]).agg(*columns)
        both = both.withColumns(together) if together else both
        if keys:
            present = {side: F.col(f"__{side}") > 0 for side in windows}
            null = reduce(lambda x, y: x | y, [F.col(f"`{k}`").isNull() for k in keys])
            apart = F.array(*[F.lit(side) for side in windows])
            both = both.withColumn("__side", F.explode(F.when(null & present["current"] & present["prior"], apart).otherwise(F.array(F.lit("both")))))
            # A window without rows of a key has no value there, not a count of 0.
            both = both.withColumns({f"{m}_{side}": F.when(present[side] & F.col("__side").isin("both", side), F.col(f"`{m}_{side}`")) for m in measures for side in windows})
        columns = [F.col(f"`{k}`") for k in keys]
        for m in measures:
            current, prior = F.col(f"`{m}_current`"), F.col(f"`{m}_prior`")
            columns += [current, prior, (F.coalesce(current, F.lit(0)) - F.coalesce(prior, F.lit(0))).alias(f"{m}_delta"), F.when(prior > 0, (current - prior) * 100.0 / prior).alias(f"{m}_pct_change")]
        df = both.select(*columns)
        for f in plan.query.having:
            name = compare_column(f.dimension, plan.outputs) or _compared_default(f.dimension, plan)
            f.check("number")
            df = df.filter(filter_column(f, F.col(f"`{name}`"), "number"))
        return df

    def _symmetric(self, plan: LogicalPlan, env: _Env) -> DataFrame:
        """Each fact totalled by the shared key on its own; then the totals meet at the bridge.

        Facts of one source meet one another first, so a bridge row without any fact is not shown;
        with facts in several sources every bridge row is.
        """
        sym = plan.symmetric
        measures = [o for o in (*plan.outputs, *plan.hidden) if o.kind == "measure"]
        totals = []
        for i, fact in enumerate(sym.facts):
            cube = env.cubes[fact.cube]
            df = self.scan(fact.cube, plan, env)
            conditions = [env.column(cube.base_predicate)] if cube.base_predicate else []
            conditions += [self._filter(r, f, env, df) for r, f in plan.filters if r.cube == fact.cube]
            df = df.filter(reduce(lambda a, b: a & b, conditions)) if conditions else df
            own = [self._measure(o, env).alias(o.name) for o in measures if o.ref.cube == fact.cube]
            totals.append(df.groupBy(env.column(fact.key_sql).alias(f"__k{i}")).agg(*own))
        bridge_cube = env.cubes[sym.bridge]
        bridge = self.scan(sym.bridge, plan, env)
        conditions = [env.column(bridge_cube.base_predicate)] if bridge_cube.base_predicate else []
        conditions += [self._filter(r, f, env, bridge) for r, f in plan.filters if r.cube == sym.bridge]
        bridge = bridge.filter(reduce(lambda a, b: a & b, conditions)) if conditions else bridge
        keys = [o for o in plan.outputs if o.kind == "dimension"]
        bridge = bridge.select(env.column(sym.bridge_key_sql).alias("__bridge"), *[self._key(o, bridge, env).alias(o.name) for o in keys])
        if len({env.cubes[f.cube].backend for f in sym.facts} | {bridge_cube.backend}) == 1:
            met = totals[0].withColumnRenamed("__k0", "__key")
            for i, t in enumerate(totals[1:], 1):
                met = met.join(t, F.col("__key") == F.col(f"__k{i}"), "full_outer").withColumn("__key", F.coalesce("__key", f"__k{i}")).drop(f"__k{i}")
            df = bridge.join(met, F.col("__bridge") == F.col("__key"), "inner")
        else:
            df = reduce(lambda left, i: left.join(totals[i], F.col("__bridge") == F.col(f"__k{i}"), "left"), range(len(totals)), bridge)
        sums = [F.sum(F.col(f"`{o.name}`")).alias(f"__m_{o.name}") for o in measures]
        out = df.groupBy(*[F.col(f"`{o.name}`") for o in keys]).agg(*sums)
        for o in measures:
            out = out.withColumnRenamed(f"__m_{o.name}", o.name)
        return out.select(*[F.col(f"`{o.name}`") for o in (*plan.outputs, *plan.hidden)])

    def _ordered(self, df: DataFrame, plan: LogicalPlan) -> DataFrame:
        q = plan.query
        order = []
        for text, way in q.order:
            name = compare_column(text, plan.outputs) if q.compare else None
            if q.compare and name is None:
                name = _compared_default(text, plan)
            if name is None:
                hidden = next((o for o in plan.hidden if o.ref.text == text), None)
                found = output_for(text, plan.outputs) or hidden
                name = found.name
            c = F.col(f"`{name}`")
            order.append(c.asc_nulls_last() if way == "asc" else c.desc_nulls_last())
        if order:
            df = df.orderBy(*order)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return df.drop(*[o.name for o in plan.hidden]) if plan.hidden else df


def _field(ref: Ref, env: _Env) -> Any:
    """The field as the cube in place has it (a rollup's cube has others than the base's)."""
    return env.cubes[ref.cube].get(ref.name)


def _type(df: DataFrame, c: Column) -> str:
    return df.select(c.alias("x")).schema["x"].dataType.simpleString()


def _mask(f: Any, spark_type: str) -> Column:
    if f.mask_value is not None:
        return F.lit(f.mask_value)
    return F.lit(None).cast("double" if isinstance(f, Measure) else spark_type)


def _missing(name: str, plan: LogicalPlan) -> Column:
    found = output_for(name, plan.outputs, "measure")
    if found is None:
        raise unknown("operand", name, [o.name for o in plan.outputs])
    return F.col(f"`{found.name}`")


def _having(f: Filter, plan: LogicalPlan) -> Column:
    found = output_for(f.dimension, plan.outputs, "measure", "derived")
    if found is None:
        raise CompileError(f"HAVING names {f.dimension!r}, which is no measure of this query")
    f.check("number")
    return filter_column(f, F.col(f"`{found.name}`"), "number")


def _compared_default(text: str, plan: LogicalPlan) -> str:
    found = output_for(text, plan.outputs)
    if found is None:
        raise unknown("column", text, [o.name for o in plan.outputs])
    return f"{found.name}_current" if found.kind == "measure" else found.name


def _stored_bucket(cube: Cube) -> bool:
    return bool(cube.metadata.get("rollup_of"))


def _as_rollup(cube: Cube, name: str, plan: LogicalPlan) -> Cube:
    """The cube over a rollup's table: stored columns, counts summed, what is baked in left out."""
    r = next(x for x in cube.rollups if x.name == name)
    prefix = "{" + cube.alias + "}."

    def measure(m: Measure) -> Measure:
        agg = "sum" if m.agg in ("sum", "count") else m.agg
        sql = f"{prefix}{m.name}"
        return replace(m, agg=agg, sql=f"{sql}", filter=None)

    measures = tuple(measure(m) for m in cube.measures if m.name in r.measures)
    if plan is not None and not any(o.kind in ("dimension", "time") for o in plan.outputs):
        # Over no rows a count is 0, where a sum is null.
        measures = tuple(replace(m, sql=m.sql, metadata={**m.metadata, "zero": True}) if cube.get(m.name).agg == "count" else m for m in measures)
    dims = tuple(replace(d, sql=f"{prefix}{d.name}") for d in cube.dimensions if d.name in r.dimensions)
    times = tuple(replace(t, sql=f"{prefix}{t.name}_{r.granularity}") for t in cube.time_dimensions if t.name == r.time_dimension)
    return cube.with_(table=r.physical_table, source=None, physical_sources=(), time_partition=None, base_predicate=None, measures=measures, dimensions=dims, time_dimensions=times, segments=(), rollups=(), metadata={**cube.metadata, "rollup_of": cube.name}, drill_paths=(), required_filters=(), primary_key=None, joins=())


def _meta(plan: LogicalPlan, df: DataFrame) -> tuple[ColumnMeta, ...]:
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = []
    for o in plan.outputs:
        f = o.ref.field if o.ref else None
        names = [f"{o.name}_{x}" for x in COMPARED] if plan.query.compare and o.kind == "measure" else [o.name]
        for name in names:
            out.append(
                ColumnMeta(
                    name,
                    o.kind,
                    types.get(name),
                    o.ref.key if o.ref else None,
                    getattr(f, "unit", None),
                    getattr(f, "display_unit", None),
                    "percent" if name.endswith("_pct_change") and plan.query.compare else getattr(f, "format", None),
                    getattr(f, "display_name", None),
                    o.masked,
                    isinstance(f, Measure) and f.additive,
                    getattr(f, "ordinal", False),
                    o.grain,
                )
            )
    return tuple(out)


