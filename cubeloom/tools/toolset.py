"""The engine as named functions over JSON-like data, for any transport that calls tools."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict
from functools import partial
from typing import Any

from cubeloom import entities, federation, sqlfront
from cubeloom.engine import Engine
from cubeloom.errors import EngineError
from cubeloom.functions import lookups
from cubeloom.model import META, AuthContext
from cubeloom.mutate import CompiledMutation, Mutation, compile_mutation
from cubeloom.query import Filter, from_dict
from cubeloom.tools import charts, describe, search
from cubeloom.tools.validate import validate


class Toolset:
    """Tools bound to an engine and a viewer; refusals come back as payloads, not exceptions.

    Besides the general tools there is ``query_<cube>`` for each cube that the viewer sees, and those for
    entities where the catalog has some. ``write`` does what a compiled write says and returns how many
    rows it touched; without it writes can only be previewed.
    """

    def __init__(self, engine: Engine, viewer: AuthContext | None = None, max_rows: int = 1000, write: Callable[[CompiledMutation], int] | None = None):
        self.engine, self.viewer, self.max_rows, self.write = engine, viewer, max_rows, write
        self.tools: dict[str, Callable[..., Any]] = {
            "describe_catalog": self.describe_catalog,
            "search_catalog": self.search_catalog,
            "validate_query": self.validate_query,
            "run_query": self.run_query,
            "run_sql": self.run_sql,
            "run_saved_query": self.run_saved_query,
            "resolve_value": self.resolve_value,
            "explain_query": self.explain_query,
        }
        for cube in engine.catalog.visible(viewer).values():
            if cube.backend != META:
                self.tools[f"query_{cube.name}"] = partial(self._query_cube, cube.name)
        if engine.catalog.entities:
            self.tools |= {"get_entity": self.get_entity, "list_entity": self.list_entity}
        if engine.catalog.allow_mutations:
            self.tools["preview_write"] = self.preview_write
            if write is not None:
                self.tools["write_entity"] = self.write_entity

    def call(self, name: str, arguments: Mapping[str, Any]) -> dict[str, Any]:
        if name not in self.tools:
            return {"error": {"code": "UnknownTool", "message": f"no tool {name!r}; there are {sorted(self.tools)}"}}
        try:
            return {"result": self.tools[name](**arguments)}
        except EngineError as e:
            return {"error": e.to_payload()}
        except TypeError as e:
            return {"error": {"code": "BadArguments", "message": str(e)}}

    def describe_catalog(self, max_chars: int | None = None) -> str:
        return describe.prompt(self.engine.catalog, self.viewer, max_chars)

    def search_catalog(self, text: str, n: int = 10) -> list[dict[str, Any]]:
        found = search.WordIndex(search.entries(self.engine.catalog, self.viewer)).search(text, n)
        return [{"kind": h.entry.kind, "ref": h.entry.ref, "score": round(h.score, 4)} for h in found]

    def validate_query(self, query: Mapping[str, Any]) -> list[dict[str, str]]:
        return [asdict(p) for p in validate(from_dict(query), self.engine.catalog, viewer=self.viewer)]

    def _answer(self, compiled: Any) -> dict[str, Any]:
        rows = [r.asDict() for r in compiled.df.limit(self.max_rows + 1).collect()]
        chart = charts.decide_for(compiled, len(rows), self.engine.catalog)
        return {"columns": [asdict(c) for c in compiled.columns], "rows": rows[: self.max_rows], "truncated": len(rows) > self.max_rows, "chart": asdict(chart), "warnings": list(compiled.warnings)}

    def run_query(self, query: Mapping[str, Any]) -> dict[str, Any]:
        return self._answer(federation.run(self.engine, from_dict(query), viewer=self.viewer))

    def run_sql(self, sql: str) -> dict[str, Any]:
        return self._answer(self.engine.compile(sqlfront.parse_sql(sql, self.engine.catalog), viewer=self.viewer))

    def run_saved_query(self, name: str) -> dict[str, Any]:
        return self._answer(self.engine.saved(name, self.viewer))

    def resolve_value(self, dimension: str, text: str) -> list[dict[str, Any]]:
        return [asdict(c) for c in lookups.resolve(self.engine.catalog, dimension, text)]

    def explain_query(self, query: Mapping[str, Any]) -> str:
        return self.engine.explain(from_dict(query), self.viewer).describe()

    def _query_cube(self, cube: str, measures: Sequence[str] = (), dimensions: Sequence[str] = (), filters: Sequence[Mapping[str, Any]] = (), limit: int | None = None) -> dict[str, Any]:
        """A query of one cube, whose fields are named without it."""

        def full(name: str) -> str:
            return name if "." in name else f"{cube}.{name}"

        data = {"measures": tuple(map(full, measures)), "dimensions": tuple(map(full, dimensions)), "filters": [{**f, "dimension": full(f["dimension"])} for f in filters], "limit": limit}
        return self.run_query(data)

    def get_entity(self, entity: str, key: Any) -> dict[str, Any] | None:
        rows = entities.fetch(self.engine, entity, key, viewer=self.viewer).rows()
        return rows[0] if rows else None

    def list_entity(self, entity: str, filters: Sequence[Mapping[str, Any]] = (), order: str | None = None, limit: int = 100, cursor: str | None = None) -> dict[str, Any]:
        """A page of rows; ``next_cursor`` is null once a page is not full."""
        spec = entities.ListSpec(entity=entity, filters=tuple(Filter(**f) for f in filters), order=order, limit=limit, cursor=cursor)
        rows = entities.list_rows(self.engine, spec, viewer=self.viewer).rows()
        following = entities.next_page(spec, self.engine.catalog, rows[-1]).cursor if len(rows) == limit else None
        return {"rows": rows, "next_cursor": following}

    def _compiled_write(self, entity: str, operation: str, values: Mapping[str, Any] | None, key: Any, filters: Sequence[Mapping[str, Any]]) -> CompiledMutation:
        wanted = Mutation(entity=entity, operation=operation, values=values, key=key, filters=tuple(Filter(**f) for f in filters))
        return compile_mutation(self.engine, wanted, viewer=self.viewer)

    def preview_write(self, entity: str, operation: str, values: Mapping[str, Any] | None = None, key: Any = None, filters: Sequence[Mapping[str, Any]] = ()) -> dict[str, Any]:
        """The rows that a write would touch, as they are; refused above the catalog's cap."""
        compiled = self._compiled_write(entity, operation, values, key, filters)
        compiled.affected()
        rows = [r.asDict() for r in compiled.preview.collect()]  # no more than the cap
        return {"affected": len(rows), "rows": rows}

    def write_entity(self, entity: str, operation: str, values: Mapping[str, Any] | None = None, key: Any = None, filters: Sequence[Mapping[str, Any]] = ()) -> dict[str, Any]:
        compiled = self._compiled_write(entity, operation, values, key, filters)
        compiled.affected()
        return {"affected": self.write(compiled)}
