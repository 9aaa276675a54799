"""Run compiled queries with a result cache, hooks and a read-only guard for raw SQL."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from cubeloom import federation
from cubeloom.engine import ColumnMeta, Engine
from cubeloom.errors import CompileError
from cubeloom.model import AuthContext
from cubeloom.query import SemanticQuery
from cubeloom.tools.safe import is_read_only


@dataclass(frozen=True)
class Result:
    """Rows on the driver, as many as asked for."""

    columns: tuple[ColumnMeta, ...]
    rows: tuple[tuple[Any, ...], ...]
    truncated: bool = False
    cached: bool = False

    def dicts(self) -> list[dict[str, Any]]:
        return [dict(zip([c.name for c in self.columns], r, strict=True)) for r in self.rows]


class RawRows(list):
    """Rows as dicts; ``truncated`` if there were more than asked for."""

    def __init__(self, rows: Iterable[dict[str, Any]], truncated: bool = False):
        super().__init__(rows)
        self.truncated = truncated


class ResultCache:
    """The latest results, by namespace and query; the oldest leave first, and all after their time.

    A namespace keeps the answers of one viewer or tenant from another's: it is part of the key.
    """

    def __init__(self, size: int = 0, ttl: float | None = None, clock: Callable[[], float] = time.monotonic):
        self.size, self.ttl, self.clock = size, ttl, clock
        self.entries: OrderedDict[Any, tuple[float, Result]] = OrderedDict()

    def get(self, key: Any) -> Result | None:
        found = self.entries.get(key)
        if found is None:
            return None
        if self.ttl is not None and self.clock() - found[0] > self.ttl:
            del self.entries[key]
            return None
        self.entries.move_to_end(key)
        return found[1]

    def put(self, key: Any, result: Result) -> None:
        if self.size <= 0:
            return
        self.entries[key] = (self.clock(), result)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def clear(self, namespace: str | None = None) -> None:
        for key in [k for k in self.entries if namespace is None or k[0] == namespace]:
            del self.entries[key]


class Runner:
    """Answers queries with rows; ``on_execute(query, seconds, rows, cached)`` is told of each.

    All rows of a result come, unless ``max_rows`` says how many; a result that it cuts says so. For
    results too large for the driver there is ``streaming.chunks``.
    """

    def __init__(self, engine: Engine, *, cache: ResultCache | None = None, max_rows: int | None = None, on_execute: Callable[[SemanticQuery, float, int, bool], None] | None = None):
        self.engine, self.cache, self.max_rows, self.on_execute = engine, cache or ResultCache(), max_rows, on_execute

    def run(self, q: SemanticQuery, *, viewer: AuthContext | None = None, context: Mapping[str, Any] | None = None, namespace: str = "") -> Result:
        began = time.monotonic()
        # A viewer's rights are checked on every call, before any cached answer is given.
        compiled = federation.run(self.engine, q, viewer=viewer, context=context)
        who = None if viewer is None else (viewer.viewer_id, viewer.tenant, viewer.roles, repr(sorted(viewer.attrs.items(), key=str)))
        key = (namespace, repr(q), who, repr(sorted((context or {}).items())))
        result = self.cache.get(key)
        cached = result is not None
        if result is None:
            rows, truncated = self._collect(compiled.df)
            result = Result(compiled.columns, tuple(map(tuple, rows)), truncated)
            self.cache.put(key, result)
        if self.on_execute:
            self.on_execute(q, time.monotonic() - began, len(result.rows), cached)
        return Result(result.columns, result.rows, result.truncated, cached)

    def _collect(self, df: DataFrame) -> tuple[list, bool]:
        if self.max_rows is None:
            return df.collect(), False
        rows = df.limit(self.max_rows + 1).collect()
        return rows[: self.max_rows], len(rows) > self.max_rows

    def run_raw(self, sql: str) -> RawRows:
        """Raw SQL of a trusted caller, if it is one statement that only reads."""
        if not is_read_only(self.engine.spark, sql):
            raise CompileError("only a single statement that reads is run")
        rows, truncated = self._collect(self.engine.spark.sql(sql))
        return RawRows((r.asDict() for r in rows), truncated)
