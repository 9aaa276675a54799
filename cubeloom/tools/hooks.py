"""Ready-made hooks around compiling: audit, row caps, tags."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame

from cubeloom.engine import Compiled
from cubeloom.model import AuthContext
from cubeloom.query import SemanticQuery


@dataclass(frozen=True)
class AuditEvent:
    at: float
    viewer: str | None
    query: SemanticQuery
    outcome: str
    detail: str = ""


@dataclass
class Audit:
    """Reports every compile, refused ones included; a sink that fails does not fail the query."""

    sink: Callable[[AuditEvent], None]
    failures: list[str] = field(default_factory=list)

    def _tell(self, event: AuditEvent) -> None:
        try:
            self.sink(event)
        except Exception as e:  # the sink is the caller's
            self.failures.append(str(e))

    def after(self, q: SemanticQuery, compiled: Compiled, viewer: AuthContext | None) -> None:
        self._tell(AuditEvent(time.time(), viewer and viewer.viewer_id, q, "compiled", ", ".join(compiled.plan.cubes)))

    def failed(self, q: SemanticQuery, error: Exception, viewer: AuthContext | None) -> None:
        self._tell(AuditEvent(time.time(), viewer and viewer.viewer_id, q, "refused", f"{type(error).__name__}: {error}"))


@dataclass(frozen=True)
class RowCap:
    """No result has more rows than this."""

    max_rows: int

    def rewrite(self, df: DataFrame, q: SemanticQuery, viewer: AuthContext | None) -> DataFrame:
        return df if q.limit is not None and q.limit <= self.max_rows else df.limit(self.max_rows)


@dataclass(frozen=True)
class QueryTag:
    """Names the jobs of a session after what asked for them."""

    tag: Callable[[SemanticQuery, AuthContext | None], str]

    def rewrite(self, df: DataFrame, q: SemanticQuery, viewer: AuthContext | None) -> DataFrame:
        df.sparkSession.sparkContext.setJobDescription(self.tag(q, viewer))
        return df


@dataclass(frozen=True)
class Rewriter:
    """Changes queries before they are planned."""

    change: Callable[[SemanticQuery, AuthContext | None], SemanticQuery]

    def before(self, q: SemanticQuery, viewer: AuthContext | None) -> SemanticQuery:
        return self.change(q, viewer)


Hook = Audit | RowCap | QueryTag | Rewriter | Any
