"""Vocabularies of dimensions: find the value that a text means, attach labels to results."""

from __future__ import annotations

import difflib
from collections.abc import Callable, Mapping
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubeloom.catalog import Catalog
from cubeloom.errors import CompileError, unknown
from cubeloom.model import Lookup, ResolutionContext
from cubeloom.query import Filter, SemanticQuery

MIN_SIMILARITY = 0.5
#: Reference rows above this are joined by a shuffle, not broadcast.
MAX_BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Candidate:
    value: str
    label: str | None
    score: float


@dataclass(frozen=True)
class Resolution:
    """``status`` is resolved, ambiguous or unknown."""

    status: str
    value: str | None
    candidates: tuple[Candidate, ...] = ()


def vocabulary(lookup: Lookup, ctx: ResolutionContext | None = None) -> dict[str, str | None]:
    """Values with their labels."""
    out: dict[str, str | None] = dict.fromkeys(lookup.values or ())
    out |= lookup.labels or {}
    if lookup.loader:
        for v in lookup.loader(ctx or ResolutionContext()):
            out.setdefault(v, None)
    return out


def resolve(catalog: Catalog, dimension: str, text: str, *, ctx: ResolutionContext | None = None, max_candidates: int = 5) -> list[Candidate]:
    """The values a text may mean, best first: equal, then containing it, then alike."""
    if dimension not in catalog.lookups:
        raise unknown("lookup", dimension, catalog.lookups)
    wanted = text.strip().lower()
    found = []
    for value, label in vocabulary(catalog.lookups[dimension], ctx).items():
        spelled = [s.lower() for s in (value, label) if s]
        if wanted in spelled:
            score = 1.0
        elif wanted and any(wanted in s for s in spelled):
            score = 0.9
        else:
            score = max(difflib.SequenceMatcher(None, wanted, s).ratio() for s in spelled)
            if score < MIN_SIMILARITY:
                continue
            score = min(score, 0.89)
        found.append(Candidate(value, label, score))
    return sorted(found, key=lambda c: (-c.score, c.value))[:max_candidates]


def outcome(candidates: list[Candidate]) -> Resolution:
    """One equal value, or a single candidate, is a resolution; several are not."""
    equal = [c for c in candidates if c.score == 1.0]
    if len(equal) == 1 or (not equal and len(candidates) == 1):
        return Resolution("resolved", (equal or candidates)[0].value, tuple(candidates))
    return Resolution("ambiguous" if candidates else "unknown", None, tuple(candidates))


def resolve_filters(q: SemanticQuery, catalog: Catalog, *, ctx: ResolutionContext | None = None) -> tuple[SemanticQuery, dict[str, Resolution]]:
    """Replace filter texts on dimensions with a vocabulary by the values they mean; doubtful ones stay."""
    notes: dict[str, Resolution] = {}

    def value(f: Filter, v: Any) -> Any:
        found = outcome(resolve(catalog, f.dimension, v, ctx=ctx))
        notes[f"{f.dimension}={v}"] = found
        return found.value if found.status == "resolved" else v

    filters = []
    for f in q.filters:
        if f.dimension in catalog.lookups and f.op in ("eq", "neq", "in", "not_in"):
            f = replace(f, values=tuple(value(f, v) if isinstance(v, str) else v for v in f.values))
        filters.append(f)
    return q.with_(filters=tuple(filters)), notes


def enrich(df: DataFrame, catalog: Catalog, dimensions: Mapping[str, str], *, ctx: ResolutionContext | None = None, only: Callable[[str], bool] | None = None) -> DataFrame:
    """Add ``<column>__label`` (or ``<column>__<field>``) for each column with a vocabulary.

    ``dimensions`` says which dimension a column is. A value without label labels itself. An enricher
    may be a DataFrame keyed by its first column: a reference table, broadcast if it is small.
    """
    for name, dimension in dimensions.items():
        lookup = catalog.lookups.get(dimension)
        if lookup is None or (only and not only(name)):
            continue
        if isinstance(lookup.enricher, DataFrame):
            df = join_reference(df, name, lookup.enricher)
            continue
        if lookup.enricher is not None:
            df = _by_function(df, name, lookup, ctx)
            continue
        known = {v: label for v, label in vocabulary(lookup, ctx).items() if label}
        df = df.withColumn(f"{name}__label", _labels(F.col(f"`{name}`"), known))
    return df


def _labels(c: Any, known: Mapping[str, str]) -> Any:
    if not known:
        return c.cast("string")
    pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c.cast("string")), c.cast("string"))


def join_reference(df: DataFrame, name: str, reference: DataFrame) -> DataFrame:
    """Attach the other columns of a reference table; its keys must be unique."""
    key, *fields = reference.columns
    renamed = reference.select(F.col(f"`{key}`").alias("__ref"), *[F.col(f"`{f}`").alias(f"{name}__{f}") for f in fields])
    small = renamed.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS
    out = df.join(F.broadcast(renamed) if small else renamed, F.col(f"`{name}`") == F.col("__ref"), "left").drop("__ref")
    if "label" in fields:
        out = out.withColumn(f"{name}__label", F.coalesce(f"{name}__label", F.col(f"`{name}`").cast("string")))
    return out


def _by_function(df: DataFrame, name: str, lookup: Lookup, ctx: ResolutionContext | None) -> DataFrame:
    """A Python enricher sees the distinct values of a result, which must be no more than it can inline."""
    limit = max(lookup.max_inline, 10_000)
    values = [r[0] for r in df.select(F.col(f"`{name}`").cast("string")).distinct().limit(limit + 1).collect() if r[0] is not None]
    if len(values) > limit:
        raise CompileError(f"{name!r} has more than {limit} values; give its lookup a reference table")
    found = lookup.enricher(values, ctx or ResolutionContext())
    fields = sorted({k for v in found.values() if isinstance(v, Mapping) for k in v})
    if not fields:
        return df.withColumn(f"{name}__label", _labels(F.col(f"`{name}`"), {k: v for k, v in found.items() if v is not None}))
    for field in fields:
        known = {k: str(v[field]) for k, v in found.items() if isinstance(v, Mapping) and v.get(field) is not None}
        pairs = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
        df = df.withColumn(f"{name}__{field}", F.try_element_at(pairs, F.col(f"`{name}`").cast("string")))
    return df
