"""SQL fragments of the catalog as Columns: placeholders resolved, values bound, never spliced."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubeloom.errors import PlaceholderError
from cubeloom.model import Cube

_PLACEHOLDER = re.compile(r"\{([A-Za-z_]\w*)\}")
_MEMBER = re.compile(r"\{([A-Za-z_]\w*)\}\.([A-Za-z_]\w*)(?!\s*\()")
_BOUND = re.compile(r"\{(ctx\.[A-Za-z_]\w*)\}")
_SAFE = re.compile(r"[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*")


def substitute(sql: str, cubes: Mapping[str, Cube], context: Mapping[str, Any]) -> str:
    """Replace ``{alias}``, ``{cube}`` and ``{key}``; columns after an alias are quoted, so any name works."""
    names = {c.alias: c.alias for c in cubes.values()} | {n: c.alias for n, c in cubes.items()}

    def value(m: re.Match) -> str:
        key = m[1]
        if key in names:
            return names[key]
        if key in context:
            if not _SAFE.fullmatch(str(context[key])):
                raise PlaceholderError(f"the value of {{{key}}} is no plain name: {context[key]!r}", placeholder=key)
            return str(context[key])
        raise PlaceholderError(f"nothing defines {{{key}}}; known: {sorted({*names, *context})}", placeholder=key)

    sql = _MEMBER.sub(lambda m: f"{names[m[1]]}.`{m[2]}`" if m[1] in names else m[0], sql)
    return _PLACEHOLDER.sub(value, sql)


def column(sql: str, cubes: Mapping[str, Cube], context: Mapping[str, Any]) -> Column:
    return F.expr(substitute(sql, cubes, context))


def restrict(df: DataFrame, alias: str, sql: str, cubes: Mapping[str, Cube], context: Mapping[str, Any]) -> DataFrame:
    """Filter an aliased DataFrame by a predicate in which ``{ctx.key}`` is a bound value.

    A value becomes a literal column for as long as the predicate needs it, whatever it holds.
    """
    keys = list(dict.fromkeys(_BOUND.findall(sql)))
    for key in keys:
        if key not in context:
            raise PlaceholderError(f"nothing defines {{{key}}}", placeholder=key)
    names = {k: f"__bound_{i}" for i, k in enumerate(keys)}
    text = substitute(_BOUND.sub(lambda m: names[m[1]], sql), cubes, context)
    columns = df.columns
    held = df.select("*", *[F.lit(context[k]).alias(names[k]) for k in keys]).alias(alias)
    out = held.filter(F.expr(text))
    return out.select(*[F.col(f"{alias}.`{c}`") for c in columns]) if keys else out
