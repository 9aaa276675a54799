"""The catalog in words: Markdown, an ER diagram, field references, prompt text within a budget."""

from __future__ import annotations

import json
import keyword
import re
from collections.abc import Mapping
from typing import Any

from cubeloom.catalog import Catalog, sees_field
from cubeloom.functions.lookups import vocabulary
from cubeloom.model import META, AuthContext, Cube


def shown(catalog: Catalog, viewer: AuthContext | None) -> list[Cube]:
    return [c for c in catalog.visible(viewer).values() if c.backend != META and c.expose_in_prompt]


def markdown(catalog: Catalog, viewer: AuthContext | None = None) -> str:
    """A reference page of all that the viewer may use."""
    out = ["# Catalog"]
    for c in shown(catalog, viewer):
        out += ["", f"## {c.display_name or c.name}", "", f"`{c.name}`" + (f": {c.description}" if c.description else "")]
        if c.stability != "stable":
            out += ["", f"Stability: {c.stability}" + (f"; use `{c.replacement}`" if c.replacement else "")]
        fields = [f for f in c.fields() if sees_field(f, viewer)]
        if fields:
            out += ["", "| field | kind | type | description |", "|-|-|-|-|"]
            out += [f"| `{f.name}` | {f.kind} | {getattr(f, 'agg', None) or getattr(f, 'type', '')} | {_cell(f.description)} |" for f in fields]
        if c.joins:
            out += ["", "Joins: " + ", ".join(f"`{j.to}` ({j.relationship.replace('_', ' ')})" for j in c.joins)]
        if c.required_filters:
            out += ["", "Needs a filter on: " + ", ".join(f"`{r}`" for r in c.required_filters)]
    if catalog.glossary:
        out += ["", "## Glossary", ""] + [f"- **{g.term}**" + (f" ({', '.join(g.aliases)})" if g.aliases else "") + f": {g.definition}" for g in catalog.glossary]
    return "\n".join(out) + "\n"


def _cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\n", " ")


def dot(catalog: Catalog, viewer: AuthContext | None = None) -> str:
    """Cubes and joins as a DOT graph."""
    cubes = shown(catalog, viewer)
    names = {c.name for c in cubes}
    ends = {"many_to_one": ("crow", "tee"), "one_to_many": ("tee", "crow"), "one_to_one": ("tee", "tee")}
    out = ["digraph catalog {", "  rankdir=LR;", "  node [shape=record];"]
    for c in cubes:
        rows = [_escape(f"{f.name}: {getattr(f, 'agg', None) or getattr(f, 'type', f.kind)}") for f in c.fields() if sees_field(f, viewer)]
        out.append(f'  "{c.name}" [label="{{{_escape(c.name)}|{"\\l".join(rows)}\\l}}"];')
    for c in cubes:
        for j in c.joins:
            if j.to in names:
                tail, head = ends[j.relationship]
                out.append(f'  "{c.name}" -> "{j.to}" [dir=both, arrowtail={tail}, arrowhead={head}];')
    return "\n".join([*out, "}"]) + "\n"


def _escape(text: str) -> str:
    return re.sub(r'([{}|<>"\\ ])', r"\\\1", text)


def field_module(catalog: Catalog) -> str:
    """Python source with a class of references per cube, so that a typo is a name error."""
    out = ['"""Field references, generated from the catalog."""', ""]
    for c in catalog.cubes.values():
        if c.backend == META:
            continue
        out += ["", f"class {''.join(p.title() for p in c.name.split('_'))}:"]
        lines = [f'    {f.name + "_" if keyword.iskeyword(f.name) else f.name} = "{c.name}.{f.name}"' for f in c.fields()]
        out += lines or ["    pass"]
    return "\n".join(out) + "\n"


def prompt(catalog: Catalog, viewer: AuthContext | None = None, max_chars: int | None = None, only: list[str] | None = None) -> str:
    """A compact description for a language model. Over budget, details go first, whole cubes last."""
    cubes = [c for c in shown(catalog, viewer) if only is None or c.name in only]
    for detail in (3, 2, 1):
        parts = [_prompt_cube(c, catalog, viewer, detail) for c in cubes]
        text = "\n\n".join(parts + ([_terms(catalog)] if catalog.glossary and detail > 1 else []))
        if max_chars is None or len(text) <= max_chars:
            return text
    out: list[str] = []
    for p in parts:
        if sum(map(len, out)) + 2 * len(out) + len(p) > max_chars:
            break
        out.append(p)
    return "\n\n".join(out)


def _prompt_cube(c: Cube, catalog: Catalog, viewer: AuthContext | None, detail: int) -> str:
    fields = [f for f in c.fields() if sees_field(f, viewer)]
    if detail == 1:
        return f"{c.name}: " + ", ".join(f.name for f in fields)
    lines = [f"cube {c.name}" + (f" - {c.description}" if c.description else "")]
    for f in fields:
        kind = getattr(f, "agg", None) or getattr(f, "type", "")
        line = f"  {f.kind} {c.name}.{f.name}" + (f" ({kind})" if kind else "")
        if detail == 3 and f.description:
            line += f": {f.description}"
        lookup = catalog.lookups.get(f"{c.name}.{f.name}")
        if lookup is not None and not lookup.loader and detail == 3 and 0 < len(known := vocabulary(lookup)) <= lookup.max_inline:
            line += " one of " + json.dumps(sorted(known), ensure_ascii=False)
        lines.append(line)
    if c.required_filters:
        lines.append("  needs a filter on " + ", ".join(c.required_filters))
    return "\n".join(lines)


def _terms(catalog: Catalog) -> str:
    return "\n".join(f"{g.term}: {g.definition}" for g in catalog.glossary)


def query_schema() -> dict[str, Any]:
    """The JSON schema of a query, without references, as tool calls want it."""
    scalar = {"type": ["string", "number", "boolean"]}
    names = {"type": "array", "items": {"type": "string"}}
    filter_ = {"type": "object", "required": ["dimension", "op"], "additionalProperties": False, "properties": {"dimension": {"type": "string"}, "op": {"type": "string", "enum": ["eq", "neq", "in", "not_in", "gt", "lt", "gte", "lte", "contains", "is_null", "not_null"]}, "values": {"type": "array", "items": scalar}}}
    tree = {"type": "object", "properties": {"op": {"type": "string", "enum": ["and", "or", "not"]}, "children": {"type": "array", "items": {"type": "object"}}}}
    pair = {"type": "array", "items": {"type": "string"}, "minItems": 2, "maxItems": 2}
    window = {"type": "object", "required": ["dimension"], "properties": {"dimension": {"type": "string"}, "range": pair, "granularity": {"type": "string", "enum": ["second", "minute", "hour", "day", "week", "month", "quarter", "year"]}, "fill_nulls_with": {"type": "integer"}}}
    derived = {"type": "object", "required": ["name", "op", "operands"], "properties": {"name": {"type": "string"}, "op": {"type": "string", "enum": ["ratio", "sum", "diff"]}, "operands": names}}
    properties: Mapping[str, Any] = {
        "measures": names,
        "dimensions": names,
        "segments": names,
        "time_dimension": window,
        "filters": {"type": "array", "items": filter_},
        "where": tree,
        "having": {"type": "array", "items": filter_},
        "compare": {"type": "object", "properties": {"mode": {"type": "string", "enum": ["previous_period", "explicit"]}, "range": pair}},
        "order": {"type": "array", "items": pair},
        "limit": {"type": "integer", "minimum": 0},
        "offset": {"type": "integer", "minimum": 0},
        "ungrouped": {"type": "boolean"},
        "derived_measures": {"type": "array", "items": derived},
        "left_joins": names,
        "aliases": {"type": "object", "additionalProperties": {"type": "string"}},
    }
    return {"type": "object", "additionalProperties": False, "properties": dict(properties)}
