"""What changed between two catalogs, and which changes break queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from cubeloom.catalog import Catalog
from cubeloom.model import META

#: Changes after which a query may fail or mean something else.
BREAKING = ("cube_removed", "field_removed", "field_kind_changed", "field_type_changed", "field_sql_changed", "measure_agg_changed", "join_removed", "join_changed", "required_filter_added", "roles_tightened", "cube_primary_key_changed", "field_alias_removed")


@dataclass(frozen=True)
class Change:
    kind: str
    where: str
    before: Any = None
    after: Any = None

    @property
    def breaking(self) -> bool:
        return self.kind in BREAKING


def diff(old: Catalog, new: Catalog) -> list[Change]:
    out: list[Change] = []
    a = {n: c for n, c in old.cubes.items() if c.backend != META}
    b = {n: c for n, c in new.cubes.items() if c.backend != META}
    out += [Change("cube_removed", n) for n in a.keys() - b.keys()] + [Change("cube_added", n) for n in b.keys() - a.keys()]
    for name in a.keys() & b.keys():
        out += _cube(name, a[name], b[name])
    for kind, x, y in (("view", old.views, new.views), ("entity", old.entities, new.entities), ("lookup", old.lookups, new.lookups), ("saved_query", old.saved_queries, new.saved_queries)):
        out += [Change(f"{kind}_removed", n) for n in x.keys() - y.keys()] + [Change(f"{kind}_added", n) for n in y.keys() - x.keys()]
        out += [Change(f"{kind}_changed", n) for n in x.keys() & y.keys() if x[n] != y[n]]
    return sorted(out, key=lambda c: (not c.breaking, c.kind, c.where))


def _cube(name: str, x: Any, y: Any) -> list[Change]:
    out = []
    for what in ("table", "source", "base_predicate", "tenancy", "security_sql", "scope", "timezone", "week_start", "primary_key", "stability", "description", "backend"):
        if getattr(x, what) != getattr(y, what):
            out.append(Change(f"cube_{what}_changed", name, getattr(x, what), getattr(y, what)))
    f, g = {i.name: i for i in x.fields()}, {i.name: i for i in y.fields()}
    out += [Change("field_removed", f"{name}.{n}") for n in f.keys() - g.keys()] + [Change("field_added", f"{name}.{n}") for n in g.keys() - f.keys()]
    for n in f.keys() & g.keys():
        where, p, q = f"{name}.{n}", f[n], g[n]
        if p.kind != q.kind:
            out.append(Change("field_kind_changed", where, p.kind, q.kind))
            continue
        checks: list[tuple[str, Callable[[Any], Any]]] = [("field_sql_changed", lambda i: (i.sql, getattr(i, "filter", None), getattr(i, "numerator", None), getattr(i, "denominator", None))), ("field_type_changed", lambda i: getattr(i, "type", None)), ("measure_agg_changed", lambda i: getattr(i, "agg", None)), ("field_text_changed", lambda i: (i.description, i.display_name)), ("field_unit_changed", lambda i: getattr(i, "unit", None))]
        out += [Change(kind, where, get(p), get(q)) for kind, get in checks if get(p) != get(q)]
        before, after = (set(getattr(i, "aliases", ())) for i in (p, q))
        out += [Change("field_alias_removed", where, a) for a in sorted(before - after)] + [Change("field_alias_added", where, None, a) for a in sorted(after - before)]
        if set(q.required_roles) != set(p.required_roles):
            out.append(Change("roles_tightened" if q.required_roles and (not p.required_roles or set(q.required_roles) < set(p.required_roles)) else "roles_loosened", where, p.required_roles, q.required_roles))
    j, k = {i.to: i for i in x.joins}, {i.to: i for i in y.joins}
    out += [Change("join_removed", f"{name} -> {n}") for n in j.keys() - k.keys()] + [Change("join_added", f"{name} -> {n}") for n in k.keys() - j.keys()]
    out += [Change("join_changed", f"{name} -> {n}", j[n], k[n]) for n in j.keys() & k.keys() if (j[n].on, j[n].relationship) != (k[n].on, k[n].relationship)]
    out += [Change("required_filter_added", f"{name}.{r}") for r in set(y.required_filters) - set(x.required_filters)]
    out += [Change("required_filter_removed", f"{name}.{r}") for r in set(x.required_filters) - set(y.required_filters)]
    return out
