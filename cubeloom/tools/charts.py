"""Which chart shows a result best, decided from the kinds of its columns and its size."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from cubeloom.catalog import Catalog
from cubeloom.engine import ColumnMeta, Compiled

#: The charts that can be asked for, from most to least special.
CHARTS = ("big_number", "delta", "line", "area", "bar", "grouped_bar", "stacked_bar", "pie", "scatter", "heatmap", "table")
MAX_BARS, MAX_SERIES, MAX_SLICES = 50, 12, 6


@dataclass(frozen=True)
class Chart:
    kind: str
    x: str | None = None
    y: tuple[str, ...] = ()
    series: str | None = None
    reason: str = ""


def decide(columns: tuple[ColumnMeta, ...], n_rows: int, *, compared: bool = False, preferred: str | None = None, supported: Collection[str] = CHARTS) -> Chart:
    """The first fitting chart that is supported; a table always fits."""
    dims = [c for c in columns if c.kind == "dimension"]
    time = [c for c in columns if c.kind == "time"]
    values = [c for c in columns if c.kind in ("measure", "derived")]
    y = tuple(c.name for c in values)
    options: list[Chart] = []
    if not values:
        options.append(Chart("table", reason="there is nothing measured"))
    elif compared:
        base = tuple(c.name for c in values if c.name.endswith(("_current", "_prior")))
        options.append(Chart("delta", None, y, None, "one comparison") if not dims and not time else Chart("grouped_bar", (dims or time)[0].name, base, None, "two windows side by side"))
    elif not dims and not time:
        options.append(Chart("big_number", None, y, None, "one row"))
    elif time and not dims:
        options += [Chart("line", time[0].name, y, None, "values over time"), Chart("bar", time[0].name, y, None, "values over time")]
    elif time and len(dims) == 1:
        options += [Chart("line", time[0].name, y[:1], dims[0].name, "one line for each value"), Chart("stacked_bar", time[0].name, y[:1], dims[0].name, "values over time")]
    elif len(dims) == 1:
        parts = len(values) == 1 and values[0].additive and 1 < n_rows <= MAX_SLICES and not dims[0].ordinal
        if n_rows <= MAX_BARS:
            options.append(Chart("bar" if len(values) == 1 else "grouped_bar", dims[0].name, y, None, "values by one dimension"))
        elif len(values) >= 2:
            options.append(Chart("scatter", y[0], y[1:2], dims[0].name, "two values of many members"))
        if parts:
            options.append(Chart("pie", dims[0].name, y, None, "few parts of a whole"))
    elif len(dims) == 2 and len(values) == 1:
        if n_rows <= MAX_BARS * MAX_SERIES:
            options.append(Chart("heatmap" if n_rows > MAX_BARS else "stacked_bar" if values[0].additive else "grouped_bar", dims[0].name, y, dims[1].name, "one value by two dimensions"))
    options.append(Chart("table", reason="no chart fits better"))
    if preferred and preferred in supported:
        for o in options:
            if o.kind == preferred:
                return o
    return next((o for o in options if o.kind in supported), options[-1])


def decide_for(compiled: Compiled, n_rows: int, catalog: Catalog, supported: Collection[str] = CHARTS) -> Chart:
    cubes = {c for c in compiled.plan.cubes}
    preferred = {catalog.cubes[c].default_chart_type for c in cubes} - {None}
    return decide(compiled.columns, n_rows, compared=compiled.plan.query.compare is not None, preferred=preferred.pop() if len(preferred) == 1 else None, supported=supported)
