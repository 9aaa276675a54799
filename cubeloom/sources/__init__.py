"""Named sources: where a cube's table names are looked up.

A source is anything with ``load(spark, table) -> DataFrame``. All of them end up in one Catalyst plan,
so filters and columns are pushed into each scan by the optimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame, SparkSession

from cubeloom.errors import CompileError, unknown


class Source(Protocol):
    def load(self, spark: SparkSession, table: str) -> DataFrame: ...


@dataclass(frozen=True)
class Files:
    """Tables as files: ``<root>/<table>.<ending>`` in any format that Spark reads."""

    root: str
    format: str = "parquet"
    ending: str | None = None
    schemas: Mapping[str, Any] = field(default_factory=dict, hash=False)
    options: Mapping[str, str] = field(default_factory=dict, hash=False)

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.options)
        if table in self.schemas:
            reader = reader.schema(self.schemas[table])
        ending = self.format if self.ending is None else self.ending
        return reader.load(f"{self.root.rstrip('/')}/{table}{'.' + ending if ending else ''}")


@dataclass(frozen=True)
class Tables:
    """Tables and views of the session's catalog, under a schema if one is given."""

    schema: str | None = None

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.table(f"{self.schema}.{table}" if self.schema and "." not in table else table)


@dataclass(frozen=True)
class Frames:
    """DataFrames by name."""

    frames: Mapping[str, DataFrame] = field(hash=False)

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        if table not in self.frames:
            raise unknown("table", table, self.frames)
        return self.frames[table]


@dataclass(frozen=True)
class Jdbc:
    """Tables of a database; Spark pushes filters, columns and limits into its queries.

    ``partitions`` gives, by table, the column, bounds and number of parallel reads.
    """

    url: str
    options: Mapping[str, str] = field(default_factory=dict, hash=False)
    partitions: Mapping[str, Mapping[str, str]] = field(default_factory=dict, hash=False)

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        extra = {**self.options, **self.partitions.get(table, {})}
        return spark.read.format("jdbc").options(url=self.url, dbtable=table, **extra).load()


@dataclass(frozen=True)
class Rows:
    """Rows from Python: ``fetch(table)`` returns a schema and an iterable of tuples. For small sources."""

    fetch: Callable[[str], tuple[Any, Iterable[tuple]]]

    def load(self, spark: SparkSession, table: str) -> DataFrame:
        schema, rows = self.fetch(table)
        return spark.createDataFrame(list(rows), schema)


class Sources:
    """The sources by name, and the tables loaded from them, once each."""

    def __init__(self, spark: SparkSession, **named: Source):
        self.spark = spark
        self.named: dict[str, Source] = dict(named)
        self._loaded: dict[tuple[str, str], DataFrame] = {}

    def register(self, name: str, source: Source) -> None:
        self.named[name] = source
        self._loaded = {k: v for k, v in self._loaded.items() if k[0] != name}

    def get(self, name: str) -> Source:
        if name not in self.named:
            raise unknown("source", name, self.named)
        return self.named[name]

    def load(self, name: str, table: str) -> DataFrame:
        if (name, table) not in self._loaded:
            self._loaded[name, table] = self.get(name).load(self.spark, table)
        return self._loaded[name, table]

    def query(self, name: str, sql: str, tables: Iterable[str] = ()) -> DataFrame:
        """Run a cube's own SQL. Its tables are those of the session, or of the source by bare name.

        The names that the SQL reads come from Spark's own parser; each that the source knows is
        passed in as a DataFrame, so no session view is made or shadowed.
        """
        names = [*relations(self.spark, sql), *tables]
        bound: dict[str, DataFrame] = {}
        source = self.get(name)
        for table in dict.fromkeys(names):
            if isinstance(source, Tables) and not source.schema:
                continue
            try:
                bound[table] = self.load(name, table)
            except Exception as e:  # not a table of this source: the session may have it
                if not self.spark.catalog.tableExists(table):
                    raise CompileError(f"the SQL of a cube reads unknown table {table!r}") from e
        views = {t: f"__{name}_{t}".replace(".", "_") for t in bound}
        for t, df in bound.items():
            df.createOrReplaceTempView(views[t])
        return self.spark.sql(_renamed(sql, views))


def relations(spark: SparkSession, sql: str) -> list[str]:
    """The tables that a statement reads, without the CTEs that it defines itself."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    text = plan.toString()
    import re

    found = re.findall(r"'UnresolvedRelation \[([^\]]+)\]", text)
    ctes = {c.strip().lower() for group in re.findall(r"CTE \[([^\]]*)\]", text) for c in group.split(",")}
    return [t for t in dict.fromkeys(x.replace(", ", ".") for x in found) if t.lower() not in ctes]


def _renamed(sql: str, views: Mapping[str, str]) -> str:
    """The statement with table names after FROM, JOIN or a comma replaced, strings left alone."""
    import re

    if not views:
        return sql
    names = "|".join(sorted(map(re.escape, views), key=len, reverse=True))
    pattern = re.compile(rf"('(?:[^'\\]|\\.)*')|(?<=\bfrom\s)\s*({names})\b(?!\s*\.)|(?<=\bjoin\s)\s*({names})\b(?!\s*\.)", re.I)

    def to(m: re.Match) -> str:
        if m[1] is not None:
            return m[1]
        table = m[2] or m[3]
        known = next(v for k, v in views.items() if k.lower() == table.lower())
        return f"{known} AS {table.rpartition('.')[2]}" if not _has_alias(sql, m.end()) else known

    return pattern.sub(to, sql)


_AFTER = {"where", "group", "order", "having", "limit", "join", "inner", "left", "right", "full", "cross", "on", "union", "using", "lateral", "window", "natural", "except", "intersect", "tablesample", "semi", "anti"}


def _has_alias(sql: str, at: int) -> bool:
    import re

    m = re.match(r"\s+(?:as\s+)?([A-Za-z_]\w*)", sql[at:], re.I)
    return bool(m) and m[1].lower() not in _AFTER
