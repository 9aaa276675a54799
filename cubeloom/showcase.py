"""A catalog over the test tables, one query for each feature, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom import entities, federation, sqlfront
from cubeloom.catalog import Catalog
from cubeloom.engine import Engine
from cubeloom.errors import EngineError
from cubeloom.execution import ResultCache, Runner
from cubeloom.functions.lookups import enrich, resolve_filters
from cubeloom.functions.units import Units
from cubeloom.model import META, AuthContext, Cube, DerivedTable, Dimension, Entity, Join, Lookup, Measure, MutableEntity, MutableField, NamedCTE, Rollup, ScopePredicate, Segment, TimeDimension, TimePartition, TimePartitionedSource, View
from cubeloom.mutate import Mutation, compile_mutation
from cubeloom.query import BoolExpr, CompareWindow, Filter, InlineDerived, SavedQuery, SemanticQuery, SemiJoin, TimeWindow
from cubeloom.sources import Files, Sources
from cubeloom.tools import hooks, rewrite

DECIMALS = 4
#: A rollup and a partition of events are made once per session and folder.
SPLIT = "2024-01-15"


def _dim(alias: str, column: str, name: str | None = None, type: str = "string", **more) -> Dimension:
    return Dimension(name=name or column.split("_", 1)[1], sql=f"{{{alias}}}.{column}", type=type, **more)


def _count(name: str = "count") -> Measure:
    return Measure(name=name, sql="*", agg="count")


def catalog() -> Catalog:
    price = "{l}.l_extendedprice"
    revenue = "{l}.l_extendedprice * (1 - {l}.l_discount)"
    lineitem = Cube(
        name="lineitem",
        alias="l",
        table="lineitem",
        measures=[
            Measure(name="revenue", sql=revenue, agg="sum", unit="usd", format="currency"),
            Measure(name="qty", sql="{l}.l_quantity", agg="sum"),
            _count("rows"),
            Measure(name="avg_discount", sql="{l}.l_discount", agg="avg"),
            Measure(name="min_price", sql=price, agg="min"),
            Measure(name="max_price", sql=price, agg="max"),
            Measure(name="parts", sql="{l}.l_partkey", agg="count_distinct"),
            *[Measure(name=f"{q}_price", sql=price, agg=q) for q in ("median", "p75", "p90", "p95")],
            Measure(name="returned_qty", sql="{l}.l_quantity", agg="sum", filter="{l}.l_returnflag = 'R'"),
            Measure(name="return_rate", agg="ratio", numerator="returned_qty", denominator="qty"),
        ],
        dimensions=[_dim("l", "l_returnflag"), _dim("l", "l_linestatus"), _dim("l", "l_orderkey", type="number"), _dim("l", "l_partkey", type="number"), _dim("l", "l_suppkey", type="number"), _dim("l", "l_linenumber", type="number"), _dim("l", "l_quantity", type="number"), _dim("l", "l_discount", type="number")],
        time_dimensions=[TimeDimension(name="shipdate", sql="{l}.l_shipdate")],
        segments=[Segment(name="discounted", sql="{l}.l_discount > 0.05"), Segment(name="bulky", sql="{l}.l_quantity >= 30")],
        joins=[
            Join(to="orders", relationship="many_to_one", on="{l}.l_orderkey = {o}.o_orderkey"),
            Join(to="part", relationship="many_to_one", on="{l}.l_partkey = {p}.p_partkey"),
            Join(to="supplier", relationship="many_to_one", on="{l}.l_suppkey = {s}.s_suppkey"),
        ],
    )
    orders = Cube(
        name="orders",
        alias="o",
        table="orders",
        primary_key="orderkey",
        measures=[_count("order_count"), Measure(name="total", sql="{o}.o_totalprice", agg="sum"), Measure(name="avg_total", sql="{o}.o_totalprice", agg="avg")],
        dimensions=[_dim("o", "o_orderkey", type="number"), _dim("o", "o_orderstatus", "status"), _dim("o", "o_orderpriority", "priority"), _dim("o", "o_custkey", type="number", foreign_key="customer.custkey")],
        time_dimensions=[TimeDimension(name="orderdate", sql="{o}.o_orderdate")],
    )
    customer = Cube(
        name="customer",
        alias="c",
        table="customer",
        primary_key="custkey",
        measures=[_count("cust_count"), Measure(name="acctbal", sql="{c}.c_acctbal", agg="sum")],
        dimensions=[_dim("c", "c_custkey", type="number"), _dim("c", "c_name"), _dim("c", "c_mktsegment", "segment"), _dim("c", "c_nationkey", type="number")],
        joins=[Join(to="cust_nation", relationship="many_to_one", on="{c}.c_nationkey = {cn}.n_nationkey"), Join(to="nation", relationship="many_to_one", on="{c}.c_nationkey = {n}.n_nationkey")],
    )
    supplier = Cube(
        name="supplier",
        alias="s",
        table="supplier",
        measures=[_count("supp_count"), Measure(name="supp_acctbal", sql="{s}.s_acctbal", agg="sum")],
        dimensions=[_dim("s", "s_suppkey", type="number"), _dim("s", "s_name"), _dim("s", "s_nationkey", type="number")],
        joins=[Join(to="supp_nation", relationship="many_to_one", on="{s}.s_nationkey = {sn}.n_nationkey"), Join(to="nation", relationship="many_to_one", on="{s}.s_nationkey = {n}.n_nationkey")],
    )

    def nation(name: str, alias: str) -> Cube:
        return Cube(name=name, alias=alias, table="nation", dimensions=[_dim(alias, "n_name"), _dim(alias, "n_nationkey", type="number"), _dim(alias, "n_regionkey", type="number")])

    part = Cube(name="part", alias="p", table="part", measures=[_count("part_count")], dimensions=[_dim("p", "p_partkey", type="number"), _dim("p", "p_brand"), _dim("p", "p_type"), _dim("p", "p_size", type="number"), _dim("p", "p_name")])
    event_fields = {
        "measures": [_count("event_count"), Measure(name="value", sql="{e}.value", agg="sum"), Measure(name="users", sql="{e}.user_id", agg="count_distinct"), Measure(name="top_value", sql="{e}.value", agg="max")],
        "dimensions": [_dim("e", "event_type", "event_type"), _dim("e", "user_id", "user_id", "number"), _dim("e", "event_id", "event_id", "number")],
        "time_dimensions": [TimeDimension(name="ts", sql="{e}.ts")],
    }

    def events(name: str, alias: str, **more) -> Cube:
        fields = {k: [type(f)(**{**{n: getattr(f, n) for n in f.__dataclass_fields__}, "sql": f.sql.replace("{e}", f"{{{alias}}}")}) for f in v] for k, v in event_fields.items()}
        return Cube(name=name, alias=alias, **({"table": "events"} | fields | more))

    daily = Rollup(name="by_type_day", physical_table="events_daily", dimensions=("event_type",), measures=("event_count", "value", "top_value"), time_dimension="ts", granularity="day")
    parts = [TimePartitionedSource("archive", "events_archive", None, SPLIT, {"value": "amount"}), TimePartitionedSource("live", "events_live", SPLIT, None)]
    cheap = DerivedTable("SELECT c_custkey, c_mktsegment, c_acctbal FROM rich WHERE c_acctbal < 9000", (NamedCTE("rich", "SELECT * FROM customer WHERE c_acctbal > 5000"),))
    remote = "elsewhere"
    return Catalog(
        [
            lineitem,
            orders,
            customer,
            supplier,
            part,
            nation("nation", "n"),
            nation("cust_nation", "cn"),
            nation("supp_nation", "sn"),
            Cube(name="regional", alias="rg", extends="orders", base_predicate="{o}.o_orderstatus <> 'F'", segments=[Segment(name="urgent", sql="{rg}.o_orderpriority = '1-URGENT'")]),
            events("events", "e"),
            events("events_sunday", "es", week_start="sunday"),
            events("events_zoned", "ez", timezone="America/New_York"),
            events("events_rolled", "er", rollups=[daily]),
            events("events_split", "ev", table="", physical_sources=parts, time_partition=TimePartition("ts")),
            Cube(name="mid_customers", alias="mc1", source=cheap, measures=[_count("mid_count"), Measure(name="mid_acctbal", sql="{mc1}.c_acctbal", agg="sum")], dimensions=[_dim("mc1", "c_mktsegment", "segment")]),
            Cube(name="tenant_orders", alias="t", table="orders", tenancy="discriminator", tenancy_columns=["o_orderstatus"], measures=[_count("tenant_count"), Measure(name="tenant_total", sql="{t}.o_totalprice", agg="sum")], dimensions=[_dim("t", "o_orderpriority", "priority")]),
            Cube(name="scoped_orders", alias="so", table="orders", scope="by_priority", security_sql="{so}.o_totalprice > 1000", measures=[_count("scoped_count")], dimensions=[_dim("so", "o_orderstatus", "status")]),
            Cube(name="masked_orders", alias="mo", table="orders", measures=[_count("masked_count"), Measure(name="masked_total", sql="{mo}.o_totalprice", agg="sum")], dimensions=[_dim("mo", "o_orderpriority", "priority", required_roles=("analyst",), mask_roles=("analyst",), mask_value="***"), _dim("mo", "o_orderstatus", "status")]),
            Cube(name="remote_customer", alias="rc", backend=remote, table="customer", measures=[_count("remote_count")], dimensions=[_dim("rc", "c_custkey", type="number"), _dim("rc", "c_mktsegment", "segment"), _dim("rc", "c_nationkey", type="number")], segments=[Segment(name="rich", sql="{rc}.c_acctbal > 5000")]),
            Cube(name="remote_nation", alias="rn", backend=remote, table="nation", dimensions=[_dim("rn", "n_nationkey", type="number"), _dim("rn", "n_name")]),
            Cube(
                name="local_orders",
                alias="lo",
                table="orders",
                measures=[_count("n"), Measure(name="amount", sql="{lo}.o_totalprice", agg="sum"), Measure(name="mean", sql="{lo}.o_totalprice", agg="avg"), Measure(name="p90", sql="{lo}.o_totalprice", agg="p90")],
                dimensions=[_dim("lo", "o_custkey", type="number"), _dim("lo", "o_orderstatus", "status"), _dim("lo", "o_orderpriority", "priority")],
                joins=[Join(to="remote_customer", relationship="many_to_one", on="{lo}.o_custkey = {rc}.c_custkey")],
            ),
            Cube(name="fed_customer", alias="fc", table="customer", measures=[_count("fed_customers")], dimensions=[_dim("fc", "c_nationkey", type="number")], joins=[Join(to="remote_nation", relationship="many_to_one", on="{fc}.c_nationkey = {rn}.n_nationkey")]),
            Cube(name="fed_supplier", alias="fs", table="supplier", measures=[_count("fed_suppliers")], dimensions=[_dim("fs", "s_nationkey", type="number")], joins=[Join(to="remote_nation", relationship="many_to_one", on="{fs}.s_nationkey = {rn}.n_nationkey")]),
            Cube(name="poorer", alias="pc", table="customer", measures=[_count("pairs")], dimensions=[_dim("pc", "c_mktsegment", "segment")], joins=[Join(to="supplier", relationship="many_to_one", on="{pc}.c_nationkey = {s}.s_nationkey AND {pc}.c_acctbal < {s}.s_acctbal")]),
            Cube(name="tiered_orders", alias="to1", table="{tenant_schema}", tenancy="schema", measures=[_count("tier_count")], dimensions=[_dim("to1", "o_orderstatus", "status")]),
            Cube(name="text_orders", alias="tx", table="orders", measures=[_count("text_count")], dimensions=[_dim("tx", "o_custkey", "custkey", "number", coerce_to="string"), _dim("tx", "o_orderstatus", "status")], joins=[Join(to="text_customer", relationship="many_to_one", on="{tx}.o_custkey = {tc}.c_key")]),
            Cube(name="text_customer", alias="tc", source=DerivedTable("SELECT CAST(c_custkey AS STRING) AS c_key, c_mktsegment FROM customer"), dimensions=[_dim("tc", "c_key", "key"), _dim("tc", "c_mktsegment", "segment")]),
            Cube(name="documents", alias="d", table="documents", measures=[_count("doc_count"), Measure(name="chars", sql="{d}.n_chars", agg="sum")], dimensions=[_dim("d", "doc_id", "doc_id", "number"), _dim("d", "lang", "lang"), _dim("d", "source", "source")]),
            Cube(name="labels", alias="lb", table="labels", measures=[_count("label_count")], dimensions=[_dim("lb", "quality", "quality", "number"), _dim("lb", "toxic", "toxic", "number")], joins=[Join(to="documents", relationship="one_to_one", on="{lb}.doc_id = {d}.doc_id")]),
            Cube(name="conversations", alias="cv", table="conversations", measures=[_count("turn_count")], dimensions=[_dim("cv", "role", "role")]),
        ],
        views=[View(name="sales", fields={"income": "lineitem.revenue", "flag": "lineitem.returnflag", "market": "customer.segment"})],
        saved_queries=[SavedQuery(name="open_orders", query=SemanticQuery(measures=("orders.order_count",), filters=(Filter(dimension="orders.status", op="eq", values=("O",)),)))],
        scope_fns={"by_priority": lambda cube, viewer: ScopePredicate("{so}.o_orderpriority = {ctx.priority}", ("priority",))},
        lookups=[Lookup(dimension="orders.status", labels={"F": "filled", "O": "open", "P": "pending"})],
        entities=[Entity(name="order", cubes=("orders",), key="orders.orderkey", fields={"id": "orders.orderkey", "status": "orders.status", "priority": "orders.priority"}, list_filters=("orders.status", "orders.priority", "orders.orderdate"), default_order="orders.orderkey asc")],
    )


def engine(spark: SparkSession, sf_dir: str, known: Catalog | None = None) -> Engine:
    """The catalog over the files of a folder; events also as a daily rollup and as two tables."""
    files = Files(sf_dir)
    split = F.lit(SPLIT).cast("timestamp_ntz")
    made: dict[str, Callable[[DataFrame], DataFrame]] = {
        "events_daily": lambda e: e.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts_day")).agg(F.count("*").alias("event_count"), F.sum("value").alias("value"), F.max("value").alias("top_value")),
        "events_archive": lambda e: e.filter(F.col("ts") < split).withColumnRenamed("value", "amount"),
        "events_live": lambda e: e.filter(F.col("ts") >= split),
    }

    class Main:
        def load(self, spark: SparkSession, table: str) -> DataFrame:
            return made[table](files.load(spark, "events")) if table in made else files.load(spark, table)

    return Engine(spark, known or catalog(), Sources(spark, main=Main(), elsewhere=files))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to four decimals: their sums depend on the order of rows."""
    return df.select(*[F.round(F.col(f"`{f.name}`"), DECIMALS).alias(f.name) if f.dataType.simpleString() == "double" else F.col(f"`{f.name}`") for f in df.schema.fields])


def q(**parts) -> SemanticQuery:
    return SemanticQuery(**parts)


def f(dimension: str, op: str, *values) -> Filter:
    return Filter(dimension=dimension, op=op, values=values)


def _window(dimension: str, start: str, end: str, grain: str | None = None, fill: int | None = None) -> TimeWindow:
    return TimeWindow(dimension=dimension, range=(start, end), granularity=grain, fill_nulls_with=fill)


JAN = ("2024-01-01", "2024-02-01")
Case = tuple[Callable[[Engine], DataFrame], str]


def _plain(query: SemanticQuery, **how) -> Callable[[Engine], DataFrame]:
    return lambda e: e.query(query, **how)


@cache
def _shared_catalog() -> Catalog:
    return catalog()


@cache
def cases() -> dict[str, tuple[Callable[[Engine], DataFrame], str | None]]:
    """By name: what the engine is asked, and the same in DuckDB's SQL."""
    d = f"round({{}}, {DECIMALS})"

    def r(x: str) -> str:
        return d.format(x)

    revenue = "l_extendedprice * (1 - l_discount)"
    out: dict[str, tuple[Callable[[Engine], DataFrame], str | None]] = {}

    def add(name: str, query, sql: str | None, **how) -> None:
        out[name] = (query if callable(query) else _plain(query, **how), sql)

    add("agg_sum_by_dim", q(measures=["lineitem.revenue"], dimensions=["lineitem.returnflag"], filters=[f("lineitem.linestatus", "eq", "O")]), f"SELECT l_returnflag AS returnflag, {r(f'sum({revenue})')} AS revenue FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
    add(
        "agg_all_kinds",
        q(measures=[f"lineitem.{m}" for m in ("qty", "rows", "avg_discount", "min_price", "max_price", "parts")]),
        f"SELECT {r('sum(l_quantity)')} AS qty, count(*) AS rows, {r('avg(l_discount)')} AS avg_discount, {r('min(l_extendedprice)')} AS min_price, {r('max(l_extendedprice)')} AS max_price, count(DISTINCT l_partkey) AS parts FROM lineitem",
    )
    quantiles = ", ".join(f"{r(f'quantile_cont(l_extendedprice, {x})')} AS {n}_price" for n, x in (("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95)))
    add("agg_percentiles", q(measures=[f"lineitem.{n}_price" for n in ("median", "p75", "p90", "p95")], dimensions=["lineitem.linestatus"]), f"SELECT l_linestatus AS linestatus, {quantiles} FROM lineitem GROUP BY 1")
    add(
        "agg_filtered_and_ratio",
        q(measures=["lineitem.returned_qty", "lineitem.return_rate"], dimensions=["lineitem.linestatus"]),
        f"SELECT l_linestatus AS linestatus, {r('sum(l_quantity) FILTER (WHERE l_returnflag = $$R$$)')} AS returned_qty, {r('sum(l_quantity) FILTER (WHERE l_returnflag = $$R$$) / nullif(sum(l_quantity), 0)')} AS return_rate FROM lineitem GROUP BY 1",
    )
    derived = [InlineDerived(name="per_row", op="ratio", operands=("lineitem.revenue", "lineitem.rows")), InlineDerived(name="spread", op="diff", operands=("lineitem.max_price", "lineitem.min_price")), InlineDerived(name="both", op="sum", operands=("lineitem.qty", "lineitem.rows"))]
    add(
        "agg_inline_derived",
        q(measures=["lineitem.qty"], dimensions=["lineitem.returnflag"], derived_measures=derived, having=[f("per_row", "gt", 0)]),
        f"SELECT l_returnflag AS returnflag, {r('sum(l_quantity)')} AS qty, {r(f'sum({revenue}) / count(*)')} AS per_row, {r('max(l_extendedprice) - min(l_extendedprice)')} AS spread, {r('sum(l_quantity) + count(*)')} AS both FROM lineitem GROUP BY 1",
    )
    ops = [f("lineitem.returnflag", "in", "A", "R"), f("lineitem.linestatus", "neq", "F"), f("lineitem.linenumber", "not_in", 6, 7), f("lineitem.quantity", "gte", 5), f("lineitem.quantity", "lt", 45), f("lineitem.discount", "lte", 0.08), f("lineitem.partkey", "gt", 10)]
    add("filter_ops", q(measures=["lineitem.rows", "lineitem.qty"], dimensions=["lineitem.returnflag"], filters=ops), f"SELECT l_returnflag AS returnflag, count(*) AS rows, {r('sum(l_quantity)')} AS qty FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_linestatus <> 'F' AND l_linenumber NOT IN (6, 7) AND l_quantity >= 5 AND l_quantity < 45 AND l_discount <= 0.08 AND l_partkey > 10 GROUP BY 1")
    add("filter_contains", q(measures=["part.part_count"], dimensions=["part.brand"], filters=[f("part.brand", "contains", "bRAND#1")]), "SELECT p_brand AS brand, count(*) AS part_count FROM part WHERE contains(lower(p_brand), 'brand#1') GROUP BY 1")
    add("filter_nulls", q(measures=["documents.doc_count"], dimensions=["documents.lang"], left_joins=["labels"], filters=[f("labels.quality", "not_null")]), "SELECT lang, count(*) AS doc_count FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NOT NULL GROUP BY 1")
    tree = BoolExpr(op="and", children=(BoolExpr(op="or", children=(f("orders.status", "eq", "F"), BoolExpr(op="not", children=(f("orders.priority", "in", "1-URGENT", "2-HIGH"),)))), f("orders.custkey", "gt", 100)))
    add("where_tree_or_not", q(measures=["orders.order_count", "orders.total"], dimensions=["orders.status"], where=tree), f"SELECT o_orderstatus AS status, count(*) AS order_count, {r('sum(o_totalprice)')} AS total FROM orders WHERE (o_orderstatus = 'F' OR NOT (o_orderpriority IN ('1-URGENT', '2-HIGH'))) AND o_custkey > 100 GROUP BY 1")
    add("segments", q(measures=["lineitem.rows"], dimensions=["lineitem.returnflag"], segments=["lineitem.discounted", "lineitem.bulky"]), "SELECT l_returnflag AS returnflag, count(*) AS rows FROM lineitem WHERE l_discount > 0.05 AND l_quantity >= 30 GROUP BY 1")
    add("extends_and_base_predicate", q(measures=["regional.order_count"], dimensions=["regional.status"], segments=["regional.urgent"]), "SELECT o_orderstatus AS status, count(*) AS order_count FROM orders WHERE o_orderstatus <> 'F' AND o_orderpriority = '1-URGENT' GROUP BY 1")
    add("join_two_hop", q(measures=["lineitem.revenue"], dimensions=["customer.segment"]), f"SELECT c_mktsegment AS segment, {r(f'sum({revenue})')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1")
    five = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation sn ON s_nationkey = sn.n_nationkey"
    add("join_five_cube", q(measures=["lineitem.revenue", "lineitem.rows"], dimensions=["cust_nation.name", "supp_nation.name"]), f"SELECT cn.n_name AS cust_nation_name, sn.n_name AS supp_nation_name, {r(f'sum({revenue})')} AS revenue, count(*) AS rows {five} GROUP BY 1, 2")
    add("join_left_spine", q(measures=["customer.cust_count"], dimensions=["customer.segment", "nation.regionkey"], left_joins=["nation"]), "SELECT c_mktsegment AS segment, n_regionkey AS regionkey, count(*) AS cust_count FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
    add("join_anti", q(dimensions=["documents.doc_id"], left_joins=["labels"], filters=[f("labels.quality", "is_null")]), "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.quality IS NULL GROUP BY 1")
    add("join_collision_prefix", q(measures=["customer.cust_count"], dimensions=["customer.nationkey", "cust_nation.nationkey"]), "SELECT c_nationkey AS customer_nationkey, n_nationkey AS cust_nation_nationkey, count(*) AS cust_count FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
    add("output_alias", q(measures=["orders.total"], dimensions=["orders.status"], aliases={"state": "orders.status", "amount": "orders.total"}), f"SELECT o_orderstatus AS state, {r('sum(o_totalprice)')} AS amount FROM orders GROUP BY 1")
    add(
        "having_order_limit_offset",
        q(measures=["orders.order_count", "orders.total"], dimensions=["orders.custkey"], having=[f("order_count", "gte", 3)], order=[("order_count", "desc"), ("orders.custkey", "asc")], limit=20, offset=5),
        f"SELECT o_custkey AS custkey, count(*) AS order_count, {r('sum(o_totalprice)')} AS total FROM orders GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC NULLS LAST, 1 LIMIT 20 OFFSET 5",
    )
    add("order_by_unprojected", q(dimensions=["orders.custkey"], order=[("orders.order_count", "desc"), ("orders.custkey", "asc")], limit=15), "SELECT custkey FROM (SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15)")
    add("ungrouped_rows", q(dimensions=["lineitem.orderkey", "lineitem.linenumber", "lineitem.quantity"], ungrouped=True, filters=[f("lineitem.returnflag", "eq", "R")], order=[("lineitem.orderkey", "asc"), ("lineitem.linenumber", "asc"), ("lineitem.quantity", "asc")], limit=200), f"SELECT l_orderkey AS orderkey, l_linenumber AS linenumber, {r('l_quantity')} AS quantity FROM lineitem WHERE l_returnflag = 'R' ORDER BY 1, 2, 3 LIMIT 200")
    add("distinct_rows", q(dimensions=["orders.status", "orders.priority"]), "SELECT DISTINCT o_orderstatus AS status, o_orderpriority AS priority FROM orders")
    for grain in ("second", "minute", "hour", "day", "week", "month", "quarter", "year"):
        add(f"time_bucket_{grain}", q(measures=["events.event_count", "events.value"], time_dimension=_window("events.ts", "2024-01-03", "2024-01-20T12:00:00", grain)), f"SELECT date_trunc('{grain}', ts)::TIMESTAMP AS ts_{grain}, count(*) AS event_count, {r('sum(value)')} AS value FROM events WHERE ts >= '2024-01-03' AND ts < '2024-01-20 12:00:00' GROUP BY 1")
    add("time_week_sunday", q(measures=["events_sunday.event_count"], time_dimension=_window("events_sunday.ts", *JAN, "week")), "SELECT (date_trunc('week', ts + INTERVAL 1 DAY) - INTERVAL 1 DAY)::TIMESTAMP AS ts_week, count(*) AS event_count FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1")
    add("time_zone_day", q(measures=["events_zoned.event_count"], time_dimension=_window("events_zoned.ts", *JAN, "day")), "SELECT date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')::TIMESTAMP AS ts_day, count(*) AS event_count FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1")
    add(
        "time_spine_fill",
        q(measures=["events.event_count"], time_dimension=_window("events.ts", "2023-12-25", "2024-01-10", "day", 0), filters=[f("events.event_type", "eq", "purchase")]),
        "SELECT d AS ts_day, coalesce(n, 0) AS event_count FROM (SELECT unnest(generate_series(TIMESTAMP '2023-12-25', TIMESTAMP '2024-01-09', INTERVAL 1 DAY)) AS d) LEFT JOIN (SELECT date_trunc('day', ts)::TIMESTAMP AS b, count(*) AS n FROM events WHERE event_type = 'purchase' AND ts >= '2023-12-25' AND ts < '2024-01-10' GROUP BY 1) ON b = d",
    )

    def compared(now: tuple[str, str], then: tuple[str, str], having: str = "") -> str:
        part = "SELECT event_type AS k, sum(value) AS v FROM events WHERE ts >= '{}' AND ts < '{}' GROUP BY 1"
        delta = "coalesce(a.v, 0) - coalesce(b.v, 0)"
        return f"SELECT coalesce(a.k, b.k) AS event_type, {r('a.v')} AS value_current, {r('b.v')} AS value_prior, {r(delta)} AS value_delta, {r('CASE WHEN b.v > 0 THEN (a.v - b.v) * 100.0 / b.v END')} AS value_pct_change FROM ({part.format(*now)}) a FULL JOIN ({part.format(*then)}) b ON a.k = b.k{having}"

    add("compare_previous", q(measures=["events.value"], dimensions=["events.event_type"], time_dimension=_window("events.ts", "2024-01-15", "2024-01-22"), compare=CompareWindow()), compared(("2024-01-15", "2024-01-22"), ("2024-01-08", "2024-01-15")))
    add("compare_explicit_having", q(measures=["events.value"], dimensions=["events.event_type"], time_dimension=_window("events.ts", "2024-01-15", "2024-01-22"), compare=CompareWindow(mode="explicit", range=("2024-01-01", "2024-01-04")), having=[f("compare.value.delta", "gt", 0)], order=[("value_delta", "desc")]), compared(("2024-01-15", "2024-01-22"), ("2024-01-01", "2024-01-04"), " WHERE coalesce(a.v, 0) - coalesce(b.v, 0) > 0"))
    facts = "FROM nation {0} JOIN (SELECT c_nationkey AS k, count(*) AS c FROM customer GROUP BY 1) ON k = n_nationkey {0} JOIN (SELECT s_nationkey AS k2, count(*) AS s FROM supplier GROUP BY 1) ON k2 = n_nationkey"
    add("symmetric_two_fact", q(measures=["customer.cust_count", "supplier.supp_count"], dimensions=["nation.name"]), "SELECT n_name AS name, sum(c)::BIGINT AS cust_count, sum(s)::BIGINT AS supp_count " + facts.format("LEFT") + " WHERE c IS NOT NULL OR s IS NOT NULL GROUP BY 1")
    add("rollup_daily_events", q(measures=["events_rolled.event_count", "events_rolled.value", "events_rolled.top_value"], dimensions=["events_rolled.event_type"], time_dimension=_window("events_rolled.ts", *JAN, "day")), f"SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS ts_day, count(*) AS event_count, {r('sum(value)')} AS value, {r('max(value)')} AS top_value FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1, 2")
    add("rollup_no_time", q(measures=["events_rolled.event_count"]), "SELECT count(*) AS event_count FROM events")
    add("partitioned_events", q(measures=["events_split.event_count", "events_split.value"], dimensions=["events_split.event_type"], time_dimension=_window("events_split.ts", "2024-01-10", "2024-01-20")), f"SELECT event_type, count(*) AS event_count, {r('sum(value)')} AS value FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-20' GROUP BY 1")
    add("partitioned_empty", q(measures=["events_split.event_count"], time_dimension=_window("events_split.ts", "2024-01-20", "2024-01-20")), "SELECT count(*) AS event_count FROM events WHERE false")
    add("derived_table_cte", q(measures=["mid_customers.mid_count", "mid_customers.mid_acctbal"], dimensions=["mid_customers.segment"]), f"WITH rich AS (SELECT * FROM customer WHERE c_acctbal > 5000) SELECT c_mktsegment AS segment, count(*) AS mid_count, {r('sum(c_acctbal)')} AS mid_acctbal FROM rich WHERE c_acctbal < 9000 GROUP BY 1")
    viewer = AuthContext(viewer_id="v", tenant="F", roles=("analyst",), attrs={"priority": "1-URGENT"})
    add("tenancy_discriminator", q(measures=["tenant_orders.tenant_count", "tenant_orders.tenant_total"], dimensions=["tenant_orders.priority"]), f"SELECT o_orderpriority AS priority, count(*) AS tenant_count, {r('sum(o_totalprice)')} AS tenant_total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1", viewer=viewer)
    add("scope_predicate", q(measures=["scoped_orders.scoped_count"], dimensions=["scoped_orders.status"]), "SELECT o_orderstatus AS status, count(*) AS scoped_count FROM orders WHERE o_totalprice > 1000 AND o_orderpriority = '1-URGENT' GROUP BY 1", viewer=viewer)
    add("masked_dimension", q(measures=["masked_orders.masked_count"], dimensions=["masked_orders.priority", "masked_orders.status"]), "SELECT '***' AS priority, o_orderstatus AS status, count(*) AS masked_count FROM orders GROUP BY 2", viewer=viewer)

    def fed(query: SemanticQuery, mode: str = "distributive") -> Callable[[Engine], DataFrame]:
        return lambda e: federation.compile_federated(e, query, mode=mode).df

    joined = "FROM orders {} JOIN customer ON o_custkey = c_custkey"
    add("fed_bridge_left", fed(q(measures=["local_orders.amount", "local_orders.mean"], dimensions=["remote_customer.segment"])), f"SELECT c_mktsegment AS segment, {r('sum(o_totalprice)')} AS amount, {r('avg(o_totalprice)')} AS mean {joined.format('LEFT')} GROUP BY 1")
    add("fed_bridge_inner", fed(q(measures=["local_orders.amount"], dimensions=["local_orders.status"], filters=[f("remote_customer.segment", "in", "BUILDING", "MACHINERY")], segments=["remote_customer.rich"])), f"SELECT o_orderstatus AS status, {r('sum(o_totalprice)')} AS amount {joined.format('')} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 5000 GROUP BY 1")
    either = BoolExpr(op="or", children=(f("local_orders.status", "eq", "F"), f("remote_customer.segment", "eq", "BUILDING")))
    add("fed_cross_or", fed(q(measures=["local_orders.amount", "local_orders.n"], dimensions=["remote_customer.segment"], where=either)), f"SELECT c_mktsegment AS segment, {r('sum(o_totalprice)')} AS amount, count(*) AS n {joined.format('LEFT')} WHERE o_orderstatus = 'F' OR c_mktsegment = 'BUILDING' GROUP BY 1")
    add("fed_raw_percentile", fed(q(measures=["local_orders.p90"], dimensions=["remote_customer.segment"]), "raw_rows"), f"SELECT c_mktsegment AS segment, {r('quantile_cont(o_totalprice, 0.9)')} AS p90 {joined.format('LEFT')} GROUP BY 1")
    rich = q(dimensions=["remote_customer.custkey"], segments=["remote_customer.rich"])
    for op, word in (("in", "IN"), ("not_in", "NOT IN")):
        semi = q(measures=["local_orders.amount", "local_orders.n"], dimensions=["local_orders.status"], semi_joins=[SemiJoin(dimension="local_orders.custkey", op=op, select="custkey", source=rich)])
        add(f"semi_join_{op}", lambda e, semi=semi: federation.compile_semi_joins(e, semi).df, f"SELECT o_orderstatus AS status, {r('sum(o_totalprice)')} AS amount, count(*) AS n FROM orders WHERE o_custkey {word} (SELECT c_custkey FROM customer WHERE c_acctbal > 5000) GROUP BY 1")
    flat = q(measures=["local_orders.amount"], dimensions=["local_orders.priority"], filters=[f("remote_customer.segment", "eq", "BUILDING")])
    add("autoplan_semi_join", lambda e: federation.run(e, flat).df, f"SELECT o_orderpriority AS priority, {r('sum(o_totalprice)')} AS amount FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
    add("fed_symmetric", fed(q(measures=["fed_customer.fed_customers", "fed_supplier.fed_suppliers"], dimensions=["remote_nation.name"])), "SELECT n_name AS name, sum(c)::BIGINT AS fed_customers, sum(s)::BIGINT AS fed_suppliers " + facts.format("LEFT") + " GROUP BY 1")
    add("entity_fetch", lambda e: entities.fetch(e, "order", 7).df, "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderkey = 7 LIMIT 1")
    add("entity_list_keyset", _second_page, "SELECT o_orderkey AS id, o_orderstatus AS status, o_orderpriority AS priority FROM orders WHERE o_orderstatus IN ('F', 'O') ORDER BY o_orderkey LIMIT 25 OFFSET 25")
    add("enrich_label", lambda e: enrich(e.query(q(measures=["orders.order_count"], dimensions=["orders.status"])), e.catalog, {"status": "orders.status"}), "SELECT o_orderstatus AS status, count(*) AS order_count, coalesce(CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END, o_orderstatus) AS status__label FROM orders GROUP BY 1")
    known = ", ".join(f"('{m.agg}')" for c in catalog().cubes.values() if c.backend != META for m in c.measures)
    add("meta_catalog_measures", q(measures=["meta_measures.count"], dimensions=["meta_measures.agg"]), f"SELECT agg, count(*) AS count FROM (VALUES {known}) AS t(agg) GROUP BY 1")
    add("view_fields", q(measures=["sales.income"], dimensions=["sales.market", "sales.flag"]), f"SELECT c_mktsegment AS segment, l_returnflag AS returnflag, {r(f'sum({revenue})')} AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
    add("saved_query", lambda e: e.saved("open_orders").df, "SELECT count(*) AS order_count FROM orders WHERE o_orderstatus = 'O'")
    add("join_theta", q(measures=["poorer.pairs"], dimensions=["poorer.segment", "supplier.nationkey"]), "SELECT c_mktsegment AS segment, s_nationkey AS nationkey, count(*) AS pairs FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal < s_acctbal GROUP BY 1, 2")
    add("tenancy_schema", q(measures=["tiered_orders.tier_count"], dimensions=["tiered_orders.status"]), "SELECT o_orderstatus AS status, count(*) AS tier_count FROM orders GROUP BY 1", viewer=AuthContext(viewer_id="v", tenant="orders"))
    add("join_coerced_key", q(measures=["text_orders.text_count"], dimensions=["text_customer.segment"]), "SELECT c_mktsegment AS segment, count(*) AS text_count FROM orders JOIN customer ON CAST(o_custkey AS VARCHAR) = CAST(c_custkey AS VARCHAR) GROUP BY 1")
    add("drill_down", lambda e: e.query(rewrite.rewrite(q(measures=["orders.total"], dimensions=["orders.status"]), rewrite.DrillDown("orders.priority", "orders.status"), rewrite.AddFilter(f("orders.status", "eq", "F")))), f"SELECT o_orderpriority AS priority, {r('sum(o_totalprice)')} AS total FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
    add("unit_conversion", lambda e: e.query(q(measures=["events.value"], dimensions=["events.event_type"])).select("event_type", Units().column(F.col("value"), "hour", "minute").alias("value")), f"SELECT event_type, {r('sum(value) * 60.0')} AS value FROM events GROUP BY 1")
    add("compare_buckets", q(measures=["events.event_count"], time_dimension=_window("events.ts", "2024-01-08", "2024-01-15", "day"), compare=CompareWindow(mode="explicit", range=("2024-01-12", "2024-01-19"))), _compared_buckets())
    text = "SELECT customer.segment, SUM(orders.total) AS total FROM orders JOIN customer ON orders.custkey = customer.custkey WHERE orders.status <> 'F' AND orders.orderdate BETWEEN '1996-01-01' AND '1998-01-01' GROUP BY customer.segment HAVING SUM(orders.total) > 0 ORDER BY total DESC LIMIT 10"
    add("sql_front_end", lambda e: e.query(sqlfront.parse_sql(text, e.catalog)), f"SELECT c_mktsegment AS segment, {r('sum(o_totalprice)')} AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' AND o_orderdate >= '1996-01-01' AND o_orderdate < '1998-01-01' GROUP BY 1 ORDER BY 2 DESC LIMIT 10")
    add("one_to_one_join", q(measures=["labels.label_count", "documents.chars"], dimensions=["documents.lang", "labels.toxic"]), "SELECT lang, toxic, count(*) AS label_count, sum(n_chars)::BIGINT AS chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY 1, 2")
    add("simple_count", q(measures=["conversations.turn_count"], dimensions=["conversations.role"]), "SELECT role, count(*) AS turn_count FROM conversations GROUP BY 1")
    add("compare_two_keys", q(measures=["events.event_count", "events.users"], dimensions=["events.event_type", "events.user_id"], time_dimension=_window("events.ts", "2024-01-15", "2024-01-17"), compare=CompareWindow()), _compared_users())
    by_day = q(measures=["events.event_count"], dimensions=["events.event_type"], time_dimension=_window("events.ts", *JAN, "day"), order=[("event_count", "desc"), ("events.event_type", "asc")], limit=3)
    add("grain_collapse", lambda e: e.query(federation.collapse_grain(by_day)), "SELECT event_type, count(*) AS event_count FROM events WHERE ts >= '2024-01-01' AND ts < '2024-02-01' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
    largest = q(dimensions=["orders.orderkey"], order=[("orders.total", "desc"), ("orders.orderkey", "asc")], limit=500)
    add("row_cap", lambda e: hooks.RowCap(40).rewrite(e.query(largest), largest, None), "SELECT o_orderkey AS orderkey FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 40")
    spelled = q(measures=["orders.order_count"], dimensions=["orders.priority"], filters=[f("orders.status", "in", "Filled", "pending")])
    add("resolve_filter_values", lambda e: e.query(resolve_filters(spelled, e.catalog)[0]), "SELECT o_orderpriority AS priority, count(*) AS order_count FROM orders WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
    add("result_cache", _answered_twice, "SELECT o_orderstatus AS status, count(*) AS order_count, true AS cached FROM orders GROUP BY 1")
    written = "SELECT o_orderkey, o_custkey, {} AS o_orderstatus, {} AS o_orderpriority FROM orders"
    urgent = (f("orders.status", "eq", "F"), f("orders.priority", "in", "4-NOT SPECIFIED", "5-LOW"))
    add("write_update", _writes(operation="update", filters=urgent, values={"priority": "1-URGENT"}), written.format("o_orderstatus", "CASE WHEN o_orderstatus = 'F' AND o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN '1-URGENT' ELSE o_orderpriority END"))
    add("write_delete", _writes(operation="delete", filters=(f("orders.status", "eq", "P"),)), written.format("o_orderstatus", "o_orderpriority") + " WHERE o_orderstatus <> 'P'")
    add("write_upsert", _writes(operation="upsert", values={"orderkey": 7, "status": "P"}), written.format("CASE WHEN o_orderkey = 7 THEN 'P' ELSE o_orderstatus END", "o_orderpriority"))
    add("write_insert", _writes(operation="insert", values={"orderkey": -1, "status": "O"}), written.format("o_orderstatus", "o_orderpriority") + " UNION ALL SELECT -1, NULL, 'O', NULL")
    add("write_preview", _writes(after=False, operation="delete", filters=(f("orders.status", "eq", "P"),)), written.format("o_orderstatus", "o_orderpriority") + " WHERE o_orderstatus = 'P'")
    expected = ", ".join(f"('{case}', '{reason}')" for case, (reason, _) in _refused().items())
    add("refusals", _refusals, f"SELECT * FROM (VALUES {expected}) AS t(\"case\", reason)")
    return out


def _compared_users() -> str:
    part = "SELECT event_type AS k, user_id AS u, count(*) AS n, count(DISTINCT user_id) AS v FROM events WHERE ts >= '{}' AND ts < '{}' GROUP BY 1, 2"
    a, b = part.format("2024-01-15", "2024-01-17"), part.format("2024-01-13", "2024-01-15")
    columns = [f"a.{c} AS {m}_current, b.{c} AS {m}_prior, coalesce(a.{c}, 0) - coalesce(b.{c}, 0) AS {m}_delta, round(CASE WHEN b.{c} > 0 THEN (a.{c} - b.{c}) * 100.0 / b.{c} END, {DECIMALS}) AS {m}_pct_change" for c, m in (("n", "event_count"), ("v", "users"))]
    return f"SELECT coalesce(a.k, b.k) AS event_type, coalesce(a.u, b.u) AS user_id, {', '.join(columns)} FROM ({a}) a FULL JOIN ({b}) b ON a.k = b.k AND a.u = b.u"


def _answered_twice(e: Engine) -> DataFrame:
    """The second answer of a runner to one query, of three rows, and whether it came from its cache."""
    runner = Runner(e, cache=ResultCache(size=4))
    asked = q(measures=["orders.order_count"], dimensions=["orders.status"])
    runner.run(asked)
    again = runner.run(asked)
    return e.spark.createDataFrame([(*r, again.cached) for r in again.rows], "status string, order_count long, cached boolean")


def _writes(after: bool = True, **what) -> Callable[[Engine], DataFrame]:
    """The table of orders once a write is done, or the rows that it touches."""

    def run(e: Engine) -> DataFrame:
        texts = {name: MutableField(type="string") for name in ("status", "priority")}
        entity = MutableEntity(
            name="order",
            cubes=("orders",),
            key="orders.orderkey",
            list_filters=("orders.status", "orders.priority"),
            target_cube="orders",
            operations=frozenset({"insert", "update", "delete", "upsert"}),
            mutable_fields={"orderkey": MutableField(type="number", immutable=True, required=True), **texts},
            predicate_targeting=True,
        )
        writable = Engine(e.spark, Catalog([e.catalog.cubes[c] for c in ("orders", "customer", "nation", "cust_nation")], entities=[entity], allow_mutations=True), e.sources)
        done = compile_mutation(writable, Mutation(entity="order", **what))
        return (done.after if after else done.preview).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")

    return run


def _refused() -> dict[str, tuple[str, Callable[[Engine], object]]]:
    """What the engine must refuse, by case: the reason, and the question."""
    return {
        "fan_out": ("FanOutError", lambda e: e.query(q(measures=["orders.total"], dimensions=["lineitem.returnflag"]))),
        "chasm": ("FanOutError", lambda e: e.query(q(measures=["lineitem.revenue", "customer.acctbal"], dimensions=["nation.name"]))),
        "no_path": ("JoinPathError", lambda e: e.query(q(measures=["lineitem.revenue"], dimensions=["conversations.role"]))),
        "value_type": ("FilterTypeError", lambda e: e.query(q(measures=["orders.total"], filters=[f("orders.custkey", "eq", "many")]))),
        "unknown_field": ("UnknownIdentifierError", lambda e: e.query(q(measures=["orders.totals"]))),
        "reversed_window": ("CompileError", lambda e: _window("events.ts", "2024-02-01", "2024-01-01")),
        "two_sources": ("CrossSourceError", lambda e: e.query(q(measures=["local_orders.amount"], dimensions=["remote_customer.segment"]))),
        "quantile_of_parts": ("FederationError", lambda e: federation.compile_federated(e, q(measures=["local_orders.p90"], dimensions=["remote_customer.segment"]))),
        "no_tenant": ("AuthError", lambda e: e.query(q(measures=["tenant_orders.tenant_count"]))),
        "read_only_entity": ("MutationError", lambda e: compile_mutation(e, Mutation(entity="order", operation="delete", key=7))),
    }


def _refusals(e: Engine) -> DataFrame:
    rows = []
    for case, (_, ask) in _refused().items():
        try:
            ask(e)
            rows.append((case, "answered"))
        except EngineError as refusal:
            rows.append((case, type(refusal).__name__))
    return e.spark.createDataFrame(rows, "case string, reason string")


def _compared_buckets() -> str:
    part = "SELECT date_trunc('day', ts)::TIMESTAMP AS k, count(*) AS v FROM events WHERE ts >= '{}' AND ts < '{}' GROUP BY 1"
    a, b = part.format("2024-01-08", "2024-01-15"), part.format("2024-01-12", "2024-01-19")
    change = f"round(CASE WHEN b.v > 0 THEN (a.v - b.v) * 100.0 / b.v END, {DECIMALS})"
    return f"SELECT coalesce(a.k, b.k) AS ts_day, a.v AS event_count_current, b.v AS event_count_prior, coalesce(a.v, 0) - coalesce(b.v, 0) AS event_count_delta, {change} AS event_count_pct_change FROM ({a}) a FULL JOIN ({b}) b ON a.k = b.k"


def _second_page(e: Engine) -> DataFrame:
    """Rows 26 to 50 of a listing, by the cursor that the first page ends with."""
    asked = entities.ListSpec(entity="order", filters=(f("orders.status", "in", "F", "O"),), limit=25)
    first = entities.list_rows(e, asked)
    last = first.df.orderBy("id").collect()[-1].asDict()  # a page has 25 rows
    return entities.list_rows(e, entities.next_page(asked, e.catalog, last)).df


def run_case(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cases()[name][0](engine(spark, sf_dir, _shared_catalog())))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(run_case, name) for name in cases()}


def oracles() -> dict[str, str]:
    return {name: sql for name, (_, sql) in cases().items() if sql}


