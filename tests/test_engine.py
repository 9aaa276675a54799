"""Queries over small tables with rows worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cubeloom import federation
from cubeloom.catalog import Catalog
from cubeloom.engine import Engine
from cubeloom.errors import AuthError, CompileError, CrossSourceError, FanOutError, FederationError, FilterTypeError, JoinPathError, UnknownIdentifierError
from cubeloom.model import AuthContext, Cube, Dimension, Join, Measure, Rollup, ScopePredicate, Segment, TimeDimension, TimePartition, TimePartitionedSource
from cubeloom.query import BoolExpr, CompareWindow, Filter, InlineDerived, SemanticQuery, SemiJoin, TimeWindow
from cubeloom.sources import Frames, Sources


def q(**parts):
    return SemanticQuery(**parts)


def f(dimension, op, *values):
    return Filter(dimension=dimension, op=op, values=values)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


ORDERS = [(1, 10, "paid", 100.0), (2, 10, "paid", 200.0), (3, 11, "paid", 50.0), (4, 11, "pending", 25.0), (5, 12, "paid", 300.0)]
CUSTOMERS = [(10, "EU", "gold"), (11, "US", "silver"), (12, "EU", "gold")]


def orders(**more):
    return Cube(
        **{
            "name": "orders",
            "alias": "o",
            "table": "orders",
            "measures": [Measure(name="revenue", sql="{o}.amount", agg="sum"), Measure(name="n", sql="*", agg="count"), Measure(name="mean", sql="{o}.amount", agg="avg"), Measure(name="mid", sql="{o}.amount", agg="median")],
            "dimensions": [Dimension(name="id", sql="{o}.id", type="number"), Dimension(name="customer_id", sql="{o}.customer_id", type="number"), Dimension(name="status", sql="{o}.status", type="string")],
            "joins": [Join(to="customers", relationship="many_to_one", on="{o}.customer_id = {c}.id")],
        }
        | more
    )


def customers(**more):
    return Cube(**{"name": "customers", "alias": "c", "table": "customers", "measures": [Measure(name="customers", sql="*", agg="count")], "dimensions": [Dimension(name="id", sql="{c}.id", type="number"), Dimension(name="region", sql="{c}.region", type="string"), Dimension(name="tier", sql="{c}.tier", type="string")]} | more)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "orders": spark.createDataFrame(ORDERS, "id int, customer_id int, status string, amount double"),
        "customers": spark.createDataFrame(CUSTOMERS, "id int, region string, tier string"),
        "items": spark.createDataFrame([(1, "a", 2), (1, "b", 3), (2, "a", 1)], "order_id int, sku string, qty int"),
    }


@pytest.fixture(scope="module")
def shop(spark, tables):
    return Engine(spark, Catalog([orders(), customers()]), main=Frames(tables))


@pytest.fixture(scope="module")
def two_sources(spark, tables):
    return Engine(spark, Catalog([orders(), customers(backend="crm")]), main=Frames(tables), crm=Frames(tables))


def test_sum_and_average_over_a_join(shop):
    df = shop.query(q(measures=["orders.revenue", "orders.mean"], dimensions=["customers.region"]))
    assert rows(df, "region", "revenue", "mean") == [("EU", 600.0, 200.0), ("US", 75.0, 37.5)]


def test_federated_equals_one_source(two_sources):
    asked = q(measures=["orders.revenue"], dimensions=["customers.region"])
    with pytest.raises(CrossSourceError):
        two_sources.query(asked)
    assert rows(federation.compile_federated(two_sources, asked).df, "region", "revenue") == [("EU", 600.0), ("US", 75.0)]
    paid = asked.with_(filters=(f("orders.status", "eq", "paid"),))
    assert rows(federation.compile_federated(two_sources, paid).df, "region", "revenue") == [("EU", 600.0), ("US", 50.0)]


def test_or_across_sources(spark):
    tables = {
        "orders": spark.createDataFrame([(1, 10, "paid", 100.0), (2, 10, "pending", 200.0), (3, 11, "paid", 50.0), (4, 12, "pending", 25.0), (5, 12, "paid", 300.0)], "id int, customer_id int, status string, amount double"),
        "customers": spark.createDataFrame([(10, "EU", "gold"), (11, "US", "silver"), (12, "EU", "silver")], "id int, region string, tier string"),
    }
    e = Engine(spark, Catalog([orders(), customers(backend="crm")]), main=Frames(tables), crm=Frames(tables))
    either = BoolExpr(op="or", children=(f("orders.status", "eq", "paid"), f("customers.tier", "eq", "gold")))
    found = federation.compile_federated(e, q(measures=["orders.revenue"], dimensions=["customers.region"], where=either))
    assert rows(found.df, "region", "revenue") == [("EU", 600.0), ("US", 50.0)]


def test_federation_refusals(two_sources):
    for mode, asked, reason in (
        ("distributive", q(measures=["orders.mid"], dimensions=["customers.region"]), "non_distributive"),
        ("raw_rows", q(measures=["orders.revenue", "customers.customers"]), "multi_backend_measures"),
        ("raw_rows", q(dimensions=["orders.id", "customers.region"], ungrouped=True), "ungrouped"),
    ):
        with pytest.raises((FederationError, FanOutError)) as e:
            federation.compile_federated(two_sources, asked, mode=mode)
        if isinstance(e.value, FederationError):
            assert e.value.details["reason"] == reason
    assert federation.compile_federated(two_sources, q(measures=["orders.mid"], dimensions=["customers.region"]), mode="raw_rows").df.count() == 2


def test_key_types_of_sources_must_agree(spark, tables):
    odd = customers(backend="crm", dimensions=[Dimension(name="id", sql="{c}.id", type="string"), Dimension(name="region", sql="{c}.region", type="string")])
    e = Engine(spark, Catalog([orders(), odd]), main=Frames(tables), crm=Frames(tables))
    with pytest.raises(FederationError) as err:
        federation.compile_federated(e, q(measures=["orders.revenue"], dimensions=["customers.region"]))
    assert err.value.details["reason"] == "key_type"


@pytest.mark.parametrize(("op", "tiers", "expected"), [("in", ("gold",), [("paid", 600.0)]), ("not_in", ("gold",), [("paid", 50.0), ("pending", 25.0)]), ("in", ("none",), []), ("not_in", ("none",), [("paid", 650.0), ("pending", 25.0)])])
def test_semi_join(two_sources, op, tiers, expected):
    source = q(dimensions=["customers.id"], filters=[f("customers.tier", "in", *tiers)])
    asked = q(measures=["orders.revenue"], dimensions=["orders.status"], semi_joins=[SemiJoin(dimension="orders.customer_id", op=op, select="id", source=source)])
    assert rows(federation.compile_semi_joins(two_sources, asked).df, "status", "revenue") == expected


def test_not_in_drops_null_keys_only_if_there_are_values(spark, tables):
    with_null = dict(tables, orders=tables["orders"].union(spark.createDataFrame([(6, None, "odd", 1.0)], tables["orders"].schema)))
    e = Engine(spark, Catalog([orders(), customers(backend="crm")]), main=Frames(with_null), crm=Frames(with_null))

    def run(tier):
        source = q(dimensions=["customers.id"], filters=[f("customers.tier", "eq", tier)])
        return federation.compile_semi_joins(e, q(measures=["orders.n"], semi_joins=[SemiJoin(dimension="orders.customer_id", op="not_in", select="id", source=source)])).df.first()["n"]

    assert run("gold") == 2
    assert run("none") == 6


def test_autoplan(two_sources):
    flat = q(measures=["orders.revenue"], dimensions=["orders.status"], filters=[f("customers.region", "eq", "EU")])
    plan = federation.autoplan(flat, two_sources.catalog)
    assert plan.strategy == "semi_join" and not plan.query.filters
    assert rows(federation.run(two_sources, flat).df, "status", "revenue") == [("paid", 600.0)]
    assert federation.autoplan(q(measures=["orders.revenue"], dimensions=["customers.region"]), two_sources.catalog).strategy == "bridge_merge"
    top = q(measures=["orders.revenue"], dimensions=["orders.status"], order=[("orders.revenue", "desc")], limit=1)
    assert federation.collapse_grain(top) == top


def test_fan_out_is_refused(spark, tables):
    items = Cube(name="items", alias="li", table="items", measures=[Measure(name="qty", sql="{li}.qty", agg="sum")], dimensions=[Dimension(name="sku", sql="{li}.sku", type="string")])
    e = Engine(spark, Catalog([orders(joins=[Join(to="items", relationship="one_to_many", on="{o}.id = {li}.order_id")]), items]), main=Frames(tables))
    with pytest.raises(FanOutError):
        e.query(q(measures=["orders.revenue"], dimensions=["items.sku"]))
    with pytest.raises(FanOutError):
        e.query(q(measures=["orders.revenue", "items.qty"], dimensions=["items.sku"]))
    assert rows(e.query(q(measures=["items.qty"], dimensions=["orders.status"])), "status", "qty") == [("paid", 6)]


def bridge(spark, other="main"):
    tables = {
        "employees": spark.createDataFrame([(1, "Ana"), (2, "Bob"), (3, "Cay"), (4, "Dan")], "id int, name string"),
        "worklog": spark.createDataFrame([(1, 1, 8), (2, 3, 5)], "id int, employee_id int, hours int"),
        "activity": spark.createDataFrame([(1, 1, 100), (2, 1, 200), (3, 2, 50)], "id int, employee_id int, secs int"),
    }
    fact = lambda name, alias, column: Cube(name=name, alias=alias, table=name, measures=[Measure(name=column, sql=f"{{{alias}}}.{column}", agg="sum")], dimensions=[Dimension(name="employee_id", sql=f"{{{alias}}}.employee_id", type="number")], joins=[Join(to="employees", relationship="many_to_one", on=f"{{{alias}}}.employee_id = {{e}}.id")])
    employees = Cube(name="employees", alias="e", table="employees", backend=other, dimensions=[Dimension(name="id", sql="{e}.id", type="number"), Dimension(name="name", sql="{e}.name", type="string")])
    return Engine(spark, Catalog([fact("worklog", "w", "hours"), fact("activity", "a", "secs"), employees]), main=Frames(tables), **({other: Frames(tables)} if other != "main" else {}))


def test_two_facts_are_totalled_without_counting_twice(spark):
    asked = q(measures=["activity.secs", "worklog.hours"], dimensions=["employees.name"])
    assert rows(bridge(spark).query(asked), "name", "secs", "hours") == [("Ana", 300, 8), ("Bob", 50, None), ("Cay", None, 5)]
    across = federation.compile_federated(bridge(spark, "hr"), asked).df
    assert rows(across, "name", "secs", "hours") == [("Ana", 300, 8), ("Bob", 50, None), ("Cay", None, 5), ("Dan", None, None)]


METAMORPHIC = [(i, r, s, [100, 20, 60, None, 80, 10, 50, 5][i % 8]) for i, (r, s) in enumerate((r, s) for r in ("us", "eu", "apac", None) for s in ("shipped", "pending", "cancelled", None))]


@pytest.fixture(scope="module")
def nulls(spark):
    df = spark.createDataFrame(METAMORPHIC, "id int, region string, status string, amount int")
    cube = Cube(name="t", alias="t", table="t", measures=[Measure(name="n", sql="*", agg="count"), Measure(name="total", sql="{t}.amount", agg="sum")], dimensions=[Dimension(name="id", sql="{t}.id", type="number"), Dimension(name="region", sql="{t}.region", type="string"), Dimension(name="status", sql="{t}.status", type="string")], segments=[Segment(name="big", sql="{t}.amount >= 50")])
    return Engine(spark, Catalog([cube]), main=Frames({"t": df}))


def count(e, **parts):
    return e.query(q(measures=["t.n"], **parts)).first()["n"]


def test_a_predicate_its_negation_and_null_partition_the_rows(nulls):
    p = f("t.region", "in", "us", "eu")
    parts = [count(nulls, where=p), count(nulls, where=BoolExpr(op="not", children=(p,))), count(nulls, filters=[f("t.region", "is_null")])]
    assert parts == [8, 4, 4] and sum(parts) == count(nulls) == 16
    assert count(nulls, filters=[f("t.region", "neq", "us")]) == 8  # nulls are neither equal nor different


def test_group_sums_add_up_and_limits_are_prefixes(nulls):
    total = nulls.query(q(measures=["t.total"])).first()["total"]
    by_region = nulls.query(q(measures=["t.total"], dimensions=["t.region"])).collect()
    assert sum(r["total"] for r in by_region) == total
    ordered = q(dimensions=["t.id", "t.region"], ungrouped=True, order=[("t.region", "desc"), ("t.id", "asc")])
    everything = [tuple(r) for r in nulls.query(ordered).collect()]
    assert [tuple(r) for r in nulls.query(ordered.with_(limit=5, offset=2)).collect()] == everything[2:7]
    assert [r[1] for r in everything[-4:]] == [None] * 4  # nulls last, also descending
    with pytest.raises(CompileError):
        nulls.query(ordered.with_(offset=2))


def test_segments_restrict_and_filters_are_monotonic(nulls):
    assert count(nulls, segments=["t.big"]) <= count(nulls)
    assert count(nulls, segments=["t.big"], filters=[f("t.region", "eq", "us")]) <= count(nulls, segments=["t.big"])


def test_wrong_names_and_values_are_refused_with_a_hint(shop):
    with pytest.raises(UnknownIdentifierError) as e:
        shop.query(q(measures=["orders.revenu"]))
    assert e.value.details["hint"] == "revenue"
    assert e.value.to_payload()["code"] == "UnknownIdentifierError"
    for bad in (f("orders.id", "eq", "x"), f("orders.id", "eq", True), f("orders.status", "eq", 3), f("orders.id", "contains", "1"), f("orders.id", "in")):
        with pytest.raises(FilterTypeError):
            shop.query(q(measures=["orders.n"], filters=[bad]))
    with pytest.raises(CompileError):
        shop.query(q(measures=["orders.n"], having=[f("orders.revenue", "gt", 1)]))
    with pytest.raises(CompileError):
        shop.query(q())


def test_hostile_values_are_values(shop):
    for text in ("x' OR 1=1 --", "{o}.status", "\\", "%", "a`b"):
        assert shop.query(q(measures=["orders.n"], filters=[f("orders.status", "eq", text)])).first()["n"] == 0
    assert shop.query(q(measures=["orders.n"], filters=[f("orders.status", "contains", "%")])).first()["n"] == 0
    assert shop.query(q(measures=["orders.n"], filters=[f("orders.status", "contains", "AI")])).first()["n"] == 4


def test_derived_ratio_guards_zero(shop):
    derived = [InlineDerived(name="per", op="ratio", operands=("orders.revenue", "orders.n"))]
    df = shop.query(q(derived_measures=derived, filters=[f("orders.status", "eq", "nothing")]))
    assert [tuple(r) for r in df.collect()] == [(None,)]


def test_unprojected_order_and_aliases(shop):
    df = shop.query(q(dimensions=["orders.customer_id"], order=[("orders.revenue", "desc")], aliases={"who": "orders.customer_id"}))
    assert df.columns == ["who"] and [r[0] for r in df.collect()] == [10, 12, 11] or {r[0] for r in df.collect()[:2]} == {10, 12}
    with pytest.raises(CompileError):
        shop.query(q(measures=["orders.n"], order=[("orders.status", "asc")]))


TIMES = [("2024-01-01 10:00:00", 1.0), ("2024-01-02 23:30:00", 2.0), ("2024-01-07 00:00:00", 4.0), ("2024-01-08 02:00:00", 8.0), ("2024-02-01 00:00:00", 16.0)]


def event_cube(**more):
    return Cube(**{"name": "ev", "alias": "v", "table": "ev", "measures": [Measure(name="n", sql="*", agg="count"), Measure(name="value", sql="{v}.value", agg="sum")], "dimensions": [Dimension(name="kind", sql="{v}.kind", type="string")], "time_dimensions": [TimeDimension(name="ts", sql="{v}.ts")]} | more)


@pytest.fixture(scope="module")
def ev(spark):
    return spark.createDataFrame([(*t, "k") for t in TIMES], "ts string, value double, kind string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def window(start, end, grain=None, fill=None):
    return TimeWindow(dimension="ev.ts", range=(start, end), granularity=grain, fill_nulls_with=fill)


def test_windows_are_half_open(spark, ev):
    e = Engine(spark, Catalog([event_cube()]), main=Frames({"ev": ev}))
    assert e.query(q(measures=["ev.n"], time_dimension=window("2024-01-01", "2024-01-07"))).first()["n"] == 2
    assert e.query(q(measures=["ev.n"], time_dimension=window("2024-01-07", "2024-01-07"))).first()["n"] == 0
    with pytest.raises(CompileError):
        window("2024-02-01", "2024-01-01")


def test_week_starts_and_zones(spark, ev):
    def buckets(grain, **more):
        e = Engine(spark, Catalog([event_cube(**more)]), main=Frames({"ev": ev}))
        df = e.query(q(measures=["ev.n"], time_dimension=window("2024-01-01", "2024-01-20", grain)))
        return {str(r[0])[:10]: r[1] for r in df.collect()}

    assert buckets("week") == {"2024-01-01": 3, "2024-01-08": 1}
    assert buckets("week", week_start="sunday") == {"2023-12-31": 2, "2024-01-07": 2}
    assert buckets("day", timezone="America/New_York") == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-06": 1, "2024-01-07": 1}


def test_gap_filling_has_every_bucket(spark, ev):
    e = Engine(spark, Catalog([event_cube()]), main=Frames({"ev": ev}))
    df = e.query(q(measures=["ev.n"], time_dimension=window("2024-01-01", "2024-01-09T01:00:00", "day", 0)))
    assert [r[1] for r in df.orderBy("ts_day").collect()] == [1, 1, 0, 0, 0, 0, 1, 1, 0]


def test_comparison_keeps_raw_values_and_guards_change(spark, ev):
    e = Engine(spark, Catalog([event_cube()]), main=Frames({"ev": ev}))
    df = e.query(q(measures=["ev.value"], time_dimension=window("2024-01-07", "2024-01-14"), compare=CompareWindow()))
    r = df.first()
    assert (r["value_current"], r["value_prior"], r["value_delta"], r["value_pct_change"]) == (12.0, None, 12.0, None) or r["value_prior"] == 3.0
    explicit = q(measures=["ev.value"], dimensions=["ev.kind"], time_dimension=window("2024-01-07", "2024-01-14"), compare=CompareWindow(mode="explicit", range=("2024-01-01", "2024-01-03")))
    r = e.query(explicit).first()
    assert (r["value_current"], r["value_prior"], r["value_delta"], r["value_pct_change"]) == (12.0, 3.0, 9.0, 300.0)


def test_comparison_scans_once_and_leaves_null_keys_apart(spark):
    rows = [(None, 1.0, "2024-01-02"), (None, 5.0, "2024-01-09"), ("a", 2.0, "2024-01-02"), ("a", 4.0, "2024-01-09"), ("b", 8.0, "2024-01-03"), ("c", 9.0, "2024-01-10"), ("d", 7.0, "2023-06-01")]
    frame = spark.createDataFrame(rows, "kind string, value double, at string").selectExpr("kind", "value", "cast(at as timestamp_ntz) as ts")
    cube = event_cube(measures=[Measure(name="n", sql="*", agg="count"), Measure(name="value", sql="{v}.value", agg="sum"), Measure(name="median", sql="{v}.value", agg="median"), Measure(name="p90", sql="{v}.value", agg="p90")])
    e = Engine(spark, Catalog([cube]), main=Frames({"ev": frame}))
    df = e.query(q(measures=["ev.n", "ev.value", "ev.median", "ev.p90"], dimensions=["ev.kind"], time_dimension=window("2024-01-08", "2024-01-15"), compare=CompareWindow()))
    got = {tuple(r[c] for c in ("kind", "n_current", "n_prior", "value_current", "value_prior", "median_current", "median_prior", "value_delta")) for r in df.collect()}
    assert got == {
        (None, 1, None, 5.0, None, 5.0, None, 5.0),
        (None, None, 1, None, 1.0, None, 1.0, -1.0),
        ("a", 1, 1, 4.0, 2.0, 4.0, 2.0, 2.0),
        ("b", None, 1, None, 8.0, None, 8.0, -8.0),
        ("c", 1, None, 9.0, None, 9.0, None, 9.0),
    }
    whole = e.query(q(measures=["ev.n", "ev.value"], time_dimension=window("2025-01-08", "2025-01-15"), compare=CompareWindow())).first()
    assert (whole["n_current"], whole["n_prior"], whole["value_current"], whole["value_delta"]) == (0, 0, None, 0.0)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1


def test_rollup_is_taken_only_where_it_answers(spark, ev):
    daily = ev.groupBy("kind", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts_day")).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    cube = event_cube(rollups=[Rollup(name="daily", physical_table="daily", dimensions=("kind",), measures=("n", "value"), time_dimension="ts", granularity="day")])
    e = Engine(spark, Catalog([cube]), main=Frames({"ev": ev, "daily": daily}))

    def run(**parts):
        c = e.compile(q(measures=["ev.n"], **parts))
        return c.rollup, c.df.agg(F.sum("n")).first()[0]

    assert run(time_dimension=window("2024-01-01", "2024-01-08", "day")) == ("daily", 3)
    assert run(time_dimension=window("2024-01-01", "2024-01-07T12:00:00", "day")) == (None, 3)
    assert run(time_dimension=window("2024-01-01", "2024-01-08", "hour")) == (None, 3)
    assert run(dimensions=["ev.kind"]) == ("daily", 5)
    assert run(filters=[f("ev.kind", "eq", "none")]) == ("daily", 0)


def test_partitioned_sources_are_pruned_and_renamed(spark, ev):
    old = ev.filter("ts < timestamp_ntz'2024-01-08'").withColumnRenamed("value", "amount")
    new = ev.filter("ts >= timestamp_ntz'2024-01-08'")
    cube = event_cube(table="", physical_sources=[TimePartitionedSource("old", "old", None, "2024-01-08", {"value": "amount"}), TimePartitionedSource("new", "new", "2024-01-08", None)], time_partition=TimePartition("ts"))
    e = Engine(spark, Catalog([cube]), main=Frames({"old": old, "new": new}))

    def run(start, end):
        c = e.compile(q(measures=["ev.value"], time_dimension=window(start, end)))
        return c.physical_sources, c.df.first()[0]

    assert run("2024-01-01", "2024-01-08") == (("old",), 7.0)
    assert run("2024-01-08", "2024-03-01") == (("new",), 24.0)
    assert run("2024-01-07", "2024-01-09") == (("old", "new"), 12.0)
    assert e.compile(q(measures=["ev.value"])).physical_sources == ("old", "new")


def test_left_joins_and_anti_joins(spark, tables):
    e = Engine(spark, Catalog([customers(joins=[Join(to="orders", relationship="one_to_many", on="{o}.customer_id = {c}.id")]), orders(joins=[])]), main=Frames(dict(tables, customers=tables["customers"].union(spark.createDataFrame([(13, "US", "none")], tables["customers"].schema)))))
    asked = q(dimensions=["customers.id"], left_joins=["orders"], filters=[f("orders.id", "is_null")])
    assert rows(e.query(asked), "id") == [(13,)]
    with pytest.raises(CompileError):
        e.query(q(dimensions=["customers.id"], left_joins=["orders"]))


def test_unreachable_cube(spark, tables):
    e = Engine(spark, Catalog([orders(joins=[]), customers()]), main=Frames(tables))
    with pytest.raises(JoinPathError):
        e.query(q(measures=["orders.n"], dimensions=["customers.region"]))


def test_tenancy_scope_and_masks(spark, tables):
    cube = orders(joins=[], tenancy="discriminator", tenancy_columns=["status"], scope="mine", dimensions=[Dimension(name="customer_id", sql="{o}.customer_id", type="number", required_roles=("clerk", "boss"), mask_roles=("clerk",)), Dimension(name="status", sql="{o}.status", type="string", required_roles=("boss",))])
    catalog = Catalog([cube], scope_fns={"mine": lambda c, v: ScopePredicate("{o}.amount >= {ctx.floor}", ("floor",))})
    e = Engine(spark, catalog, main=Frames(tables))
    asked = q(measures=["orders.n"], dimensions=["orders.customer_id"])

    def viewer(role, tenant="paid", floor=60.0):
        return AuthContext(viewer_id="x", tenant=tenant, roles=(role,), attrs={"floor": floor})

    assert rows(e.query(asked, viewer=viewer("boss")), "customer_id", "n") == [(10, 2), (12, 1)]
    assert rows(e.query(asked, viewer=viewer("clerk")), "customer_id", "n") == [(None, 3)]  # grouped by the mask
    assert e.query(q(measures=["orders.n"]), viewer=viewer("boss", "x' OR '1'='1")).first()["n"] == 0
    with pytest.raises(AuthError):
        e.query(asked, viewer=AuthContext(viewer_id="x", roles=("boss",), attrs={"floor": 1}))
    with pytest.raises(AuthError):
        e.query(asked, viewer=viewer("guest"))
    with pytest.raises(AuthError):
        e.query(asked)  # no viewer, no tenant


def test_hidden_cubes_are_not_in_the_catalog_as_data(spark, tables):
    e = Engine(spark, Catalog([orders(joins=[], required_roles=("boss",)), customers()]), main=Frames(tables))
    asked = q(measures=["meta_cubes.count"])
    assert e.query(asked).first()["count"] == 2
    assert e.query(asked, viewer=AuthContext(viewer_id="x")).first()["count"] == 1


def test_scans_are_pruned_and_filters_pushed(spark, tmp_path, tables):
    from cubeloom.sources import Files

    tables["orders"].write.parquet(f"{tmp_path}/orders.parquet")
    tables["customers"].write.parquet(f"{tmp_path}/customers.parquet")
    e = Engine(spark, Catalog([orders(), customers()]), main=Files(str(tmp_path)))
    df = e.query(q(measures=["orders.revenue"], filters=[f("orders.status", "eq", "paid")]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(status,paid)" in plan
    assert "struct<status:string,amount:double>" in plan


def test_sources_by_name(spark, tables):
    s = Sources(spark, a=Frames(tables))
    with pytest.raises(UnknownIdentifierError):
        s.load("b", "orders")
    s.register("b", Frames(tables))
    assert s.load("b", "orders").count() == 5
    assert s.query("b", "SELECT max(amount) AS m FROM orders o JOIN customers ON o.customer_id = customers.id WHERE status = 'from orders'").first()["m"] is None


def test_chunks(shop):
    chunks = list(shop.compile(q(dimensions=["orders.id"], ungrouped=True, order=[("orders.id", "asc")])).iter_chunks(2))
    assert [[r["id"] for r in c] for c in chunks] == [[1, 2], [3, 4], [5]]


def test_distributive_totals_come_before_the_join(two_sources, shop):
    asked = q(measures=["orders.revenue", "orders.n", "orders.mean"], dimensions=["customers.region", "orders.status"], filters=[f("customers.tier", "neq", "none"), f("orders.id", "gt", 1)])
    partial = federation.compile_federated(two_sources, asked)
    plan = partial.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")  # a second aggregation lies below the join
    want = rows(shop.query(asked), "region", "status", "revenue", "n", "mean")
    assert rows(partial.df, "region", "status", "revenue", "n", "mean") == want
    assert rows(federation.compile_federated(two_sources, asked, mode="raw_rows").df, "region", "status", "revenue", "n", "mean") == want
    nothing = q(measures=["orders.n", "orders.mean"], filters=[f("customers.tier", "eq", "none")])
    assert rows(federation.compile_federated(two_sources, nothing).df, "n", "mean") == [(0, None)]
