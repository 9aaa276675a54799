"""Entities, writes, enrichment, bring-up, tools and the registered queries."""

from __future__ import annotations

from pathlib import Path

import pytest

from cubeloom import entities, showcase
from cubeloom.catalog import Catalog
from cubeloom.engine import Engine
from cubeloom.errors import AuthError, CompileError, EngineError, MutationError
from cubeloom.functions.lookups import enrich, resolve_filters
from cubeloom.model import AuthContext, CtxRef, Cube, Dimension, Lookup, Measure, MutableEntity, MutableField, TimeDimension
from cubeloom.mutate import Mutation, compile_mutation
from cubeloom.query import Filter, SavedQuery, SemanticQuery
from cubeloom.sources import Frames
from cubeloom.tools import bringup, hooks
from cubeloom.tools.safe import is_read_only
from cubeloom.tools.toolset import Toolset

DATA = Path("/root/testdata/sf0.001")
ROWS = [(1, "us", "open", "acme"), (2, "eu", "closed", "acme"), (3, "us", "open", "globex"), (4, "us", "closed", "acme"), (5, None, "open", "acme")]
ACME = AuthContext(viewer_id="ann", tenant="acme", roles=("writer",))


def make(spark, **more):
    cube = Cube(name="orders", alias="o", table="orders", primary_key="id", tenancy="discriminator", tenancy_columns=["org_id"], measures=[Measure(name="n", sql="*", agg="count")], dimensions=[Dimension(name="id", sql="{o}.id", type="number"), Dimension(name="region", sql="{o}.region", type="string"), Dimension(name="status", sql="{o}.status", type="string")])
    entity = MutableEntity(
        name="order",
        cubes=("orders",),
        key="orders.id",
        list_filters=("orders.region", "orders.status"),
        default_order="orders.region desc",
        target_cube="orders",
        operations=frozenset({"insert", "update", "delete", "upsert"}),
        mutable_fields={"id": MutableField(type="number", immutable=True, required=True), "region": MutableField(type="string"), "status": MutableField(type="string", nullable=False)},
        required_roles=("writer",),
        predicate_targeting=True,
    )
    catalog = Catalog([cube], entities=[entity], allow_mutations=True, max_mutation_rows=2, saved_queries=[SavedQuery(name="all", query=SemanticQuery(measures=("orders.n",)), required_roles=("writer",))], **more)
    return Engine(spark, catalog, main=Frames({"orders": spark.createDataFrame(ROWS, "id int, region string, status string, org_id string")}))


def test_pages_follow_one_another_and_agree_with_the_row_plan(spark):
    e = make(spark)
    source = entities.MemoryRows({"orders": [dict(zip(("id", "region", "status", "org_id"), r, strict=True)) for r in ROWS]})
    spec, seen, same = entities.ListSpec(entity="order", limit=2), [], []
    while True:
        page = entities.list_rows(e, spec, viewer=ACME).rows()
        same += entities.execute(entities.row_plan(e.catalog, spec, ACME), source)
        if not page:
            break
        seen += page
        spec = entities.next_page(spec, e.catalog, page[-1])
    assert [r["id"] for r in seen] == [1, 4, 2, 5]
    assert [r["id"] for r in same] == [1, 4, 2, 5]


def test_fetch_and_refusals(spark):
    e = make(spark)
    assert entities.fetch(e, "order", 1, viewer=ACME).rows() == [{"id": 1, "region": "us", "status": "open"}]
    assert entities.fetch(e, "order", 3, viewer=ACME).rows() == []  # another tenant's
    for spec in (entities.ListSpec(entity="order", limit=5000), entities.ListSpec(entity="order", filters=(Filter(dimension="orders.id", op="eq", values=(1,)),)), entities.ListSpec(entity="order", filters=(Filter(dimension="orders.region", op="contains", values=("u",)),)), entities.ListSpec(entity="order", cursor="!")):
        with pytest.raises(CompileError):
            entities.list_rows(e, spec, viewer=ACME)
    with pytest.raises(AuthError):
        entities.fetch(e, "order", 1)


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_writes(spark, tmp_path):
    e = make(spark)
    update = compile_mutation(e, Mutation(entity="order", operation="update", key=1, values={"status": "done"}), viewer=ACME)
    assert ids(update.preview) == [1] and update.after.filter("status = 'done'").count() == 1 and update.after.count() == 5
    foreign = compile_mutation(e, Mutation(entity="order", operation="delete", key=3), viewer=ACME)
    assert foreign.affected() == 0 and foreign.after.count() == 5
    insert = compile_mutation(e, Mutation(entity="order", operation="insert", values={"id": 9, "status": "open"}), viewer=ACME)
    assert insert.after.filter("id = 9 and org_id = 'acme' and region is null").count() == 1
    assert insert.apply(f"{tmp_path}/new") == 1 and spark.read.parquet(f"{tmp_path}/new").count() == 6
    for key, n in ((1, 5), (10, 6)):
        up = compile_mutation(e, Mutation(entity="order", operation="upsert", values={"id": key, "status": "new"}), viewer=ACME)
        assert up.after.count() == n and up.after.filter(f"id = {key} and status = 'new'").count() == 1
    assert compile_mutation(e, Mutation(entity="order", operation="upsert", values={"id": 1, "status": "new"}), viewer=ACME).after.filter("id = 1").first()["region"] == "us"
    many = Mutation(entity="order", operation="delete", filters=(Filter(dimension="orders.status", op="in", values=("open", "closed")),))
    with pytest.raises(MutationError):
        compile_mutation(e, many, viewer=ACME).affected()


@pytest.mark.parametrize(
    "m",
    [
        Mutation(entity="order", operation="update", key=1, values={"id": 2}),
        Mutation(entity="order", operation="update", key=1, values={"status": None}),
        Mutation(entity="order", operation="update", key=1, values={"org_id": "x"}),
        Mutation(entity="order", operation="update", values={"status": "x"}),
        Mutation(entity="order", operation="update", key=1),
        Mutation(entity="order", operation="insert", values={"status": "x"}),
        Mutation(entity="order", operation="update", key=1, values={"status": 3}),
    ],
)
def test_wrong_writes_are_refused(spark, m):
    with pytest.raises(EngineError):
        compile_mutation(make(spark), m, viewer=ACME)


def test_writes_need_rights(spark):
    m = Mutation(entity="order", operation="delete", key=1)
    with pytest.raises(AuthError):
        compile_mutation(make(spark), m, viewer=AuthContext(viewer_id="x", tenant="acme"))
    with pytest.raises(EngineError):
        compile_mutation(make(spark), m)
    assert CtxRef("tenant").attr == "tenant"


def test_enrichment(spark):
    df = spark.createDataFrame([("F", 1), ("X", 2), (None, 3)], "status string, n int")
    catalog = showcase.catalog()
    out = {r["n"]: r["status__label"] for r in enrich(df, catalog, {"status": "orders.status"}).collect()}
    assert out == {1: "filled", 2: "X", 3: None}
    reference = spark.createDataFrame([("F", "filled", 7)], "code string, label string, rank int")
    catalog.lookups["orders.status"] = Lookup(dimension="orders.status", enricher=reference)
    out = {r["n"]: (r["status__label"], r["status__rank"]) for r in enrich(df, catalog, {"status": "orders.status"}).collect()}
    assert out == {1: ("filled", 7), 2: ("X", None), 3: (None, None)}
    catalog.lookups["orders.status"] = Lookup(dimension="orders.status", enricher=lambda values, ctx: {v: v.lower() for v in values if v != "X"})
    out = {r["n"]: r["status__label"] for r in enrich(df, catalog, {"status": "orders.status"}).collect()}
    assert out == {1: "f", 2: "X", 3: None}


def test_filters_are_resolved_by_vocabulary():
    q = SemanticQuery(measures=("orders.total",), filters=(Filter(dimension="orders.status", op="in", values=("open", "F", "???")),))
    found, notes = resolve_filters(q, showcase.catalog())
    assert found.filters[0].values == ("O", "F", "???") and notes["orders.status=???"].status == "unknown"


def test_bring_up_and_drift(spark):
    tables = {
        "customers": spark.createDataFrame([], "id int, region string, signup date"),
        "orders": spark.createDataFrame([], "id int, customer_id int, amount decimal(10,2), created timestamp_ntz"),
    }
    cubes = {c.name: c for c in bringup.introspect(tables)}
    assert cubes["orders"].get("customer_id").foreign_key == "customers.id"
    assert cubes["orders"].get("total_amount").agg == "sum" and isinstance(cubes["customers"].get("signup"), TimeDimension)
    e = Engine(spark, Catalog(cubes.values()), main=Frames(tables))
    assert bringup.check_tables(e) == []
    changed = dict(tables, orders=tables["orders"].drop("amount").withColumnRenamed("customer_id", "cust"))
    drift = bringup.check_tables(Engine(spark, Catalog(cubes.values()), main=Frames(changed)))
    assert {"orders.total_amount", "orders.amount", "orders.customer_id", "orders -> customers"} <= {d.where for d in drift}


def test_read_only_guard(spark):
    assert is_read_only(spark, "SELECT a FROM t WHERE a IN (SELECT b FROM u)")
    for sql in ("DROP TABLE t", "INSERT INTO t SELECT 1", "SELECT 1; DROP TABLE t", "CREATE TABLE t AS SELECT 1", "SET a = 1", "DELETE FROM t", "nonsense"):
        assert not is_read_only(spark, sql)


def test_hooks_see_answers_and_refusals(spark):
    seen = []
    e = make(spark, hooks=(hooks.Audit(seen.append), hooks.RowCap(1)))
    listing = SemanticQuery(dimensions=("orders.id",), ungrouped=True)
    assert e.query(listing, viewer=ACME).count() == 1
    with pytest.raises(EngineError):
        e.query(SemanticQuery(measures=("orders.nope",)), viewer=ACME)
    assert [x.outcome for x in seen] == ["compiled", "refused"]


def test_toolset(spark):
    tools = Toolset(make(spark), ACME)
    found = tools.call("run_query", {"query": {"measures": ["orders.n"], "dimensions": ["orders.status"]}})["result"]
    assert {r["status"]: r["n"] for r in found["rows"]} == {"open": 2, "closed": 2} and found["chart"]["kind"] == "bar"
    assert tools.call("run_saved_query", {"name": "all"})["result"]["rows"] == [{"n": 4}]
    assert tools.call("run_sql", {"sql": "SELECT COUNT(*) FROM orders"})["result"]["rows"] == [{"n": 4}]
    assert tools.call("run_query", {"query": {"measures": ["orders.m"]}})["error"]["code"] == "UnknownIdentifierError"
    assert tools.call("nope", {})["error"]["code"] == "UnknownTool"
    assert "root orders" in tools.call("explain_query", {"query": {"measures": ["orders.n"]}})["result"]
    assert tools.call("search_catalog", {"text": "status"})["result"][0]["ref"] == "orders.status"


def test_tools_for_cubes_entities_and_writes(spark):
    done = []
    tools = Toolset(make(spark), ACME, write=lambda c: done.append(c.after.count()) or 1)
    assert tools.call("query_orders", {"measures": ["n"], "filters": [{"dimension": "status", "op": "eq", "values": ("open",)}]})["result"]["rows"] == [{"n": 2}]
    assert tools.call("get_entity", {"entity": "order", "key": 1})["result"] == {"id": 1, "region": "us", "status": "open"}
    assert tools.call("get_entity", {"entity": "order", "key": 3})["result"] is None  # another tenant's
    seen, cursor = [], None
    while True:
        page = tools.call("list_entity", {"entity": "order", "limit": 3, "cursor": cursor})["result"]
        seen += [r["id"] for r in page["rows"]]
        cursor = page["next_cursor"]
        if cursor is None:
            break
    assert seen == [1, 4, 2, 5]
    assert tools.call("preview_write", {"entity": "order", "operation": "delete", "key": 4})["result"] == {"affected": 1, "rows": [{"id": 4, "region": "us", "status": "closed", "org_id": "acme"}]}
    assert tools.call("preview_write", {"entity": "order", "operation": "delete", "key": 3})["result"]["affected"] == 0
    assert tools.call("write_entity", {"entity": "order", "operation": "delete", "key": 4})["result"] == {"affected": 1} and done == [4]
    assert tools.call("write_entity", {"entity": "order", "operation": "update", "key": 4, "values": {"id": 9}})["error"]["code"] == "MutationError"
    assert "write_entity" not in Toolset(make(spark), ACME).tools


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_every_query_agrees_with_its_sql(spark):
    import duckdb

    c = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def norm(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(str(tuple(round(float(r[i]), 3) if isinstance(r[i], float) else str(r[i]) for i in order)) for r in rows)

    queries, oracles = showcase.queries(), showcase.oracles()
    assert set(oracles) <= set(queries)
    for name, sql in oracles.items():
        df = queries[name](spark, str(DATA))
        got = norm([tuple(r) for r in df.collect()], df.columns)
        found = c.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns), name
        assert got == norm(found.fetchall(), columns), name


def test_entry_point_registers_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "join_five_cube" in entry.queries()


def test_results_are_cached_by_namespace_viewer_and_time(spark):
    from cubeloom.execution import ResultCache, Runner

    now, told = [0.0], []
    runner = Runner(make(spark), cache=ResultCache(2, ttl=10, clock=lambda: now[0]), on_execute=lambda *a: told.append(a[2:]))
    asked = SemanticQuery(measures=("orders.n",))
    assert runner.run(asked, viewer=ACME).rows == ((4,),)
    assert runner.run(asked, viewer=ACME).cached
    assert not runner.run(asked, viewer=ACME, namespace="other").cached
    globex = AuthContext(viewer_id="bob", tenant="globex")
    assert runner.run(asked, viewer=globex).dicts() == [{"n": 1}]
    now[0] = 11
    assert not runner.run(asked, viewer=globex).cached
    assert told[:2] == [(1, False), (1, True)]
    with pytest.raises(AuthError):
        runner.run(asked)
    with pytest.raises(CompileError):
        runner.run_raw("DROP TABLE x")
    assert runner.run_raw("SELECT 1 AS a") == [{"a": 1}]
    assert len(runner.run_raw("SELECT id FROM range(12000)")) == 12_000
    runner.max_rows = 3
    few = runner.run_raw("SELECT id FROM range(5)")
    assert [r["id"] for r in few] == [0, 1, 2] and few.truncated
    assert not runner.run_raw("SELECT id FROM range(3)").truncated


def test_command_line(capsys):
    from cubeloom.__main__ import main

    where = "cubeloom.showcase:catalog"
    assert main(["docs", where]) == 0 and "## orders" in capsys.readouterr().out
    assert main(["validate", where, '{"measures": ["orders.total"]}']) == 0
    assert main(["validate", where, '{"measures": ["orders.nope"]}']) == 1
    assert main(["validate", where, '{"measure": []}']) == 2
    assert main(["diff", where, where]) == 0


def test_stages():
    from cubeloom.tools.stages import Route, Step, Steps, drills

    cube = Cube(name="a", alias="a", table="t", dimensions=[Dimension(name=n, sql=f"{{a}}.{n}", type="string") for n in ("x", "y")], measures=[Measure(name="n", sql="*", agg="count")], drill_paths=[("x", "y")])
    catalog = Catalog([cube])
    [drill] = drills(SemanticQuery(measures=("a.n",), dimensions=("a.x",)), catalog)
    assert drill.query.dimensions == ("a.x", "a.y")
    assert list(Steps((Step(drill.query), Step(SemanticQuery(measures=("a.m",))))).problems(catalog)) == [1]
    with pytest.raises(CompileError):
        Route("nowhere")


def test_several_quantiles_share_a_pass(spark):
    e = showcase.engine(spark, str(DATA))
    df = e.query(showcase.q(measures=["lineitem.median_price", "lineitem.p90_price"]))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("percentile(") == 1
