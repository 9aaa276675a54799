"""Planning without Spark: normal forms, join paths, the SQL dialect, values."""

from __future__ import annotations

import time
from datetime import datetime

from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cubeloom import showcase, sqlfront
from cubeloom.catalog import Catalog
from cubeloom.errors import CatalogError, CompileError, EngineError, FanOutError, SqlFrontError, UnparseError
from cubeloom.functions.lookups import outcome, resolve
from cubeloom.functions.units import Units
from cubeloom.instant import previous_range
from cubeloom.model import Cube, DerivedTable, Dimension, Join, Measure, Rollup, TimeDimension
from cubeloom.operators.timegrain import floor_instant
from cubeloom.plans.cnf import evaluate, to_cnf
from cubeloom.plans.joins import find_path
from cubeloom.plans.logical import build_plan
from cubeloom.query import BoolExpr, Filter, SemanticQuery, TimeWindow, from_dict
from cubeloom.tools import charts, cost, describe, diff, identity, lint, rewrite, search
from cubeloom.tools.validate import validate


@pytest.fixture(scope="module")
def catalog():
    return showcase.catalog()


leaf = st.sampled_from("abcd").map(lambda x: Filter(dimension=f"t.{x}", op="is_null"))
trees = st.recursive(leaf, lambda c: st.one_of(c.map(lambda x: BoolExpr(op="not", children=(x,))), st.builds(lambda op, xs: BoolExpr(op=op, children=tuple(xs)), st.sampled_from(["and", "or"]), st.lists(c, min_size=2, max_size=3))), max_leaves=8)


def value(node, truth):
    if isinstance(node, Filter):
        return truth[node.dimension]
    parts = [value(c, truth) for c in node.children]
    return not parts[0] if node.op == "not" else all(parts) if node.op == "and" else any(parts)


@settings(max_examples=80, deadline=None)
@given(trees, st.lists(st.booleans(), min_size=4, max_size=4))
def test_normal_form_has_the_same_truth(tree, bits):
    truth = dict(zip(("t.a", "t.b", "t.c", "t.d"), bits, strict=True))
    assert evaluate(to_cnf(tree), lambda f: truth[f.dimension]) == value(tree, truth)


def test_normal_form_of_a_wide_or_and_of_deep_nesting():
    wide = BoolExpr(op="or", children=tuple(Filter(dimension=f"t.x{i}", op="is_null") for i in range(30)))
    began = time.perf_counter()
    assert len(to_cnf(wide)) == 1 and time.perf_counter() - began < 1
    deep = Filter(dimension="t.x", op="is_null")
    for _ in range(2500):
        deep = BoolExpr(op="not", children=(deep,))
    assert len(to_cnf(deep)) == 1


def cube(name, *joins):
    return Cube(name=name, alias=name, table=name, joins=[Join(to=t, relationship=r, on=f"{{{name}}}.k = {{{t}}}.k") for t, r in joins], measures=[Measure(name="n", sql="*", agg="count")], dimensions=[Dimension(name="k", sql=f"{{{name}}}.k", type="string")])


def test_cheapest_path_avoids_multiplying_rows():
    cubes = {c.name: c for c in (cube("a", ("b", "one_to_many"), ("c", "many_to_one")), cube("b", ("d", "many_to_one")), cube("c", ("d", "many_to_one")), cube("d"))}
    assert [s.right for s in find_path(["a"], "d", cubes).steps] == ["c", "d"]
    two = {c.name: c for c in (cube("a", ("b", "many_to_one"), ("c", "many_to_one")), cube("b", ("d", "many_to_one")), cube("c", ("d", "many_to_one")), cube("d"))}
    assert find_path(["a"], "d", two).alternatives == 2


def test_chasm_is_refused_unless_symmetric():
    c = Catalog([cube("p"), cube("x", ("p", "many_to_one")), cube("y", ("p", "many_to_one"))])
    plan = build_plan(SemanticQuery(measures=("x.n", "y.n"), dimensions=("p.k",)), c)
    assert plan.symmetric and {f.cube for f in plan.symmetric.facts} == {"x", "y"}
    with pytest.raises(FanOutError):
        build_plan(SemanticQuery(measures=("x.n",), dimensions=("y.k",)), c)


@pytest.mark.parametrize(
    "bad",
    [
        lambda: Cube(name="x", alias="x"),
        lambda: Cube(name="x", alias="x", table="t", measures=[Measure(name="r", agg="ratio", numerator="a", denominator="b")]),
        lambda: Cube(name="x", alias="x", table="t", tenancy="discriminator"),
        lambda: Cube(name="x", alias="x", table="t", measures=[Measure(name="a", sql="x", agg="avg")], rollups=[Rollup(name="r", physical_table="p", measures=("a",))]),
        lambda: Measure(name="a", sql="x", agg="nope"),
        lambda: Dimension(name="a", sql="x", type="string", mask_roles=("r",)),
        lambda: TimeDimension(name="a", sql="x", type="date", granularities=("hour",)),
        lambda: DerivedTable("WITH a AS (SELECT 1) SELECT * FROM a"),
        lambda: Catalog([cube("a", ("nowhere", "many_to_one"))]),
        lambda: Catalog([cube("a"), cube("a")]),
        lambda: Catalog([Cube(name="a", alias="a", table="t", scope="missing")]),
    ],
)
def test_contradictions_in_a_catalog_are_refused(bad):
    with pytest.raises(CatalogError):
        bad()


def test_collecting_all_problems():
    c = Catalog([cube("a", ("nowhere", "many_to_one")), Cube(name="b", alias="a", table="t")], collect=True)
    assert len(c.problems) == 2


def test_foreign_keys_and_extends(catalog):
    assert any(j.to == "customer" for j in catalog.cubes["orders"].joins)
    assert catalog.cubes["regional"].get("total").sql == "{rg}.o_totalprice"


SQL = [
    "SELECT orders.status, SUM(orders.total) FROM orders GROUP BY orders.status",
    "SELECT status AS s, order_count FROM orders WHERE custkey IN (1, 2) AND priority LIKE '%HIGH%' AND status IS NOT NULL ORDER BY order_count DESC LIMIT 3 OFFSET 1",
    "SELECT DATE_TRUNC('month', o.orderdate), COUNT(*) FROM orders o WHERE o.orderdate BETWEEN '1996-01-01' AND '1997-01-01' AND (o.status = 'F' OR NOT (o.custkey > 10))",
    "SELECT /*+ COMPARE prior_period */ orders.status, AVG(orders.avg_total) FROM orders WHERE orders.orderdate BETWEEN '1996-01-01' AND '1997-01-01' HAVING AVG(orders.avg_total) > 10",
    "SELECT customer.segment, SUM(orders.total) AS t FROM orders JOIN customer ON orders.custkey = customer.custkey WHERE 5 < orders.custkey",
]


@pytest.mark.parametrize("sql", SQL)
def test_sql_round_trip(sql, catalog):
    q = sqlfront.parse_sql(sql, catalog)
    assert sqlfront.parse_sql(sqlfront.query_to_sql(q, catalog), catalog) == q
    assert not validate(q, catalog)


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE orders",
        "SELECT * FROM orders",
        "SELECT status FROM nowhere",
        "SELECT status FROM orders WHERE priority NOT LIKE '%x%'",
        "SELECT status FROM orders WHERE lower(status) = 'f'",
        "SELECT status FROM orders WHERE custkey BETWEEN 1 AND 2",
        "SELECT status FROM orders LEFT JOIN customer ON 1 = 1",
        "SELECT status, SUM(total) OVER (PARTITION BY status) FROM orders",
        "SELECT status FROM (SELECT 1) t",
        "SELECT status FROM orders; DELETE FROM orders",
        "SELECT statuss FROM orders",
        "SELECT SUM(orders.status) FROM orders",
        "SELECT status FROM orders HAVING order_count > 1 OR total > 2",
    ],
)
def test_sql_outside_the_dialect_is_refused(sql, catalog):
    with pytest.raises(SqlFrontError):
        sqlfront.parse_sql(sql, catalog)
    assert sqlfront.parse(sql, catalog, strict=False).problems


def test_what_sql_cannot_say(catalog):
    with pytest.raises(UnparseError):
        sqlfront.query_to_sql(SemanticQuery(measures=("lineitem.rows",), segments=("lineitem.bulky",)))


hostile = st.text(max_size=12)


@settings(max_examples=60, deadline=None)
@given(hostile)
def test_any_text_survives_the_round_trip_as_a_value(text):
    q = SemanticQuery(measures=("orders.total",), filters=(Filter(dimension="orders.status", op="eq", values=(text,)),))
    assert sqlfront.parse_sql(sqlfront.query_to_sql(q)).filters[0].values == (text,)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["orders.total", "lineitem.revenue", "customer.cust_count", "orders.nope", "x"]), max_size=3), st.lists(st.sampled_from(["orders.status", "customer.segment", "part.brand", "orders.total"]), max_size=3))
def test_validate_agrees_with_planning(measures, dims):
    c = CATALOG
    q = SemanticQuery(measures=tuple(dict.fromkeys(measures)), dimensions=tuple(dict.fromkeys(dims)))
    try:
        build_plan(q, c, one_source=False)
        ok = True
    except EngineError:
        ok = False
    assert (not validate(q, c)) == ok


CATALOG = showcase.catalog()


def test_planning_is_fast(catalog):
    q = SemanticQuery(measures=("lineitem.revenue",), dimensions=("cust_nation.name", "supp_nation.name"), filters=tuple(Filter(dimension="orders.status", op="neq", values=(str(i),)) for i in range(20)))
    build_plan(q, catalog)
    began = time.perf_counter()
    for _ in range(10):
        build_plan(q, catalog)
    assert (time.perf_counter() - began) / 10 < 0.05
    began = time.perf_counter()
    Catalog([cube(f"c{i}", *([(f"c{i - 1}", "many_to_one")] if i else [])) for i in range(1000)])
    assert time.perf_counter() - began < 2


def test_time_helpers():
    assert previous_range("2024-01-15", "2024-01-22") == ("2024-01-08", "2024-01-15")
    day = datetime(2026, 1, 11, 5)
    assert floor_instant(day, "week") == datetime(2026, 1, 5) and floor_instant(day, "week", "sunday") == datetime(2026, 1, 11)
    assert floor_instant(datetime(2026, 1, 17), "week", "sunday") == datetime(2026, 1, 11)
    assert floor_instant(datetime(2026, 8, 17), "quarter") == datetime(2026, 7, 1)


def test_query_from_json():
    q = from_dict({"measures": ["orders.total"], "where": {"op": "not", "children": [{"dimension": "orders.status", "op": "eq", "values": ["F"]}]}, "time_dimension": {"dimension": "orders.orderdate", "range": ["1996-01-01", "1997-01-01"]}, "order": [["orders.total", "desc"]]})
    assert q.where.children[0].values == ("F",) and q.order == (("orders.total", "desc"),)
    with pytest.raises(CompileError):
        from_dict({"measure": []})


def test_units():
    u = Units()
    assert u.convert(2, "hours", "s") == 7200
    assert u.auto_pick(7200, "s") == (2.0, "hour")
    with pytest.raises(CompileError):
        u.factor("hour", "gram")


def test_lookups(catalog):
    assert resolve(catalog, "orders.status", "Open")[0].value == "O"
    assert outcome(resolve(catalog, "orders.status", "opn")).status == "ambiguous"  # pending is alike as well
    assert outcome(resolve(catalog, "orders.status", "fill")).value == "F"
    assert outcome(resolve(catalog, "orders.status", "zzzz")).status == "unknown"


def test_rewrites():
    q = SemanticQuery(measures=("orders.total",), dimensions=("orders.status",), order=(("orders.status", "asc"),))
    more = rewrite.rewrite(q, rewrite.DrillDown("orders.priority"), rewrite.RollUp("orders.status"), rewrite.SetLimit(5), rewrite.SwapMeasure("orders.total", "orders.order_count"))
    assert more == SemanticQuery(measures=("orders.order_count",), dimensions=("orders.priority",), limit=5)


def test_diff_and_lint():
    old = Catalog([cube("a", ("b", "many_to_one")), cube("b")])
    new = Catalog([cube("a").with_(measures=(Measure(name="n", sql="x", agg="sum"),)), cube("b")])
    kinds = {c.kind: c.breaking for c in diff.diff(old, new)}
    assert kinds == {"measure_agg_changed": True, "field_sql_changed": True, "join_removed": True}
    keyed = Catalog([cube("b").with_(primary_key="k", dimensions=(replace(cube("b").dimensions[0], aliases=("kk", "new")), *cube("b").dimensions[1:]))])
    older = Catalog([cube("b").with_(dimensions=(replace(cube("b").dimensions[0], aliases=("kk", "old")), *cube("b").dimensions[1:]))])
    assert {(c.kind, c.breaking) for c in diff.diff(older, keyed)} == {("cube_primary_key_changed", True), ("field_alias_removed", True), ("field_alias_added", False)}
    assert {"isolated-cube", "missing-description"} <= {f.rule for f in lint.lint(new)}


def test_cost():
    c = Catalog([cube("a", ("b", "many_to_one")).with_(size_hint=100), cube("b")])
    found = cost.estimate(SemanticQuery(measures=("a.n",), dimensions=("b.k",)), c)
    assert found.rows == {"a": 100, "b": None} and found.joins == 1
    with pytest.raises(CompileError):
        cost.check_budget(found, cost.Budget(max_rows=10))


def test_search(catalog):
    index = search.WordIndex(search.entries(catalog))
    assert index.search("revenue")[0].entry.ref == "lineitem.revenue"
    vectors = search.VectorIndex(search.entries(catalog), lambda texts: [[t.count(c) for c in "aeiourst"] for t in texts])
    assert len(vectors.diverse("revenue", 3)) == 3
    assert search.fuse([index.search("revenue"), vectors.search("revenue")], 3)


def test_charts():
    from cubeloom.engine import ColumnMeta

    dim, time_, number = ColumnMeta("d", "dimension"), ColumnMeta("t", "time"), ColumnMeta("m", "measure", additive=True)
    assert charts.decide((number,), 1).kind == "big_number"
    assert charts.decide((time_, number), 10).kind == "line"
    assert charts.decide((dim, number), 10).kind == "bar"
    assert charts.decide((dim, number), 4, preferred="pie").kind == "pie"
    assert charts.decide((dim, number), 500).kind == "table"
    assert charts.decide((time_, number), 10, supported=("table",)).kind == "table"


def test_descriptions(catalog):
    assert "| `revenue` | measure | sum |" in describe.markdown(catalog)
    assert '"orders" -> "customer"' in describe.dot(catalog)
    compile(describe.field_module(catalog), "fields", "exec")
    full = describe.prompt(catalog)
    assert len(describe.prompt(catalog, max_chars=len(full) // 3)) <= len(full) // 3
    assert describe.query_schema()["properties"]["limit"]["type"] == "integer"


def test_identity():
    import base64
    import hashlib
    import hmac
    import json

    def part(data):
        return base64.urlsafe_b64encode(json.dumps(data).encode()).decode().rstrip("=")

    def token(alg="HS256", secret=b"k", **claims):
        body = f"{part({'alg': alg})}.{part({'sub': 'ann', 'roles': 'a b', 'exp': 100} | claims)}"
        return body + "." + base64.urlsafe_b64encode(hmac.new(secret, body.encode(), hashlib.sha256).digest()).decode().rstrip("=")

    who = identity.from_hmac_token(token(tenant="t"), b"k", now=50)
    assert (who.viewer_id, who.tenant, who.roles) == ("ann", "t", ("a", "b"))
    for bad in (token(alg="none"), token(secret=b"x"), token(exp=1), "x.y", token(sub=None)):
        with pytest.raises(EngineError):
            identity.from_hmac_token(bad, b"k", now=50)


def test_windows_need_known_grains():
    with pytest.raises(CompileError):
        TimeWindow(dimension="a.b", granularity="decade")
