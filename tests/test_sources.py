"""Sources of several kinds under one catalog."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cubeloom.catalog import Catalog
from cubeloom.engine import Engine
from cubeloom.errors import AuthError, CompileError, PlaceholderError
from cubeloom.model import AuthContext, Cube, DerivedTable, Dimension, Join, Measure, NamedCTE, View
from cubeloom.query import Filter, QueryDefaults, SemanticQuery, TimeWindow
from cubeloom.sources import Files, Frames, Rows, Tables


def cube(name="t", alias="a", **more):
    return Cube(**{"name": name, "alias": alias, "table": name, "measures": [Measure(name="n", sql="*", agg="count"), Measure(name="total", sql=f"{{{alias}}}.v", agg="sum")], "dimensions": [Dimension(name="k", sql=f"{{{alias}}}.k", type="string")]} | more)


Q = SemanticQuery(measures=("t.total",), dimensions=("t.k",))
ROWS = [("x", 1), ("x", 2), ("y", 5)]
WANT = {"x": 3, "y": 5}


def answer(engine, q=Q, **how):
    return {r[0]: r[1] for r in engine.query(q, **how).collect()}


@pytest.mark.parametrize("form", ["parquet", "orc", "json", "csv"])
def test_files_of_any_format(spark, tmp_path, form):
    df = spark.createDataFrame(ROWS, "k string, v int")
    df.write.format(form).save(f"{tmp_path}/t.{form}")
    files = Files(str(tmp_path), format=form, schemas={"t": "k string, v int"})
    assert answer(Engine(spark, Catalog([cube()]), main=files)) == WANT


def test_session_tables_and_python_rows(spark):
    spark.createDataFrame(ROWS, "k string, v int").createOrReplaceTempView("t")
    assert answer(Engine(spark, Catalog([cube()]), main=Tables())) == WANT
    assert answer(Engine(spark, Catalog([cube()]), main=Rows(lambda table: ("k string, v int", ROWS)))) == WANT
    spark.catalog.dropTempView("t")


def test_a_stream_feeds_a_cube(spark, tmp_path):
    spark.createDataFrame(ROWS, "k string, v int").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("k string, v int").parquet(f"{tmp_path}/in")
    df = Engine(spark, Catalog([cube()]), main=Frames({"t": stream})).query(Q)
    assert df.isStreaming
    run = df.writeStream.outputMode("complete").format("memory").queryName("fed").option("checkpointLocation", f"{tmp_path}/c").start()
    run.processAllAvailable()
    run.stop()
    assert {r.k: r.total for r in spark.table("fed").collect()} == WANT


def test_sql_sources_share_ctes_and_see_their_own_tables(spark):
    frames = Frames({"raw": spark.createDataFrame(ROWS, "k string, v int")})
    big = NamedCTE("big", "SELECT * FROM raw WHERE v >= {floor_col}")
    c = cube(table="", source=DerivedTable("SELECT k, v FROM big WHERE k <> 'from raw'", (big,)))
    e = Engine(spark, Catalog([c]), main=frames)
    assert answer(e, context={"floor_col": "v"}) == WANT
    with pytest.raises(PlaceholderError):
        e.query(Q, context={"floor_col": "1; DROP TABLE raw"})
    with pytest.raises(PlaceholderError):
        e.query(Q)
    bad = cube(table="", source=DerivedTable("SELECT * FROM nowhere"))
    with pytest.raises(CompileError):
        Engine(spark, Catalog([bad]), main=frames).query(Q)


def test_reserved_names_and_odd_columns(spark):
    frames = Frames({"t": spark.createDataFrame([("x", 1, 2)], "`order` string, `select` int, `from` int")})
    c = cube(measures=[Measure(name="total", sql="{a}.select + {a}.from", agg="sum")], dimensions=[Dimension(name="k", sql="{t}.order", type="string")])
    assert answer(Engine(spark, Catalog([c]), main=frames)) == {"x": 3}


def test_schema_tenancy(spark):
    frames = Frames({"acme.t": spark.createDataFrame(ROWS, "k string, v int"), "globex.t": spark.createDataFrame([], "k string, v int")})
    e = Engine(spark, Catalog([cube(table="{tenant_schema}.t", tenancy="schema")]), main=frames)
    assert answer(e, viewer=AuthContext(viewer_id="x", tenant="acme")) == WANT
    assert answer(e, viewer=AuthContext(viewer_id="x", tenant="globex")) == {}
    with pytest.raises(AuthError):
        e.query(Q)


def test_security_sql_needs_its_context_and_binds_it(spark):
    c = cube(security_sql="{a}.k = {ctx.key}", security_ctx_keys=["key"])
    e = Engine(spark, Catalog([c]), main=Frames({"t": spark.createDataFrame(ROWS, "k string, v int")}))
    assert answer(e, context={"ctx.key": "x"}) == {"x": 3}
    assert answer(e, context={"ctx.key": "x' OR 'a'='a"}) == {}
    with pytest.raises(CompileError):
        e.query(Q)


def test_keys_of_different_types_are_cast_where_declared(spark):
    left = cube(dimensions=[Dimension(name="k", sql="{a}.k", type="number", coerce_to="string")], joins=[Join(to="u", relationship="many_to_one", on="{a}.k = {b}.k")])
    right = cube("u", "b", measures=[], dimensions=[Dimension(name="k", sql="{b}.k", type="string"), Dimension(name="name", sql="{b}.name", type="string")])
    frames = Frames({"t": spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), "u": spark.createDataFrame([("1", "one"), ("zwei", "two")], "k string, name string")})
    e = Engine(spark, Catalog([left, right]), main=frames)
    assert answer(e, SemanticQuery(measures=("t.total",), dimensions=("u.name",))) == {"one": 1}


def test_views_and_defaults(spark):
    frames = Frames({"t": spark.createDataFrame(ROWS, "k string, v int")})
    e = Engine(spark, Catalog([cube()], views=[View(name="w", fields={"amount": "t.total", "key": "t.k"})], defaults=QueryDefaults(limit=1)), main=frames)
    assert len(answer(e, SemanticQuery(measures=("w.amount",), dimensions=("w.key",), order=(("w.amount", "desc"),)))) == 1
    assert e.query(SemanticQuery(measures=("w.amount",), filters=(Filter(dimension="w.key", op="eq", values=("x",)),))).first()[0] == 3


def test_compiling_a_plan_checks_it_again(spark):
    frames = Frames({"t": spark.createDataFrame(ROWS, "k string, v int")})
    e = Engine(spark, Catalog([cube(required_roles=("boss",))]), main=frames)
    plan = e.explain(Q, AuthContext(viewer_id="b", roles=("boss",)))
    assert e.compile_plan(plan, viewer=AuthContext(viewer_id="b", roles=("boss",))).df.count() == 2
    with pytest.raises(AuthError):
        e.compile_plan(plan, viewer=AuthContext(viewer_id="x"))


def test_timestamps_with_and_without_zone_and_dates(spark):
    from cubeloom.model import TimeDimension

    base = spark.createDataFrame([("2024-01-01 23:30:00", 1), ("2024-01-02 00:30:00", 2)], "s string, v int")
    for kind, declared in (("timestamp_ntz", "time"), ("timestamp", "time"), ("date", "date")):
        frames = Frames({"t": base.withColumn("at", F.col("s").cast("timestamp_ntz").cast(kind))})
        e = Engine(spark, Catalog([cube(dimensions=[], time_dimensions=[TimeDimension(name="at", sql="{a}.at", type=declared)])]), main=frames)
        q = SemanticQuery(measures=("t.total",), time_dimension=TimeWindow(dimension="t.at", range=("2024-01-01", "2024-01-03"), granularity="day", fill_nulls_with=0))
        df = e.query(q)
        assert sorted(r[1] for r in df.collect()) == [1, 2]
        assert df.schema["at_day"].dataType.simpleString() == kind
