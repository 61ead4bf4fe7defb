"""Every named query against its SQL twin."""

import os

import duckdb
import pytest

from quarry.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(DATA))] if os.path.isdir(DATA) else []


def norm(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for r in rows:
        out.append(tuple(round(v, 5) if isinstance(v, float) else v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v for v in (r[i] for i in order)))
    return sorted(out, key=repr)


@pytest.mark.skipif(not TABLES, reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    want = c.execute(catalogue.ORACLES[name])
    names = [d[0] for d in want.description]
    df = catalogue.QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert norm(df.collect(), df.columns) == norm(want.fetchall(), names)


def test_graph_queries_send_no_table_to_all_executors(spark):
    """Names, nodes and callers grow with the input; static plans broadcast them where parquet files are small."""
    for name in ("call_graph", "dead_code", "dead_functions", "unused_types", "refactoring_report"):
        plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" not in plan, name


def test_call_graph_resolves_names_of_files_without_a_folder(spark):
    from quarry.operators import graph

    symbols = spark.createDataFrame([("i1", "a", "x/f.go"), ("i2", "b", "x/f.go"), ("i3", "b", "y/g.go"), ("i0", "c", "h.go")], "id string, name string, path string")
    refs = [("r1", "a", "pkg.b", "y/z.go"), ("r1", "a", "b", None), ("r2", "b", "i0", "h.go"), ("r3", None, "a", "x/f.go"), ("r4", "a", "c", "h.go")]
    edges = graph.call_graph(symbols, spark.createDataFrame(refs, "id string, from_symbol string, to_symbol string, file_path string"))
    assert {tuple(r) for r in edges.collect()} == {("i1", "i3"), ("i1", "i2"), ("i2", "i0"), ("i1", "i0")}


def test_line_classes_strip_each_line_once_and_measure_nothing_else(spark):
    plan = catalogue.QUERIES["line_classes"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 1 + 2 and "regexp_count" not in plan, plan  # two strip the marks that open a block in _comment
