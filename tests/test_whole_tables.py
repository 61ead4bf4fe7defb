"""Queries over whole tables, against brute force."""

import collections
import itertools

from quarry.plans import catalogue


def saved(at, **tables):
    for name, df in tables.items():
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


def test_related_changes_of_all_commits(spark, tmp_path):
    lines = [(o, o * k % 7) for o in (1, 300, 301, 90000) for k in range(1, 5)]
    at = saved(tmp_path, lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long"))
    want = collections.Counter((a[0], a[1], b[1]) for a, b in itertools.product(lines, lines) if a[0] == b[0] and a[1] != b[1])
    got = catalogue.QUERIES["related_changes"](spark, at).collect()
    assert {(r.l_orderkey, r.part, r.related): r.n for r in got} == want and len(got) == len(want)


def test_graph_of_all_lines_and_parts(spark, tmp_path):
    lines = [(1, 100, 3, "F", 50.0), (703, 200, 1, "O", 9.0), (1401, 0, 1, "F", 2.0), (900, 300, 1, "O", 1.0)]
    parts = [(k, k % 5) for k in (1, 2, 499, 703, 900, 1401, 2101, 20000)]
    docs = [(1, "if a", "en"), (2, "for b", "fr"), (3, "while", None)]
    at = saved(tmp_path, lineitem=spark.createDataFrame(lines, "l_partkey long, l_suppkey long, l_linenumber int, l_linestatus string, l_quantity double"), part=spark.createDataFrame(parts, "p_partkey long, p_size int"), documents=spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    live = {1}
    while more := {7 * s + n for p, s, n, *_ in lines if p in live} - live:
        live |= more
    assert live == {1, 703, 1401}
    assert sorted(r.node for r in catalogue.QUERIES["reachability"](spark, at).collect()) == sorted(live)
    assert {r.doc_id: r.points for r in catalogue.QUERIES["decision_counts"](spark, at).collect()} == {1: 1, 2: 1, 3: 1}


def test_related_changes_are_not_shuffled_as_pairs(spark, tmp_path):
    lines = [(o, p) for o in (1, 2, None) for p in (5, 5, 6, 7, None)]
    at = saved(tmp_path, lineitem=spark.createDataFrame(lines, "l_orderkey long, l_partkey long"))
    df = catalogue.QUERIES["related_changes"](spark, at)
    assert {(r.l_orderkey, r.part, r.related, r.n) for r in df.collect() if r.l_orderkey == 1} == {(1, 5, 6, 2), (1, 6, 5, 2), (1, 5, 7, 2), (1, 7, 5, 2), (1, 6, 7, 1), (1, 7, 6, 1)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_histories_and_memories_are_ranked_in_many_tasks(spark):
    for name in ("history_ranked", "memory_search"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert str(1 << 30) not in plan, name
