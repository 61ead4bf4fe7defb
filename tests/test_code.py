"""Measures of source texts on cases that the test tables don't hold."""

from quarry.operators import code


def test_complexity(spark):
    go = "func a() {\n  if x && y {\n    return 1\n  }\n}\n"
    rows = [(1, go), (2, None), (3, ""), (4, "}\n}\n{"), (5, "{{{"), (5, "{{{")]
    got = {r.id: r for r in code.complexity(spark.createDataFrame(rows, "f long, text string"), "f", "text").collect()}
    assert (got[1].lines, got[1].returns, got[1].cyclomatic, got[1].max_nesting, got[1].cognitive, got[1].rating) == (5, 1, 3, 2, 7, "low")
    assert [(got[k].lines, got[k].cyclomatic, got[k].max_nesting) for k in (2, 3, 4, 5)] == [(0, 1, 0), (0, 1, 0), (3, 1, 0), (1, 1, 3)]


def test_evolution_orders_ties(spark):
    rows = spark.createDataFrame([(1, "a", 5, 1), (1, "b", 5, 2), (1, "b", 4, 9), (2, None, 1, 1)], "part long, author string, day long, seq long")
    got = {r.part: tuple(r)[1:] for r in code.evolution(rows, "part", "author", ["day", "seq"]).collect()}
    assert got == {1: (3, 2, "b", "b"), 2: (1, 0, None, None)}
