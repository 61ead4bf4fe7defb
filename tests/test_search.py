"""Search on small corpora, against SQLite's own full-text search and by hand."""

import math
import sqlite3

import pytest

from quarry.functions.stemming import stem
from quarry.operators import search

TEXTS = [
    "database connections are pooled", "a connection to the database", "connecting people", "running runs runner", "the runner ran", "Élan vital of the sea", "nothing here", "pooled database database",
    "snake_case and camelCase", "error handling in database code", "handled errors", "relational algebra", "a relation", None, "", "the the the the", "do or do not",
]
QUERIES = ["database connection", '"database connection"', "connection OR run", "database NOT connection", "élan", "runs", "errors AND handle", "relational", "pooled database", "nowhere", '"the the"', "vital sea"]


@pytest.fixture(scope="module")
def fts():
    c = sqlite3.connect(":memory:")
    c.execute("create virtual table f using fts5(content, tokenize='porter unicode61')")
    c.executemany("insert into f(rowid, content) values (?, ?)", [(i, t or "") for i, t in enumerate(TEXTS)])
    return c


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "id long, content string, w string").repartition(3)


@pytest.mark.parametrize("query", QUERIES)
def test_ranks_are_fts5s(corpus, fts, query):
    want = {i: -s for i, s in fts.execute("select rowid, bm25(f) from f where f match ?", (query,))}
    got = {r.id: r.bm25 for r in search.text_search(corpus, query, 50).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[i], want[i], rel_tol=1e-9) for i in got)


def test_queries_that_cannot_be_read(corpus):
    for q in ("NOT run", "main.go", "what is it?", "a,b", 'an "odd quote', "AND", "a AND", "a OR OR b"):
        with pytest.raises(search.QueryError):
            search.text_search(corpus, q, 5)
    assert search.text_search(corpus, "() *", 5).count() == 0 and search.text_search(corpus.limit(0), "run", 5).count() == 0


def test_stems_of_short_and_odd_words():
    assert [stem(w) for w in ("as", "is", "ponies", "sky", "agreed", "Élan", "x1ing")] == ["as", "is", "poni", "sky", "agre", "Élan", "x1ing"]


CHUNKS = "id string, content string, name string, language string, chunk_type string, file_path string, start_line long, end_line long"


def chunks(spark):
    rows = [("a", "open the door", "openDoor", "go", "function", "src/a.go", 2, 3), ("b", "close the door", "closeDoor", "go", "block", "src/a.go", 4, 6), ("c", "paint a wall", "paint", "py", "function", "lib/c.py", 1, 9)]
    vectors = [("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0]), ("gone", [1.0, 0.0])]
    return spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(vectors, "chunk_id string, embedding array<float>")


def test_modes_filters_and_fallbacks(spark):
    c, v = chunks(spark)
    ids = lambda **k: [(r.id, round(r.score, 4)) for r in search.search(c, v, search.Request(**k)).collect()]
    assert ids(vector=[1.0, 0.0], mode="vector") == [("a", 1.0), ("b", 0.6), ("c", 0.0)]
    assert ids(vector=[1.0, 0.0], query="what?", limit=2) == [("a", 1.0), ("b", 0.6)]  # unreadable: vectors alone, unweighted
    assert [i for i, _ in ids(query="door", mode="bm25")] == ["a", "b"] and [i for i, _ in ids(query="door", mode="bm25", chunk_types=("block",))] == ["b"]
    assert [i for i, _ in ids(vector=[0.0, 1.0], query="door", paths=("src/**",))] == ["b", "a"]
    both = dict(ids(vector=[0.0, 1.0], query="door"))
    bm = {r.id: r.bm25 for r in search.text_search(c, "door", 9, "id", ("id", "content", "name")).collect()}
    assert all(math.isclose(both[k], round(0.7 * s + 0.3 * bm.get(k, 0) / (1 + bm.get(k, 0)), 4), abs_tol=1e-3) for k, s in (("a", 0.0), ("b", 0.8), ("c", 1.0)))
    assert ids() == []


def test_rerankers_see_all_candidates_and_may_fail(spark):
    c, v = chunks(spark)
    seen = []

    def best_last(query, rows):
        seen.append(rows.count())
        return rows.select("id", (rows.id == "c").cast("double").alias("rerank"))

    def broken(query, rows):
        raise RuntimeError("no server")

    one = search.Request(vector=[1.0, 0.0], mode="vector", limit=1, rerank_candidates=3)
    assert [r.id for r in search.search(c, v, one, best_last).collect()] == ["c"] and seen == [3]
    assert [r.id for r in search.search(c, v, one, broken).collect()] == ["a"]


def test_context_and_lookup(spark):
    c, _ = chunks(spark)
    files = spark.createDataFrame([("src/a.go", "1\n2\n3\n4\n5"), ("lib/c.py", None)], "path string, content string")
    got = {r.id: (r.context_before, r.context_after) for r in search.with_context(c, files, 1).collect()}
    assert got == {"a": ("1", "4"), "b": ("3", ""), "c": ("", "")}
    wanted = spark.createDataFrame([("b",), ("src/a.go:any:3",), ("src/a.go:any:99",), ("x",), (None,)], "wanted string")
    assert sorted(tuple(r) for r in search.chunk_of(c, wanted).collect()) == [("b", "b"), ("src/a.go:any:3", "a")]


def test_fuzzy_files_and_names(spark):
    f = spark.createDataFrame([("src/search.go",), ("src/search_test.go",), ("search/x.go",), ("lib/research.py",), ("zzz",), ("srch.go",)], "path string")
    got = {r.path: r.score for r in search.fuzzy_files(f, "Search", None).collect()}
    assert {k: got[k] for k in ("src/search.go", "lib/research.py", "search/x.go")} == {"src/search.go": 0.9, "lib/research.py": 0.7, "search/x.go": 0.5}
    assert "zzz" not in got and 0.2 < got["srch.go"] <= 0.4


def test_words_that_go_to_python_come_without_their_text(spark, monkeypatch):
    """What Python is sent waits in a queue that goes to disk: all words of a text there, once for each word that is looked for, filled it."""
    plans, kept = [], search.tables.kept

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df)

    monkeypatch.setattr(search.tables, "kept", seen)
    rows = spark.createDataFrame([("a", "go go go licensing"), ("b", "gone"), ("c", "licensed going go"), ("d", None)], "id string, content string")
    found = search.text_search(rows, '"go go" OR license', 10)
    assert [r.id for r in found.collect()] == ["a", "c"]
    (sent,) = (line for line in plans[0].splitlines() if "ArrowEvalPython" in line)
    assert "ws#" not in sent and "content#" not in sent and "Generate" not in plans[0]
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()  # texts aren't read again


def test_hunks_meet_chunks_once_and_no_pair_is_shuffled(spark):
    """Also where a change has several hunks in a file, and an id stands for several ranges or is null."""
    lines = [(f"c{k % 7}", f"f{k % 2}", k * 37 % 300, k % 90) for k in range(60)] + [(None, "f0", 5, 1), ("c1", None, 5, 1), ("c2", "f1", None, 1)]
    ranges = [(f"k{k % 40}" if k % 13 else None, f"f{k % 3}", k * 11 % 310, k * 11 % 310 + k % 150) for k in range(90)]
    hunks = spark.createDataFrame(lines + lines[:9], "change_id string, file_path string, new_start long, new_lines long")
    chunks = spark.createDataFrame(ranges, "id string, file_path string, start_line long, end_line long")
    want = {(c, i) for c, f, s, n in lines for i, g, a, b in ranges if f is not None and f == g and s is not None and s <= b and s + n >= a}
    got = search.overlapping(hunks, chunks).collect()
    assert {(r.change_id, r.chunk_id) for r in got} == want and len(got) == len(want)
    single = spark.createDataFrame([(f"k{k}", "f0", 1, 9) for k in range(3)], chunks.schema)
    plan = search.overlapping(hunks, single)._jdf.queryExecution().optimizedPlan().toString()
    head = plan[: plan.index("Aggregate")].splitlines()
    assert head[0].startswith("Union") and any("Generate explode(ids" in x for x in head)  # pairs are listed after all grouping
