"""Record tables: changes, filters and merges on cases that the test tables don't hold."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import filters, merge, records, stores

AT = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def now(spark):
    return F.expr("TIMESTAMP_NTZ '2024-01-31 00:00:00'")


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def test_put_takes_repeated_ids_once(spark):
    table = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old"), (None, 3, "old")], "id string, n int, s string")
    new = spark.createDataFrame([("a", 9, "new"), ("a", 8, "new"), (None, 7, "new"), ("c", None, "new")], "id string, n int, s string")
    got = rows(stores.put(table, new), "id", "n", "s")
    assert len(got) == 4 and ("a", 9, "new") in got and (None, 7, "new") in got and ("b", 2, "old") in got
    assert stores.put(table, new.limit(0)).count() == 3 and stores.put(table.limit(0), new).count() == 3


def test_symbols_get_their_lines(spark):
    s = spark.createDataFrame([], "id string, start_line long, end_line long, line_count long")
    new = spark.createDataFrame([("a", 3, 9, 0), ("b", 5, 2, None), ("c", 1, 2, 40)], "id string, start_line long, end_line long, line_count long")
    assert rows(stores.put_symbols(s, new), "id", "line_count") == [("a", 7), ("b", 1), ("c", 40)]


def test_chunks_and_vectors_of_files(spark):
    chunks = spark.createDataFrame([("a", "f", "x"), ("b", "g", "y")], "id string, file_path string, content string")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, embedding array<double>")
    new = spark.createDataFrame([("a", "f", "z", [5.0]), ("c", "h", "w", None)], "id string, file_path string, content string, embedding array<double>")
    c, v = stores.put_chunks(chunks, vectors, new)
    assert rows(c, "id", "content") == [("a", "z"), ("b", "y"), ("c", "w")] and rows(v, "chunk_id", "embedding") == [("a", [5.0]), ("b", [2.0])]
    symbols = spark.createDataFrame([("s", "f"), ("t", None)], "id string, file_path string")
    index = {"chunks": chunks, "vectors": vectors, "symbols": symbols, "refs": symbols}
    out = stores.without_file(index, "f")
    assert [rows(out[n], *out[n].columns[:1]) for n in ("chunks", "vectors", "symbols", "refs")] == [[("b",)], [("b",)], [("t",)], [("t",)]]
    cache = spark.createDataFrame([("g", "h1")], "path string, hash string")
    left = stores.without_files(index, cache)
    assert rows(left["chunks"], "id") == [("a",)] and rows(left["vectors"], "chunk_id") == [("a",)] and left["symbols"].count() == 2


def test_state(spark):
    state = spark.createDataFrame([], "key string, value string")
    assert stores.watermark(state) == "" and stores.metadata(state, "files long").count() == 0
    state = stores.put_watermark(stores.put_watermark(state, "h1"), "h2")
    state = stores.put_metadata(state, spark.createDataFrame([(3, "go")], "files long, lang string"))
    assert stores.watermark(state) == "h2" and rows(stores.metadata(state, "files long, lang string"), "files", "lang") == [(3, "go")] and state.count() == 2


def test_checkpoints_without_ids_change_nothing(spark, now):
    m = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "id string, channel string")
    empty = spark.createDataFrame([("x", [])], "channel string, memory_ids array<string>")
    assert stores.restored(m, empty).count() == 4
    saved = stores.checkpoint(m.filter("id <> 'b'"), F.lit("n"), F.lit("x"), now)
    assert rows(stores.restored(m, saved), "id") == [("a",), ("c",), ("d",)]
    left, n = stores.pruned(spark.createDataFrame([("a", datetime(2024, 1, 1)), ("b", None), ("c", datetime(2025, 1, 1))], "id string, expires_at timestamp_ntz"), now)
    assert rows(left, "id") == [("b",), ("c",)] and n.first()["pruned"] == 1
    assert rows(stores.consolidated(m), "id") == rows(m, "id")


def test_json_records(spark, now):
    kind = "id string, title string, content string, author string, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz"
    table = spark.createDataFrame([("a", "t", "c", "me", ["x"], None, None)], kind)
    new = spark.createDataFrame([(None, "t2", "c2", "", None), ("b", "", "c", None, None), ("d", "t", "  ", None, None)], "id string, title string, content string, author string, tags array<string>")
    got = stores.added(table, new, ["title", "content"], now, {"author": "ai"}).collect()
    made = next(r for r in got if r.id != "a")
    assert len(got) == 2 and made.author == "ai" and len(made.id) == 16 and made.created_at == AT
    change = spark.createDataFrame([("a", None, "new", [])], "id string, title string, content string, tags array<string>")
    r = stores.updated(table, change, now).first()
    assert (r.title, r.content, r.tags, r.updated_at) == ("t", "new", [], AT)
    issues = spark.createDataFrame([("a", "open", None, None), ("b", "resolved", datetime(2024, 1, 1), None)], "id string, status string, resolved_at timestamp_ntz, updated_at timestamp_ntz")
    done = stores.moved_to(issues, F.lit("resolved"), now, "resolved_at", "resolved")
    assert rows(done, "id", "resolved_at") == [("a", AT), ("b", datetime(2024, 1, 1))]
    again = stores.moved_to(done, F.lit("open"), now, "resolved_at", "resolved")
    assert rows(again, "id", "status", "resolved_at") == [("a", "open", None), ("b", "open", None)]
    assert stores.removed(table, F.col("id") == "a").count() == 0


def test_working_context(spark):
    c = spark.createDataFrame([("main", "parser", ["a.go"])], "branch string, task string, relevant_files array<string>")
    c = stores.with_relevant_file(stores.with_relevant_file(c, "b.go"), "b.go")
    c = stores.with_context(stores.with_relevant_file(c, "a.go", False), task="", branch="dev")
    assert rows(c, "branch", "task", "relevant_files") == [("dev", "parser", ["b.go"])]
    assert rows(stores.cleared_context(c), "branch", "task", "relevant_files") == [("dev", None, None)]
    log = spark.createDataFrame([(f"q{i}", i) for i in range(30)], "query string, at int")
    assert [r.query for r in stores.last_searches(log).collect()] == [f"q{i}" for i in range(29, 9, -1)]


def test_merge_strategies(spark):
    kind = "id string, title string, content string, file string, tags array<string>"
    base = spark.createDataFrame([("a", "t", "0", "f", ["x"]), (None, "t", "0", "f", None), ("d", "t", "0", "f", None)], kind)
    ours = spark.createDataFrame([("a", "t", "1", "f", ["y"]), ("a", "t", "1", "f", ["y"]), (None, "t", "0", "f", None), ("n", "t", "1", "f", None)], kind)
    theirs = spark.createDataFrame([("a", "t", "2", "f", ["z"]), (None, "t", "9", "f", None), ("n", "t", "2", "f", None), ("d", "t", "0", "f", None)], kind)
    got = {r.id: r for r in merge.merge_note_records(base, ours, theirs).collect()}
    assert got["a"].content == "1" + merge.JOINT + "2" and got["a"].tags == ["y", "z"] and got["a"].conflict and got[None].content == "9" and not got[None].conflict
    assert got["n"].content == "1" and got["n"].conflict and got["d"].action == "deleted" and got["d"].content is None and len(got) == 4
    theirs_win = {r.id: r for r in merge.merge_note_records(base, ours, theirs, "theirs").collect()}
    assert theirs_win["a"].content == "2" and theirs_win["n"].content == "2" and not any(r.conflict for r in theirs_win.values())


def test_names_and_like(spark):
    names = {"internal/config/config.go:DefaultConfig:96": ("DefaultConfig", "config.DefaultConfig"), "path/to/dart/b.go:Get:16": ("Get", "dart.Get"), "file.go:Func:1": ("Func", ""), "Func": ("Func", ""), "a:b:c": ("b", "")}
    assert {k: filters.names_of(k) for k in names} == names
    t = spark.createDataFrame([("a_b",), ("axb",), ("a%b",), (None,)], "name string")
    assert [t.filter(filters.like(F.col("name"), "A_B", e)).count() for e in (False, True)] == [3, 1]


def test_tracker_rows_and_actions(spark):
    text = '[{"number": 5, "title": "Crash", "body": "", "state": "OPEN", "url": "u", "author": {"login": "ann"}, "labels": [{"name": "P0"}, {"name": "bug"}]}, {"number": 6, "title": "Slow", "body": "b", "state": "CLOSED", "url": "v", "author": null, "labels": []}]'
    got = records.issue_rows(records.tracked_issues(spark.createDataFrame([(text,), ("oops",), (None,)], "json string"))).collect()
    assert [(r.id, r.title, r.severity, r.status) for r in got] == [("gh-5", "[#5] Crash", "critical", "open"), ("gh-6", "[#6] Slow", "minor", "resolved")]
    assert got[0].description == "Labels: P0, bug\nAuthor: ann\nURL: u" and got[1].description == "b\nURL: v"
    state = spark.createDataFrame([("stale", 0, 2, 0, 1)], "index_state string, conflicts int, dirty int, open_issues int, pending_todos int")
    assert [r.action for r in records.suggested_actions(state).orderBy("place").collect()] == ["update_index", "commit", "work_on_todos"]
