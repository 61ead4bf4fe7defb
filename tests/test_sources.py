"""Files, git, trees, streams, providers and settings."""

import json
import os
import subprocess

import pytest

from quarry import providers
from quarry.functions.code import matches_glob
from quarry.operators import summary
from quarry.sources import files, git, tree
from quarry.streaming import watch


def run(root, *args):
    env = os.environ | {"GIT_AUTHOR_DATE": "2024-01-02T00:00:00Z", "GIT_COMMITTER_DATE": "2024-01-02T00:00:00Z"}
    subprocess.run(["git", "-C", str(root), "-c", "user.name=Ann", "-c", "user.email=ann@x.org", "-c", "init.defaultBranch=main", "-c", "commit.gpgsign=false", *args], check=True, capture_output=True, env=env)


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    run(root, "init", "-q")
    (root / "a.go").write_text("func a() {\n}\n")
    (root / "lib").mkdir()
    (root / "lib/b.py").write_text("def b():\n  return 1\n")
    (root / ".gitignore").write_text("*.tmp\n")
    run(root, "add", ".")
    run(root, "commit", "-qm", "first")
    run(root, "tag", "v1")
    (root / "a.go").write_text("func a() {\n  x()\n}\n")
    run(root, "commit", "-qam", "second")
    (root / "new.go").write_text("x")
    (root / "no.tmp").write_text("x")
    return str(root)


def test_git(spark, repo):
    assert [r.path for r in git.tracked(spark, repo, exclude=["lib/**"]).orderBy("path").collect()] == [".gitignore", "a.go", "new.go"]
    assert [r.path for r in git.tracked(spark, repo, ["**/*.go"], most=1).collect()] == ["a.go"]
    log = git.commits(spark, repo).collect()
    assert [r.message for r in log] == ["second", "first"] and log[0].author_email == "ann@x.org" and (log[0].insertions, log[0].deletions) == (1, 0)
    first = log[1].hash
    assert [r.message for r in git.commits_after(spark, repo, first).collect()] == ["second"] and git.commits_after(spark, repo, "").count() == 2
    assert [r.message for r in git.commits_between(spark, repo, first, "").collect()] == ["second"] and git.commits(spark, repo, limit=1).count() == 1
    changes = git.changes(git.commits(spark, repo).select("hash"), repo).collect()
    assert sorted((r.commit_hash == first, r.file_path, r.change_type) for r in changes) == [(False, "a.go", "M"), (True, ".gitignore", "A"), (True, "a.go", "A"), (True, "lib/b.py", "A")]
    assert [(r.line, r.summary) for r in git.blame(spark, repo, "a.go").orderBy("line").collect()] == [(1, "first"), (2, "second"), (3, "first")]
    assert [r.line for r in git.blame(spark, repo, "a.go", 2, 2).collect()] == [2]
    assert [tuple(r) for r in git.tags(spark, repo).collect()] == [("v1", first)] and git.head(repo) == log[0].hash
    s = git.state(spark, repo).first()
    assert (s.branch, s.commit, s.dirty_files, s.merging, s.rebasing, s.conflicts, s.project_id) == ("main", log[0].hash, ["new.go"], False, False, [], first[:8])
    assert [r.path for r in git.changed_since(spark, repo, first).collect()] == ["a.go"]
    assert [tuple(r) for r in git.status_of(spark, repo, ["*.go"]).collect()] == [("new.go", "??")]
    with pytest.raises(git.GitError):
        git.tracked(spark, "/")


def test_merge_sides(spark, tmp_path):
    run(tmp_path, "init", "-q")
    note = tmp_path / "n.jsonl"
    for branch, text in (("main", "0"), ("other", "2"), ("main", "1")):
        if branch == "other" or text == "1":
            run(tmp_path, "checkout", "-q", *(["-b"] if branch == "other" else []), branch)
        note.write_text(json.dumps({"id": "a", "content": text}) + "\nbad line\n")
        run(tmp_path, "add", ".")
        run(tmp_path, "commit", "-qm", text)
    with pytest.raises(subprocess.CalledProcessError):
        run(tmp_path, "merge", "other")
    sides = git.merge_sides(spark, str(tmp_path), "n.jsonl", "id string, content string")
    assert [[r.content for r in s.collect()] for s in sides] == [["0"], ["1"], ["2"]]
    state = git.state(spark, str(tmp_path)).first()
    assert state.merging and state.conflicts == ["n.jsonl"]


def test_files(spark, repo, tmp_path):
    got = {r.path: (r.content, r.language) for r in files.source_files(spark, repo, "1KB", ["**/*.go", "**/*.py"], ["lib/**"]).collect()}
    assert got == {"a.go": ("func a() {\n  x()\n}\n", "go"), "new.go": ("x", "go")}
    assert {r.path for r in files.walked(spark, repo, ["**/*.go"]).collect()} == {"a.go", "new.go"}
    (tmp_path / "x.tmp").write_bytes(b"\xff ok")
    assert [(r.path, r.content) for r in files.walked(spark, str(tmp_path)).collect()] == [("x.tmp", "\ufffd ok")]
    with pytest.raises(ValueError):
        files.source_files(spark, repo, most=1)
    assert [files.size_of(x) for x in ("1MB", "2 kb", "7B", "3GB", "12", "x", "")] == [1 << 20, 2048, 7, 3 << 30, 0, 0, 0]


def test_json_lines(spark, tmp_path):
    at, schema = str(tmp_path / "n"), "id string, n long"
    table = spark.createDataFrame([("a", 1), (None, None)], schema)
    files.save_records(table, at)
    files.save_records(table.filter("n = 1"), at)
    files.append_records(table, at)
    assert sorted(map(tuple, files.records(spark, at, schema).collect()), key=repr) == [("a", 1), ("a", 1), (None, None)]
    bad = tmp_path / "bad"
    bad.write_text('{"id": "a", "n": 1}\n\noops\n{"id": "b"}\n')
    assert sorted(map(tuple, files.records(spark, str(bad), schema, strict=False).collect())) == [("a", 1), ("b", None)]
    with pytest.raises(Exception):
        files.records(spark, str(bad), schema).collect()
    long_ = tmp_path / "long"
    long_.write_text(json.dumps({"id": "x" * (1 << 20)}) + "\n")
    with pytest.raises(Exception):
        files.records(spark, str(long_), schema).collect()
    files.exported({"notes": table}, str(tmp_path / "out"))
    back = files.imported(spark, str(tmp_path / "out"), {"notes": schema})
    assert back["notes"].count() == 2 and files.cleared(back)["notes"].count() == 0


def test_hash_cache(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, hash string")
    cache = files.put_hashes(spark.createDataFrame([("z", "0", "k")], "path string, hash string, config_hash string"), now.filter("path <> 'c'").selectExpr("path", "hash", "'k' as config_hash"))
    assert {r.path for r in files.stale(now, cache, "k").collect()} == {"c"} and files.stale(now, cache, "other").count() == 3
    assert [r.path for r in files.deleted(now, cache).collect()] == ["z"]


GLOBS = [("*.go", "main.go", True), ("*.go", "dir/main.go", True), ("**/*.go", "a/b/main.go", True), ("src/**", "src/a/b.go", True), ("src/**", "lib/a.go", False), ("**/node_modules/**", "a/node_modules/b.js", True), ("**/bin/**", "/binary", True), ("*.py", "main.go", False), ("cmd/*.go", "cmd/x.go", True)]


def test_globs(spark):
    for glob, path, want in GLOBS:
        df = spark.createDataFrame([(path,)], "p string")
        assert df.filter(matches_glob(df.p, glob, "tree")).count() == want, (glob, path)
    one = spark.createDataFrame([("src/a/b.go",)], "p string")
    hit = lambda g, d: one.filter(matches_glob(one.p, g, d)).count()
    assert [hit(g, "index") for g in ("**/a/**", "src/**/*.go", "src/**/b", "**/*.py", "b.go", "[ab].go")] == [1, 1, 1, 0, 1, 1]
    assert [hit(g, "history") for g in ("*", "src/**", "x*")] == [1, 1, 0] and [hit(g, "people") for g in ("SRC/*", "*.py")] == [1, 0]


def test_tree(spark):
    f = spark.createDataFrame([("a/b/c.go", 1), ("a/d.go", 2), ("e.go", 3), (".git/x", 4), ("node_modules/y.js", 5), (None, 6)], "path string, size long")
    t = tree.nodes(f, 2, indexed=spark.createDataFrame([("a/d.go",)], "path string"))
    assert [(r.path, r.files, r.indexed, r.truncated) for r in t.collect()] == [(".", 3, 1, False), ("a", 2, 1, False), ("e.go", 1, 0, False), ("a/b", 1, 0, True), ("a/d.go", 1, 1, False)]
    assert [r.line for r in tree.printed(t).collect()] == ["./ (3 files, 1 indexed)", "  a/ (2 files, 1 indexed)", "    b/ (1 files, 0 indexed)", "    d.go", "  e.go"]
    assert tree.nodes(f, 0).count() == 1 and tree.nodes(f, 9, hidden=True, include=["**/*.go"]).count() == 6


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    (src / "deep").mkdir(parents=True)
    (src / "a.go").write_text("one")
    (src / "deep/b.py").write_text("two")
    (src / ".hid").write_text("no")
    told = []
    rows_of = lambda batch: batch.select("path", "content")
    go = lambda: watch.follow(watch.arriving(spark, str(src)), str(tmp_path / "out"), rows_of, str(tmp_path / "check"), lambda n, k: told.append(k)).awaitTermination()
    go()
    (src / "c.go").write_text("three")
    go()
    got = watch.newest_batches(spark.read.parquet(str(tmp_path / "out")))
    assert sorted(r.content for r in got.collect()) == ["one", "three", "two"] and sum(told) == 3
    index = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x")], "path string, content string")
    changed, removed = index.filter("path = 'a'").selectExpr("path", "'new' as content"), index.filter("path = 'b'").select("path")
    assert sorted(map(tuple, watch.reindexed(index, changed, removed, lambda d: d).collect())) == [("a", "new"), ("c", "x")]
    log = spark.createDataFrame([(1, "start", "")], "at int, event string, detail string")
    log = watch.branch_switch(watch.branch_switch(log, "a", "a", watch.F.lit(2)), "a", "b", watch.F.lit(3))
    assert [r.detail for r in watch.session_log(log, 5).collect()] == ["a -> b", ""]


def test_providers(spark):
    r = providers.registry()
    e = r.create("embedding", "hash", dimensions=40)
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "id string, content string")
    got = {x.id: x.embedding for x in providers.embedded(rows, e, batch=2).collect()}
    assert got["a"] == got["b"] != got["c"] and len(got["a"]) == 40 and set(got) == {"a", "b", "c"} and all(-1 <= v <= 1 for v in got["a"])
    asked = []
    send = lambda url, body: asked.append(len(str(body.get("prompt", "")))) or {"embedding": [1.0]}
    assert providers.SingleEmbedder(send, "m", "u").embed(["x" * 9000, "y"]) == [[1.0], [1.0]] and asked == [8000, 1]
    many = lambda url, body: {"data": [{"index": i, "embedding": [float(len(t))]} for i, t in reversed(list(enumerate(body["input"])))]}
    assert providers.BatchEmbedder(many, "m", "u").embed(["a" * k for k in range(150)]) == [[float(k)] for k in range(150)]
    model = providers.PromptReranker(lambda url, body: {"response": "0.9\nthen 1.0, .2"}, "m", "u")
    assert model.rerank("q", ["a", "b", "c", "d"]) == [0.9, 1.0, 0.5, 0.5] or model.rerank("q", ["a", "b"]) == [0.9, 1.0]
    with pytest.raises(KeyError):
        r.create("embedding", "none")
    with pytest.raises(ValueError):
        r.register("embedding", "hash", providers.HashEmbedder)
    assert providers.chunk_tokens(2000, 1000) == 900 and providers.chunk_tokens(500, 1000) == 500 and providers.chunk_tokens(None, None) == 1800


def test_settings():
    s, w = providers.settings("# c\nsearch:\n  limit: 5\n  mode: vector\nodd line\nother: 3\n", "large_project", search__limit=7)
    assert s["search.limit"] == 7 and s["search.mode"] == "vector" and s["reranker.candidates"] == 50 and len(w) == 2
    assert providers.problems(s) == [] and len(providers.problems(s | {"search.mode": "x", "search.limit": 0, "search.bm25_weight": 2})) == 3
    back, w = providers.settings(providers.settings_text(s))
    assert back == s and not w and providers.settings_hash(s) == providers.settings_hash(s | {"search.limit": 9}) != providers.settings_hash(s | {"chunking.max_tokens": 9})
    assert [providers.project_class(n) for n in (5, 100, 1000, 10_000)] == ["small", "medium", "large", "huge"]


GO = 'package x\n\nimport (\n\tf "fmt"\n)\n\n/* a\nblock */\ntype Shape struct {\n\tName string\n\tsize int\n}\n\nfunc (s *Shape) Area(a, b int) int {\n\tif a > 0 && b > 0 {\n\t\treturn a\n\t}\n\t// done\n\treturn b\n}\n\nfunc helper() {}\n'
PY = 'import os\n"""doc\nmore\n"""\nclass A:\n    def m(self):\n        pass\n\ndef top(x):\n    # c\n    if x:\n        return 1\n    return 2\n\ndef _own():\n    return 3\n'


def test_summaries(spark):
    f = spark.createDataFrame([("a.go", GO, "go"), ("b.py", PY, "python"), ("c", None, None), ("d.html", "<!-- a\nb -->\n<p>", "html")], "path string, content string, language string")
    m = {r.path: r for r in summary.measures(f).collect()}
    assert [(m[p].total_lines, m[p].blank_lines, m[p].comment_lines, m[p].code_lines) for p in ("a.go", "b.py", "c", "d.html")] == [(22, 4, 3, 15), (16, 2, 4, 10), (0, 0, 0, 0), (3, 0, 2, 1)]
    assert (m["a.go"].cyclomatic, m["a.go"].max_nesting, m["a.go"].returns, m["a.go"].cognitive) == (3, 2, 2, 7) and m["a.go"].suggestions == []
    part = {r.path: r.total_lines for r in summary.measures(f, summary.F.lit(9), summary.F.lit(12)).collect()}
    assert part["a.go"] == 4 and part["c"] == 0
    d = summary.definitions(f).collect()
    assert sorted((r.path, r.what, r.name, r.start_line, r.end_line, r.parameters, r.complexity, r.exported) for r in d if r.what == "function") == [
        ("a.go", "function", "Area", 14, 20, 2, 3, True), ("a.go", "function", "helper", 22, 22, 0, 1, False), ("b.py", "function", "_own", 15, 16, 0, 1, False), ("b.py", "function", "m", 6, 8, 1, 1, True), ("b.py", "function", "top", 9, 14, 1, 2, True)]
    assert [(r.name, r.kind, r.fields) for r in d if r.what == "type" and r.path == "a.go"] == [("Shape", "struct", ["Name", "size"])]
    s = {r.path: r for r in summary.file_summary(f).collect()}
    assert (s["a.go"].functions, s["a.go"].types, s["a.go"].longest_function, s["c"].functions) == (2, 1, 7, 0)
    assert [(r.name, r.line) for r in summary.exports(summary.definitions(f)).collect() if r.path == "a.go"] == [("Shape", 9), ("Area", 14)]
    assert sorted((r.path, r.target, r.alias, r.is_local) for r in summary.imports(f).collect()) == [("a.go", "fmt", "f", True), ("b.py", "os", "", False)]
    n = spark.createDataFrame([(5,), (2048,), (3 << 20,), (5 << 30,)], "n long")
    assert [r[0] for r in n.select(summary.bytes_text(n.n)).collect()] == ["5 B", "2.0 KB", "3.0 MB", "5.0 GB"]
    dec = spark.createDataFrame([("d", "T", "accepted", "why", "do", None)], "id string, title string, status string, context string, decision string, consequences string")
    assert summary.decision_record(dec).first().markdown == "# T\n\n## Status\n\naccepted\n\n## Context\n\nwhy\n\n## Decision\n\ndo\n"
