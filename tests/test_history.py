"""Histories, records and chunks on small texts written here."""

import datetime as dt

import pytest

from quarry.operators import chunking, graph, records
from quarry.sources import history
from pyspark.sql import functions as F

LOG = "a1\0a\0Ann\0ann@x\x000\0Start\0\0 (HEAD -> main, tag: v1, tag: v1.0)\n\n3\t1\tx.go\n-\t-\tpic.png\n\nb2\0b\0Bo\0bo@x\x0060\0Merge it\0p q\0\n\n"
DIFF = """diff --git a/x.py b/y.py
similarity index 90%
rename from x.py
rename to y.py
@@ -1 +1,2 @@ def old(a):
-def gone(x):
+def new(x):
+    pass
diff --git a/bin b/bin
new file mode 100644
Binary files differ
"""


def test_commits(spark):
    rows = history.commits(spark.createDataFrame([("r", LOG), ("s", ""), ("t", None)], "repo string, log string")).orderBy("ordinal").collect()
    a, b = rows
    assert (a.repo, a.hash, a.author_email, a.files_changed, a.insertions, a.deletions, a.tags, a.branch, a.is_tagged, a.is_merge) == ("r", "a1", "ann@x", 2, 3, 1, ["v1", "v1.0"], "main", True, False)
    assert (b.hash, b.parent_hash, b.is_merge, b.files_changed, b.tags, b.branch) == ("b2", "p", True, 0, [], "")
    assert b.date.replace(tzinfo=None) == dt.datetime.fromtimestamp(60)


def test_changes_and_functions(spark):
    df = history.changes(spark.createDataFrame([("0123456789", DIFF), ("x", None)], "commit_hash string, diff string"))
    got = {r.file_path: r for r in df.collect()}
    y = got["y.py"]
    assert (y.id, y.change_type, y.old_path, y.additions, y.deletions) == ("01234567:y.py", "R", "x.py", 2, 1)
    assert [tuple(h) for h in y.hunks] == [(1, 1, 1, 2, "def old(a):")]
    assert (got["bin"].change_type, got["bin"].hunks, got["bin"].additions) == ("A", [], 0)
    names = df.select("file_path", history.affected_functions(F.col("file_path"), F.col("diff_content"), F.col("hunks.context")).alias("f")).collect()
    assert dict(map(tuple, names)) == {"y.py": ["gone", "new", "old"], "bin": []}


def test_blame(spark):
    sha, other = "a" * 40, "b" * 40
    text = f"{sha} 1 1 2\nauthor Ann\nauthor-mail <ann@x>\nauthor-time 5\nsummary one\n\tfirst\n{sha} 2 2\n\tsecond\n{other} 1 3 1\nauthor Bo\nauthor-mail <bo@x>\nauthor-time 9\nsummary two\n\tthird\n"
    lines = history.blamed_lines(spark.createDataFrame([("f", text), ("g", None)], "path string, blame string"))
    assert sorted((r.line, r.author, r.email, r.summary) for r in lines.collect()) == [(1, "Ann", "ann@x", "one"), (2, "Ann", "ann@x", "one"), (3, "Bo", "bo@x", "two")]
    assert {(r.author, r.lines) for r in history.blame_summary(lines).collect()} == {("Ann", 2), ("Bo", 1)}


def test_chunks(spark):
    body = "\n".join(f"    x = {i}  # some words to fill the line" for i in range(6))
    text = f"def one():\n{body}\ndef two():\n{body}\n\nshort = 1\n"
    rows = chunking.chunks(spark.createDataFrame([("a.py", text, "python"), ("b.py", "x", None), ("c", "", "go"), ("d", None, None)], "path string, content string, language string")).collect()
    assert [(r.path, r.chunk_type, r.start_line, r.end_line) for r in rows] == [("a.py", "block", 1, 7), ("a.py", "block", 8, 14), ("b.py", "file", 1, 1)]
    assert rows[0].content == f"def one():\n{body}"


@pytest.mark.parametrize("n", [1, 30, 1000])
def test_cut_keeps_order_and_bounds(n):
    text = "\n".join("word " * (k % 9) for k in range(300))
    spans = [(a, b) for _, a, b in chunking.cut(text, "python", n, 1)]
    assert all(a <= b for a, b in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))


def test_symbols_and_imports(spark):
    files = [
        ("a.go", 'package a\nimport "fmt"\ntype T struct {\nfunc (t *T) Run() {\nfunc main() {\ntype I interface {\n', "go"),
        ("b.py", "from os import path\nimport re\nclass A:\n    def m(self):\ndef f():\n", "python"),
        ("c.ts", "import x from './y'\nexport class Q {}\nconst g = (a) => a\n", "typescript"),
        ("d.rs", "use std::io;\npub fn go() {}\ntrait Z {}\n", "rust"),
        ("e", None, "go"),
        ("f", "class X", None),
    ]
    df = spark.createDataFrame(files, "path string, content string, language string")
    assert {(r.id, r.kind) for r in chunking.symbols(df).collect()} == {
        ("a.go:T:3", "type"), ("a.go:Run:4", "method"), ("a.go:main:5", "function"), ("a.go:I:6", "interface"), ("b.py:A:3", "type"), ("b.py:m:4", "method"), ("b.py:f:5", "function"),
        ("c.ts:Q:2", "type"), ("c.ts:g:3", "function"), ("d.rs:go:2", "function"), ("d.rs:Z:3", "interface"),
    }
    assert {(r.path, r.target) for r in chunking.imports(df).collect()} == {("a.go", "fmt"), ("b.py", "os"), ("b.py", "re"), ("c.ts", "./y"), ("d.rs", "std::io")}


def test_lcs(spark):
    assert chunking.lcs_score("abc", "abc") == pytest.approx(0.91)
    assert chunking.lcs_score("ac", "abc") == pytest.approx(0.6 + 0.2)
    assert chunking.lcs_score("", "a") == chunking.lcs_score("q", "a") == 0.0
    got = spark.createDataFrame([("abc",), (None,)], "n string").select(chunking.lcs_scores("ac")("n")).collect()
    assert [r[0] for r in got] == pytest.approx([0.8, 0.0])


def test_records(spark):
    labels = spark.createDataFrame([(1, ["P0"]), (2, ["high"]), (3, []), (4, None)], "id int, l array<string>")
    assert [r[0] for r in labels.orderBy("id").select(records.severity(F.col("l"))).collect()] == ["critical", "major", "minor", "minor"]


def test_resolve_prefers_id_then_folder(spark):
    refs = spark.createDataFrame([(1, "d:f:1", "x"), (2, "f", "d"), (3, "f", "zz"), (4, "none", "d")], "ref_id int, target string, dir string")
    known = spark.createDataFrame([("d:f:1", "f", "d"), ("c:f:9", "f", "c")], "symbol_id string, name string, dir string")
    assert {tuple(r) for r in graph.resolve(refs, known).collect()} == {(1, "d:f:1"), (2, "d:f:1"), (3, "c:f:9")}
