"""References, structural chunks and the graph that follows from them, on small sources."""

from quarry.operators import chunking, graph, references

GO = 'package shop\n\nimport (\n\t"fmt"\n)\n\ntype Cart struct {\n\tItems int\n}\n\nfunc main() {\n\tc := Cart{}\n\trun(c) // unused(c)\n\tfmt.Println("skip(me)")\n}\n\nfunc run(c Cart) int {\n\treturn used(c)\n}\n\nfunc used(c Cart) int {\n\treturn 1\n}\n\nfunc deadHead() {\n\tdeadTail()\n}\n\nfunc deadTail() {\n}\n\nfunc TestRun() {\n\trun(Cart{})\n}\n'
PY = 'from os import path\n\nclass Shape:\n    def area(self):\n        return helper(2)\n\ndef helper(x):\n    # ignored(x)\n    return abs(x)\n'
TS = 'import { a } from "./lib"\n\nexport class View extends Base {\n  render() {\n    return draw(1)\n  }\n}\n\nfunction draw(n) {\n  return new Canvas(n)\n}\n'


def files(spark):
    return spark.createDataFrame([("shop/a.go", GO, "go"), ("lib/b.py", PY, "python"), ("web/v.ts", TS, "typescript"), ("x", None, None)], "path string, content string, language string")


def test_references(spark):
    got = {(r.from_symbol, r.to_symbol, r.kind, r.is_external) for r in references.references(files(spark)).collect()}
    assert {("shop/a.go:main:11", "run", "call", False), ("shop/a.go:main:11", "fmt.Println", "call", True), ("shop/a.go:run:17", "used", "call", False), ("shop/a.go", "fmt", "import", True), ("shop/a.go:main:11", "Cart", "type_use", False), ("shop/a.go:deadHead:25", "deadTail", "call", False)} <= got
    assert not any(to in ("unused", "skip", "me", "ignored", "if", "main", "return") for _, to, *_ in got)
    assert {("lib/b.py:area:4", "helper", "call", False), ("lib/b.py:helper:7", "abs", "call", True), ("lib/b.py", "os", "import", True)} <= got
    assert {("web/v.ts", "./lib", "import", True), ("web/v.ts:draw:9", "Canvas", "type_use", True), ("web/v.ts", "Base", "type_use", True)} <= got


def test_structural_chunks():
    parts = [(n, k, a, b) for _, _, n, k, a, b, _ in references.parts_in("lib/b.py", PY, "python", 1000)]
    assert ("Shape", "class", 3) in [(n, k, a) for n, k, a, _ in parts] and ("helper", "function", 7, 10) in parts
    small = list(references.parts_in("lib/b.py", PY, "python", 30))
    assert all(len(c) <= 30 + len(references.CUT) for *_, c in small) and {n for _, _, n, *_ in small} >= {"helper"}
    assert [k for _, _, _, k, *_ in references.parts_in("t", "only text", "text", 100)] == ["file"] and not list(references.parts_in("t", "", "go", 9))


def test_dead_code_of_real_sources(spark):
    f = files(spark)
    s = chunking.symbols(f).join(f.select("path", "language"), "path").selectExpr("id", "name", "kind", "path", "language", "'' as visibility")
    dead = {r.name: (r.confidence, r.reason, r.callers, r.dead_callers) for r in graph.dead_code(s, graph.call_graph(s, references.references(f)), 0.0).collect()}
    assert dead["deadHead"] == (0.85, graph.REASONS[1], 0, 0) and dead["deadTail"] == (0.95, graph.REASONS[2], 1, 1)
    assert not dead.keys() & {"main", "run", "used", "TestRun"}
