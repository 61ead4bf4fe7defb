"""What source files refer to, and chunks that follow their structure.

There is no syntax tree here: functions and types are the spans that `summary`
finds, references are patterns on lines outside comments and strings. References
made inside a function or method come from it, others from the file (Q27, Q30).

Defined cases: null and empty files have none; languages without function patterns
have file-level references only; a name that is called twice on a line is one
reference; a chunk longer than the limit is cut and says so.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quarry.operators import summary
from quarry.operators.chunking import IMPORTS, SAME_AS

#: Words that stand before a bracket without being called.
KEYWORDS = frozenset("if for while switch return func function def class catch elif else try with and or not in is lambda match fn let const var new typeof sizeof assert print del raise yield await async public private protected static void using lock foreach when do end then import".split())
CALL = re.compile(r"(?<![\w.])((?:[A-Za-z_]\w*\.)*[A-Za-z_]\w*)\s*\(")
#: A type made or named: `new T`, `T{`, `: T`, `extends T`, `implements T`, `*T`.
TYPE_USE = re.compile(r"(?:\bnew\s+|\bextends\s+|\bimplements\s+|:\s*|[*&]|\[\])([A-Z]\w*)\b|\b([A-Z]\w*)\s*\{")
QUOTED = re.compile(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`[^`]*`")
REFS = "id string, from_symbol string, to_symbol string, kind string, file_path string, line long, is_external boolean"
PARTS = "id string, file_path string, name string, chunk_type string, start_line long, end_line long, content string"
CUT = " (truncated)"


def _bare(lines: list[str], language: str) -> Iterator[str]:
    """Lines without what lies in comments and strings."""
    inside = False
    for x in lines:
        if inside:
            end = x.find("*/")
            x, inside = (x[end + 2 :], False) if end >= 0 else ("", True)
        x = QUOTED.sub('""', x)
        while (at := x.find("/*")) >= 0 and language != "python":
            end = x.find("*/", at + 2)
            x, inside = (x[:at] + x[end + 2 :], False) if end >= 0 else (x[:at], True)
        yield x.split("#" if language in ("python", "ruby") else "//")[0]


def references_in(path: str, text: str, language: str) -> Iterator[tuple]:
    """Rows of REFS for one file."""
    lines = text.split("\n")
    family = SAME_AS.get(language, language)
    inner = list(summary.functions_in(lines, language))
    outer = list(summary.types_in(lines, language))
    defined = {d["name"] for d in inner + outer}
    heads = {d["start_line"] for d in inner + outer}

    def owner(n: int) -> str:
        d = next((d for d in inner if d["start_line"] <= n <= d["end_line"]), None)
        return f"{path}:{d['name']}:{d['start_line']}" if d else path

    seen = set()
    for n, (whole, x) in enumerate(zip(lines, _bare(lines, language)), 1):
        found = []
        if family in IMPORTS and (m := re.search(IMPORTS[family], whole)) and (family != "go" or "import" in whole or re.fullmatch(r"\s*(?:[\w.]+\s+)?\"[^\"]+\"\s*", whole)):
            found.append((next(g for g in m.groups() if g), "import"))
        else:
            own = {d["name"] for d in inner if d["start_line"] == n} if n in heads else set()
            if (m := CALL.match(x.strip())) and x.rstrip().endswith("{"):  # a method's head
                own = own | {m.group(1)}
            found += [(m.group(1), "call") for m in CALL.finditer(x) if m.group(1).split(".")[0] not in KEYWORDS and m.group(1) not in own]
            found += [(m.group(1) or m.group(2), "type_use") for m in TYPE_USE.finditer(x) if n not in heads or m.group(1)]
        for to, kind in found:
            row = (owner(n) if kind != "import" else path, to, kind, n)
            if row not in seen:
                seen.add(row)
                yield (f"{path}:{n}:{kind}:{to}", row[0], to, kind, path, n, kind == "import" or to.split(".")[-1] not in defined)


def parts_in(path: str, text: str, language: str, most: int) -> Iterator[tuple]:
    """Rows of PARTS for one file: types and functions, those inside a type only where it is longer than `most` characters; the whole file if it has none."""
    lines = text.split("\n")
    types, functions = list(summary.types_in(lines, language)), list(summary.functions_in(lines, language))
    body = lambda d: "\n".join(lines[d["start_line"] - 1 : d["end_line"]])
    long_types = [d for d in types if len(body(d)) > most]
    shut = [(d["start_line"], d["end_line"]) for d in types if d not in long_types]
    kept = [d for d in types if d not in long_types or not any(d["start_line"] < f["start_line"] <= d["end_line"] for f in functions)]
    kept += [f for f in functions if not any(a <= f["start_line"] <= b for a, b in shut)]
    for d in sorted(kept, key=lambda d: (d["start_line"], d["what"])) or [{"name": path, "what": "file", "start_line": 1, "end_line": len(lines)}] * bool(text):
        whole = body(d)
        content = whole if len(whole) <= most else whole[:most] + CUT
        yield (f"{path}:{d['start_line']}:{hashlib.sha256(content.encode()).hexdigest()[:8]}", path, d["name"], {"type": "class"}.get(d["what"], d["what"]), d["start_line"], d["end_line"], content)


def _rows(files: DataFrame, of, schema: str) -> DataFrame:
    names, kinds = zip(*(f.split() for f in schema.split(", ")))
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text, language in zip(*([x.as_py() for x in b.column(k)] for k in range(3))):
                rows = list(of(path, text or "", language or ""))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], list(names))

    return files.select("path", "content", "language").mapInArrow(run, schema)


def references(files: DataFrame) -> DataFrame:
    """References of files (path, content, language); see REFS. A target that its own file doesn't define is external."""
    return _rows(files, references_in, REFS)


def structural_chunks(files: DataFrame, tokens: int = 1800) -> DataFrame:
    """Chunks of files by their structure; see PARTS. A token is taken as four characters."""
    return _rows(files, lambda path, text, language: parts_in(path, text, language, 4 * tokens), PARTS)
