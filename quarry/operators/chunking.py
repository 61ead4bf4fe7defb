"""Chunks, symbols and imports of source files (path, content, language)."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

CHARS_PER_TOKEN, LEAST_CHARS = 4, 100
CHUNKS = "path string, language string, content string, chunk_type string, start_line long, end_line long, hash string"
#: What a line that defines something begins with, by language.
STARTS = {
    "go": ("func ", "type "),
    "python": ("def ", "class ", "async def "),
    "javascript": ("function ", "class ", "export function ", "export class ", "export default function "),
    "rust": ("fn ", "pub fn ", "impl ", "struct ", "pub struct ", "enum ", "pub enum "),
}
SAME_AS = {"typescript": "javascript", "jsx": "javascript", "tsx": "javascript", "cpp": "c", "h": "c"}
#: Lines that define a symbol: language, kind and pattern; the first that matches counts.
SYMBOLS = [
    ("go", "function", r"^func\s+(\w+)"),
    ("go", "method", r"^func\s+\([^)]*\)\s*(\w+)"),
    ("go", "interface", r"^type\s+(\w+)(?:\[[^\]]*\])?\s+interface\b"),
    ("go", "type", r"^type\s+(\w+)"),
    ("go", "constant", r"^const\s+(\w+)"),
    ("go", "variable", r"^var\s+(\w+)"),
    ("python", "method", r"^\s+(?:async\s+)?def\s+(\w+)\s*\(\s*(?:self|cls)\b"),
    ("python", "function", r"^\s*(?:async\s+)?def\s+(\w+)"),
    ("python", "type", r"^\s*class\s+(\w+)"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)"),
    ("javascript", "type", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)"),
    ("javascript", "interface", r"^\s*(?:export\s+)?interface\s+(\w+)"),
    ("javascript", "function", r"^\s*(?:export\s+)?(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>|\w+\s*=>)"),
    ("rust", "function", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?(?:unsafe\s+)?fn\s+(\w+)"),
    ("rust", "type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:struct|enum)\s+(\w+)"),
    ("rust", "interface", r"^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)"),
    ("rust", "constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(\w+)"),
    ("rust", "variable", r"^\s*(?:pub(?:\([^)]*\))?\s+)?static\s+(?:mut\s+)?(\w+)"),
    ("java", "interface", r"^\s*(?:(?:public|private|protected|static|abstract)\s+)*interface\s+(\w+)"),
    ("java", "type", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*(?:class|enum|record)\s+(\w+)"),
    ("java", "method", r"^\s*(?:(?:public|private|protected|static|abstract|final|synchronized)\s+)+[\w<>\[\], ]+\s+(\w+)\s*\("),
    ("c", "type", r"^\s*(?:typedef\s+)?(?:struct|enum|union|class)\s+(\w+)\s*\{?\s*$"),
    ("c", "function", r"^(?:\w++[\s*]++)+?(\w++)\s*\([^;]*$"),
    ("ruby", "type", r"^\s*(?:class|module)\s+(\w+)"),
    ("ruby", "method", r"^\s*def\s+self\.(\w+[?!]?)"),
    ("ruby", "function", r"^\s*def\s+(\w+[?!]?)"),
    ("php", "function", r"^\s*(?:(?:public|private|protected|static|abstract|final)\s+)*function\s+&?(\w+)"),
    ("php", "type", r"^\s*(?:abstract\s+|final\s+)?(?:class|trait)\s+(\w+)"),
    ("php", "interface", r"^\s*interface\s+(\w+)"),
]
#: What a line imports, by language.
IMPORTS = {
    "go": r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([^\"]+)\"\s*$",
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))",
    "javascript": r"(?:^\s*import\s[^'\"]*|^\s*import\s*|\brequire\(\s*|^\s*export\s.*\bfrom\s*)['\"]([^'\"]+)['\"]",
    "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
    "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)",
}


def _family(language: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SAME_AS.items() for x in kv))
    return F.coalesce(F.try_element_at(table, language), language)


def defines(line: str, language: str) -> bool:
    """Whether a line looks as if something is defined there."""
    s, kind = line.strip(), SAME_AS.get(language, language)
    if kind in ("java", "c"):
        branch = s.startswith(("if", "for", "while"))
        if kind == "c":
            return "(" in s and s.endswith("{") and not branch
        return "class " in s or "interface " in s or ("(" in s and "{" in s and not branch)
    if kind == "javascript" and s.startswith("const ") and ("= function" in s or "=>" in s):
        return True
    return s.startswith(STARTS.get(kind, ("\0",)))


def cut(text: str, language: str, tokens: int, least: int = LEAST_CHARS) -> Iterator[tuple[str, int, int]]:
    """(content, first line, last line) of a text's chunks; segments under `least` bytes are passed over."""
    lines = text.split("\n")
    first, size = 0, 0
    for at, line in enumerate(lines):
        n = len(line.encode())
        if size and (size + n > tokens * CHARS_PER_TOKEN or (size > least and (not line.strip() or defines(line, language)))):
            if size >= least:
                yield "\n".join(lines[first:at]), first + 1, at
            first, size = at, 0
        size += n + 1
    if size >= least:
        yield "\n".join(lines[first:]), first + 1, len(lines)


def chunks(files: DataFrame, tokens: int = 1800) -> DataFrame:
    """Blocks of lines of every file, or the whole of one that has no block; null and empty files have none. See CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(7)]
            for path, text, language in zip(*([x.as_py() for x in b.column(k)] for k in range(3))):
                found = [(*c, "block") for c in cut(text or "", language or "", tokens)]
                for content, lo, hi, kind in found or ([(text, 1, text.count("\n") + 1, "file")] if text else []):
                    for c, v in zip(cols, (path, language, content, kind, lo, hi, hashlib.sha256(content.encode()).hexdigest())):
                        c.append(v)
            names = [f.split()[0] for f in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if n.endswith("_line") else pa.string()) for n, c in zip(names, cols)], names)

    return files.select("path", "content", "language").mapInArrow(run, CHUNKS)


def _lines(files: DataFrame) -> DataFrame:
    rows = files.select("path", _family(F.col("language")).alias("language"), F.posexplode(F.split("content", "\r?\n", -1)).alias("line", "text"))
    return rows.withColumn("line", (F.col("line") + 1).cast("long"))


def symbols(files: DataFrame) -> DataFrame:
    """(id, name, kind, path, line) of the lines that define something, id being path:name:line."""
    found = F.array().cast("array<struct<kind:string,name:string>>")
    for language in {x[0]: 0 for x in SYMBOLS}:
        named = F.array(*(F.struct(F.lit(kind).alias("kind"), F.regexp_extract("text", p, 1).alias("name")) for of, kind, p in SYMBOLS if of == language))
        found = F.when(F.col("language") == language, F.slice(F.filter(named, lambda x: x["name"] != ""), 1, 1)).otherwise(found)
    rows = _lines(files).select("path", "line", F.explode(found).alias("s"))
    return rows.select(F.concat_ws(":", "path", "s.name", "line").alias("id"), "s.name", "s.kind", "path", "line")


def imports(files: DataFrame) -> DataFrame:
    """(path, line, target) of the lines that import something."""
    found = F.array().cast("array<string>")
    for language, pattern in IMPORTS.items():
        groups = range(1, re.compile(pattern).groups + 1)
        found = F.when(F.col("language") == language, F.array_remove(F.array(*(F.regexp_extract("text", pattern, k) for k in groups)), "")).otherwise(found)
    return _lines(files).select("path", "line", F.explode(F.slice(found, 1, 1)).alias("target"))


#: What begins and ends an embedded script.
SCRIPT = r"(?is)<script[^>]*>(.*?)</script>"


def embedded_scripts(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, part, body, is_module, first_line) of the scripts inside markup, numbered from 0; null texts have none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    whole, bodies = F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(0)), F.regexp_extract_all(text, F.lit(SCRIPT), F.lit(1))
    lines = F.transform(F.split(text, SCRIPT, -1), lambda x: F.regexp_count(x, F.lit("\n")))
    own = F.transform(whole, lambda x: F.regexp_count(x, F.lit("\n")))
    before = lambda k: F.aggregate(F.slice(lines, F.lit(1), k + 1), F.lit(0), lambda a, x: a + x) + F.aggregate(F.slice(own, F.lit(1), k), F.lit(0), lambda a, x: a + x)
    parts = F.transform(bodies, lambda b, k: F.struct(k.cast("long").alias("part"), b.alias("body"), F.lower(F.regexp_extract(F.element_at(whole, k + 1), "^[^>]*>", 0)).rlike(r"type\s*=\s*[\"']?module").alias("is_module"), (before(k) + 1).cast("long").alias("first_line")))
    return pages.select(F.col(id_col), F.explode(parts).alias("s")).select(id_col, "s.*")


def lcs_score(query: str, target: str) -> float:
    """Likeness by the longest common subsequence of bytes: its share of both, and a little for runs."""
    a, b = query.encode(), target.encode()
    if not a or not b:
        return 0.0
    best = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b, 1):
            row.append(best[-1][j - 1] + 1 if x == y else max(best[-1][j], row[-1]))
        best.append(row)
    n, i, j, places = best[-1][-1], len(a), len(b), []
    if not n:
        return 0.0
    while i and j:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            places.append(j)
        elif best[i - 1][j] > best[i][j - 1]:
            i -= 1
        else:
            j -= 1
    runs = sum(x == y + 1 for x, y in zip(places, places[1:]))
    return min(1.0, 0.6 * n / len(a) + 0.3 * n / len(b) + 0.005 * runs)


def lcs_scores(query: str) -> Callable[[Column], Column]:
    """lcs_score with a query as a vectorised column function; null names score 0."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def score(names):
        return names.fillna("").map(lambda x: lcs_score(query, x)).astype("float64")

    return score
