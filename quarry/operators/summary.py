"""What a source file holds: classes of lines, functions, types, imports, exports, and roll-ups of them.

Files are (path, content, language). Lines are classed by a fold inside column
expressions; functions and types, whose ends depend on braces or indentation, are
found a file at a time in Python.

Defined cases: null and empty contents have no line; a last line without text
doesn't count; a function or type without an end goes to the last line; unknown
languages have no functions, types and imports, and comments after // or #.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.code import decision_points, rating

#: Languages of one comment syntax: what begins a comment line, and the marks around a block.
SLASHES = ("go", "java", "javascript", "typescript", "c", "cpp", "rust", "swift", "kotlin", "scala", "dart")
QUOTES = ("python", "ruby")
MARKUP = ("html", "xml")
#: Lines that begin a function (name, then parameters) or a type (name, then kind), by language.
FUNCTIONS = {
    "go": r"^func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(([^)]*)\)",
    "python": r"^def\s+(\w+)\s*\(([^)]*)\)",
    "javascript": r"(?:function\s+(\w+)|(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function|\([^)]*\)\s*=>))\s*\(?([^)]*)\)?",
    "java": r"(?:public|private|protected)?\s*(?:static)?\s*\w+\s+(\w+)\s*\(([^)]*)\)",
    "rust": r"^(?:pub\s+)?fn\s+(\w+)\s*\(([^)]*)\)",
}
TYPES = {
    "go": r"^type\s+(\w+)\s+(struct|interface)\s*\{?",
    "python": r"^class\s+(\w+)(?:\([^)]*\))?:",
    "javascript": r"^(?:export\s+)?(?:class|interface)\s+(\w+)",
    "java": r"^(?:public\s+)?(?:class|interface|enum)\s+(\w+)",
    "rust": r"^(?:pub\s+)?(?:struct|enum|trait)\s+(\w+)",
}
KINDS = ("class", "interface", "enum", "struct", "trait")
#: What adds to a function's estimated complexity.
BRANCHES = re.compile(r"\bif\b|\belif\b|\bfor\b|\bwhile\b|\bcase\b|\bcatch\b|\bexcept\b|&&|\|\||\?")
ELSE_IF = re.compile(r"\belse if\b")
#: Advice by measure.
ADVICE = (
    "Consider breaking this function into smaller functions",
    "Deep nesting detected - consider early returns or extracting logic",
    "Function is long - consider splitting into smaller units",
    "Many return statements - consider consolidating exit points",
    "Consider adding more comments for complex logic",
)
SAME_AS = {"typescript": "javascript", "tsx": "javascript", "jsx": "javascript"}
DEFINED = "path string, what string, name string, kind string, start_line long, end_line long, line_count long, signature string, exported boolean, parameters long, fields array<string>, complexity long"


def lines_of(text: Column) -> Column:
    """A text's lines, without the empty one after a last line break."""
    ls = F.split(F.coalesce(text, F.lit("")), "\n", -1)
    return F.when(F.element_at(ls, -1) == "", F.slice(ls, F.lit(1), F.size(ls) - 1)).otherwise(ls)


def _comment(line: Column, language: Column, inside: Column) -> tuple[Column, Column]:
    """(whether a trimmed line is a comment, whether a block goes on after it)."""
    triple = r"^(?:\"\"\"|''')"
    closed_again = F.regexp_replace(line, triple, "").rlike(r"\"\"\"|'''")
    slashes, quotes, markup = (F.coalesce(language.isin(*x), F.lit(False)) for x in (SLASHES, QUOTES, MARKUP))
    opens = (slashes & line.startswith("/*")) | (quotes & line.rlike(triple)) | (markup & line.startswith("<!--"))
    goes_on_inside = F.when(slashes, ~line.contains("*/")).when(quotes, ~line.rlike(triple)).when(markup, ~line.contains("-->")).otherwise(False)
    goes_on_open = F.when(slashes, ~line.contains("*/")).when(quotes, ~closed_again).when(markup, ~line.contains("-->")).otherwise(False)
    alone = F.when(slashes, line.startswith("//")).when(quotes, line.startswith("#")).when(markup, False).otherwise(line.startswith("//") | line.startswith("#"))
    return inside | opens | alone, F.when(inside, goes_on_inside).when(opens, goes_on_open).otherwise(False)


def stripped(lines: Column) -> Column:
    """Lines without the blanks around them: made once, as a fold evaluates an expression wherever it stands in its step."""
    return F.transform(lines, lambda raw: F.trim(F.regexp_replace(raw, r"^\s+|\s+$", "")))


def line_classes(lines: Column, language: Column) -> Column:
    """struct of blank, comment and code lines of stripped lines; one pass."""
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("blank", "comment", "code")), F.lit(False).alias("inside"))

    def step(acc: Column, line: Column) -> Column:
        comment, goes_on = _comment(line, language, acc["inside"])
        kind = F.when(line == "", 0).when(comment, 1).otherwise(2)
        counts = [(acc[n] + (kind == k).cast("long")).alias(n) for k, n in enumerate(("blank", "comment", "code"))]
        return F.struct(*counts, F.when(line == "", acc["inside"]).otherwise(goes_on).alias("inside"))

    return F.aggregate(lines, zero, step)


def line_measures(lines: Column, language: Column) -> Column:
    """struct of total, blank, comment and code lines, and of the code lines decisions, deepest nesting and returns, of stripped lines; one pass."""
    zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("blank", "comment", "code", "decisions", "depth", "max_nesting", "returns")), F.lit(False).alias("inside"))

    def step(acc: Column, line: Column) -> Column:
        blank = line == ""
        comment, goes_on = _comment(line, language, acc["inside"])
        code = ~blank & ~comment
        more = lambda hit, n=1: F.when(hit, F.lit(n) if isinstance(n, int) else n).otherwise(0).cast("long")
        points = decision_points(line) + F.when((language == "go") & F.lower(line).contains("select"), 1).otherwise(0) + F.when((language == "rust") & line.contains("=>"), 1).otherwise(0)
        depth = F.when(code & (language != "python"), acc["depth"] + F.regexp_count(line, F.lit(r"\{")) - F.regexp_count(line, F.lit(r"\}"))).otherwise(acc["depth"]).cast("long")
        return F.struct(
            (acc["blank"] + more(blank)).alias("blank"), (acc["comment"] + more(~blank & comment)).alias("comment"), (acc["code"] + more(code)).alias("code"), (acc["decisions"] + more(code, points)).alias("decisions"),
            depth.alias("depth"), F.greatest(acc["max_nesting"], depth).alias("max_nesting"), (acc["returns"] + more(code & line.contains("return "))).alias("returns"), F.when(blank, acc["inside"]).otherwise(goes_on).alias("inside"),
        )

    return F.aggregate(lines, zero, step)


def measures(files: DataFrame, first: Column | None = None, last: Column | None = None) -> DataFrame:
    """(path, total_lines, blank_lines, comment_lines, code_lines, cyclomatic, max_nesting, returns, cognitive, rating, suggestions) of files, or of their lines first to last."""
    ls = lines_of(F.col("content"))
    if first is not None:
        lo = F.greatest(F.lit(1), first)
        ls = F.slice(ls, lo, F.greatest(F.lit(0), F.least(F.size(ls), last) - lo + 1))
    rows = files.select("path", stripped(ls).alias("__ls"), F.coalesce("language", F.lit("")).alias("__l"))
    # two folds: who asks for classes alone pays for no measures
    of = F.col("__ls"), F.col("__l")
    rows = rows.select("path", F.size("__ls").cast("long").alias("total_lines"), line_classes(*of).alias("c"), line_measures(*of).alias("m"))
    rows = rows.select("path", "total_lines", F.col("c.blank").alias("blank_lines"), F.col("c.comment").alias("comment_lines"), F.col("c.code").alias("code_lines"), (F.col("m.decisions") + 1).alias("cyclomatic"), F.col("m.max_nesting").alias("max_nesting"), F.col("m.returns").alias("returns"))
    rows = rows.withColumn("cognitive", F.col("cyclomatic") + 2 * F.col("max_nesting")).withColumn("rating", rating(F.col("cyclomatic")))
    hits = (F.col("cyclomatic") > 10, F.col("max_nesting") > 4, F.col("code_lines") > 50, F.col("returns") > 5, (F.col("code_lines") > 20) & (10 * F.col("comment_lines") < F.col("code_lines")))
    return rows.withColumn("suggestions", F.array_compact(F.array(*(F.when(h, F.lit(a)) for h, a in zip(hits, ADVICE)))))


def exported_by_name(name: str, language: str) -> bool:
    """Whether a name is seen outside its file, by the name alone."""
    if language == "go":
        return name[:1].isascii() and name[:1].isupper()
    return bool(name) and not (SAME_AS.get(language, language) in ("python", "javascript") and name.startswith("_"))


def _ends(lines: list[str], heads: list[int], language: str, by_indent: bool) -> Iterator[tuple[int, int]]:
    """(first, last) line numbers from 0 of what begins at the heads; what begins inside another is part of it."""
    free = 0
    for at in heads:
        if at < free:
            continue
        end = len(lines) - 1
        if by_indent:
            end = next((k - 1 for k in range(at + 1, len(lines)) if lines[k].strip() and lines[k][0] not in " \t"), end)
        else:
            depth = lines[at].count("{") - lines[at].count("}")
            for k in range(at + 1, len(lines)):
                depth += lines[k].count("{") - lines[k].count("}")
                if depth <= 0:
                    end = k
                    break
        free = end + 1
        yield at, end


def functions_in(lines: list[str], language: str) -> Iterator[dict]:
    """Functions with their lines, first line, number of parameters and estimated complexity."""
    pattern = FUNCTIONS.get(SAME_AS.get(language, language))
    if pattern is None:
        return
    found = {k: m for k, x in enumerate(lines) if (m := re.search(pattern, x.strip())) and any(m.groups())}
    for lo, hi in _ends(lines, list(found), language, language == "python"):
        name, *rest = [g for g in found[lo].groups() if g]
        body = "\n".join(lines[lo : hi + 1])
        yield {"what": "function", "name": name, "kind": "function", "start_line": lo + 1, "end_line": hi + 1, "line_count": hi - lo + 1, "signature": lines[lo].strip(), "exported": exported_by_name(name, language), "parameters": len(rest[-1].split(",")) if rest else 0, "complexity": 1 + len(BRANCHES.findall(body)) + len(ELSE_IF.findall(body))}


def types_in(lines: list[str], language: str) -> Iterator[dict]:
    """Types with their lines, kind and the first words of the lines inside, which are fields or methods."""
    pattern = TYPES.get(SAME_AS.get(language, language))
    if pattern is None:
        return
    found = {k: m for k, x in enumerate(lines) if (m := re.match(pattern, x.strip()))}
    free = 0
    for lo, m in found.items():
        if lo < free:
            continue
        one_line = "}" in lines[lo] and lines[lo].count("{") <= lines[lo].count("}")
        hi = lo if one_line else next(_ends(lines, [lo], language, False))[1]
        free = hi + 1
        inner = [x.strip() for x in lines[lo + 1 : hi + 1]]
        fields = [x.split()[0].removesuffix(":") for x in inner if " " in x and not x.startswith(("//", "func"))]
        kind = m.group(2) if m.re.groups > 1 else next((k for k in KINDS if k in lines[lo]), "type")
        yield {"what": "type", "name": m.group(1), "kind": kind, "start_line": lo + 1, "end_line": hi + 1, "line_count": hi - lo + 1, "exported": exported_by_name(m.group(1), language), "fields": [f for f in fields if f not in ("{", "}")]}


def definitions(files: DataFrame) -> DataFrame:
    """Functions and types of every file; see DEFINED."""
    names = [f.split()[0] for f in DEFINED.split(", ")]
    kinds = {"exported": pa.bool_(), "fields": pa.list_(pa.string())} | {n: pa.int64() for n in ("start_line", "end_line", "line_count", "parameters", "complexity")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text, language in zip(*([x.as_py() for x in b.column(k)] for k in range(3))):
                lines = (text or "").split("\n")
                lines = lines[:-1] if lines[-1] == "" else lines
                rows = [{"path": path} | d for of in (functions_in, types_in) for d in of(lines, language or "")]
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names)

    return files.select("path", "content", "language").mapInArrow(run, DEFINED)


def exports(defined: DataFrame) -> DataFrame:
    """(path, name, kind, line) of what is seen outside its file, in order of lines."""
    return defined.filter("exported").select("path", "name", "kind", F.col("start_line").alias("line")).orderBy("path", "line", "name")


def imports(files: DataFrame) -> DataFrame:
    """(path, line, target, alias, is_local) of the lines that import something."""
    from quarry.operators.chunking import imports as found

    rows = found(files).join(files.select("path", "language", F.split("content", "\n").alias("__ls")), "path")
    text, lang, to = F.element_at("__ls", F.col("line").cast("int")), F.col("language"), F.col("target")
    alias = F.when(lang == "go", F.regexp_extract(text, r"^\s*(?:import\s+)?(\w+)\s+\"", 1)).otherwise("")
    local = F.when(lang == "go", ~to.contains(".") | to.startswith("./") | to.startswith("../")).when(lang == "python", to.startswith(".")).when(lang.isin("javascript", "typescript"), to.startswith(".") | to.startswith("/"))
    local = local.when(lang == "rust", to.rlike("^(?:crate|super|self)::")).otherwise(False)
    return rows.select("path", "line", "target", F.when(alias == "import", "").otherwise(alias).alias("alias"), local.alias("is_local"))


def complexity_rollup(defined: DataFrame) -> DataFrame:
    """(path, functions, avg_cyclomatic, max_cyclomatic) over a file's functions."""
    rows = defined.filter("what = 'function'").groupBy("path")
    return rows.agg(F.count("*").alias("functions"), F.avg("complexity").alias("avg_cyclomatic"), F.max("complexity").alias("max_cyclomatic"))


def file_summary(files: DataFrame) -> DataFrame:
    """A row a file: its measures, and of its definitions numbers, average and greatest length."""
    f = F.col("what") == "function"
    sums = definitions(files).groupBy("path").agg(F.count_if(f).alias("functions"), F.count_if(~f).alias("types"), F.count_if("exported").alias("exports"), F.avg(F.when(f, F.col("line_count"))).alias("avg_function_lines"), F.max(F.when(f, F.col("line_count"))).alias("longest_function"))
    rows = measures(files).join(sums, "path", "left")
    return rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("functions", "types", "exports")})


def quick_summary(symbols: DataFrame) -> DataFrame:
    """(path, functions, types, variables, longest) from indexed symbols alone."""
    k = F.col("kind")
    return symbols.groupBy("path").agg(F.count_if(k.isin("function", "method")).alias("functions"), F.count_if(k.isin("type", "interface")).alias("types"), F.count_if(k.isin("variable", "constant")).alias("variables"), F.max("line_count").alias("longest"))


# ---- texts for people --------------------------------------------------------------------


def change_text(functions: Column, additions: Column, deletions: Column) -> Column:
    """One line about a change: the functions it touches and the lines it adds and takes away."""
    names = F.when(F.size(functions) > 0, F.concat(F.lit("Changed: "), F.array_join(functions, ", "), F.lit(" "))).otherwise("")
    return F.concat(names, F.lit("(+"), additions.cast("string"), F.lit("/-"), deletions.cast("string"), F.lit(")"))


def bytes_text(n: Column) -> Column:
    """A size with one decimal in B, KB, MB or GB."""
    part = lambda k, unit: F.concat(F.format_string("%.1f", n / float(1 << k)), F.lit(f" {unit}"))
    return F.when(n >= 1 << 30, part(30, "GB")).when(n >= 1 << 20, part(20, "MB")).when(n >= 1 << 10, part(10, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def decision_record(decisions: DataFrame) -> DataFrame:
    """(id, markdown): each decision as a record with its status, context, decision and consequences."""
    part = lambda title, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"\n## {title}\n\n"), F.col(c), F.lit("\n")))
    text = F.concat_ws("", F.concat(F.lit("# "), F.col("title"), F.lit("\n")), part("Status", "status"), part("Context", "context"), part("Decision", "decision"), part("Consequences", "consequences"))
    return decisions.select("id", text.alias("markdown"))
