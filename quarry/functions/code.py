"""Column functions over lines of code and names."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

DECISIONS = r"\b(?:if|elif|for|while|case|catch)\b"


def glob_regex(glob: str) -> str:
    """Regular expression of a path pattern: ** any folders, * within a folder, ? one character."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return f"^{out}$"


def _name_glob(glob: str) -> str:
    """A pattern without **: * and ? stay within a folder, [...] is a set."""
    out, i = "", 0
    while i < len(glob):
        end = glob.find("]", i + 2) if glob[i] == "[" else -1
        if end > 0:
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + f"[{inner}]", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(glob[i], re.escape(glob[i])), i + 1
    return out


def matches_glob(path: Column, glob: str, dialect: str = "strict") -> Column:
    """Whether a path matches a pattern; dialects differ in what ** means (Q13).

    strict: ** any folders, * within one. index: one ** whose rest names the file or
    all that follows the prefix; a rest without * may be anywhere. tree: the rest
    names any folder or the file, and **/x/** finds /x or x/ anywhere. history: the
    pattern without its stars, anywhere. people: * is any text, case is ignored.
    """
    if dialect == "strict":
        return path.rlike(glob_regex(glob))
    if dialect == "history":
        return path.contains(glob.replace("*", ""))
    if dialect == "people":
        return path.ilike(glob.replace("*", "%"))
    whole, name = _name_glob(glob), rf"(?:.*/)?{_name_glob(glob)}"
    parts = glob.split("**")
    if dialect == "tree" and len(parts) == 3 and not parts[0] and not parts[2]:
        middle = parts[1].strip("/")
        return path.contains(middle + "/") | path.contains("/" + middle)
    if len(parts) != 2:
        return path.rlike(f"^(?:{whole}|{name})$") if "/" not in glob else path.rlike(f"^{whole}$")
    prefix, rest = parts[0].removesuffix("/"), parts[1].removeprefix("/")
    under = path.startswith(prefix) if prefix else F.lit(True)
    if not rest:
        return under
    if dialect == "tree":
        return under & path.rlike(f"(?:^|/){_name_glob(rest)}(?:/|$)")
    if "*" not in rest:
        return under & path.contains(rest)
    after = re.escape(prefix) + "/?" if prefix else ""
    return under & path.rlike(f"^(?:(?:.*/)?{_name_glob(rest)}|{after}{_name_glob(rest)})$")


def decision_points(line: Column) -> Column:
    low = F.lower(line)
    return F.regexp_count(low, F.lit(DECISIONS)) + F.regexp_count(low, F.lit(r"\belse if\b")) + F.regexp_count(low, F.lit(r"&&|\|\||\?"))


def rating(cyclomatic: Column) -> Column:
    return F.when(cyclomatic <= 5, "low").when(cyclomatic <= 10, "medium").when(cyclomatic <= 20, "high").otherwise("very_high")


def short_name(symbol_id: Column) -> Column:
    """Name in path:name:line, or the id itself."""
    return F.coalesce(F.try_element_at(F.split(symbol_id, ":"), F.lit(-2)), symbol_id)


def qualified_name(symbol_id: Column) -> Column:
    """folder.name of path:name:line, "" where the path has no folder."""
    folder = F.regexp_extract(symbol_id, r"^(?:.*/)?([^/:]+)/[^/]*:[^:]*:[^:]*$", 1)
    return F.when((folder == "") | (folder == "."), "").otherwise(F.concat(folder, F.lit("."), short_name(symbol_id)))


#: By language, what entry points are called, how tests begin, whether methods may serve an interface.
RULES = {
    "go": (["main", "init", "ServeHTTP"], ["Test", "Benchmark", "Example", "Fuzz"], True),
    "python": (["main", "__main__", "__init__"], ["test_", "Test"], False),
    "javascript": (["main", "default"], ["test", "it", "describe", "Test"], False),
    "typescript": (["main", "default"], ["test", "it", "describe", "Test"], True),
    "java": (["main"], ["test", "Test"], True),
    "rust": (["main"], ["test_", "test"], True),
    "csharp": (["Main"], ["Test"], True),
}
#: How tests begin, and what paths of tests hold or end in, in any language.
TEST_STARTS = ["Test", "test_", "Benchmark", "Example"]
TEST_PATHS = ["_test.", "/test/", "/tests/", "/testing/"]
TEST_ENDS = [".test.js", ".test.ts"]


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | F.coalesce(c, F.lit(False))
    return out


def is_exported(name: Column, language: Column, visibility: Column) -> Column:
    """Whether a symbol can be seen outside: by its capital in Go, its underscore in Python, else by its visibility."""
    capital, seen = name.rlike("^[A-Z]"), F.coalesce(visibility, F.lit(""))
    known = F.when(language == "go", capital).when(language == "python", ~name.startswith("_")).when(language.isin("javascript", "typescript"), seen.isin("public", "")).when(language.isin("java", "rust", "csharp"), seen == "public")
    return F.coalesce(known, (seen == "public") | capital, F.lit(False))


def is_test(name: Column, language: Column, path: Column) -> Column:
    """Whether a symbol belongs to tests, by its name or its path."""
    own = [(language == k) & _any([name.startswith(p) for p in v[1]]) for k, v in RULES.items()]
    low = F.lower(path)
    return _any(own + [name.startswith(p) for p in TEST_STARTS] + [low.contains(p) for p in TEST_PATHS] + [low.endswith(p) for p in TEST_ENDS])


def is_root(name: Column, language: Column, path: Column) -> Column:
    """Whether reachability begins at a symbol: entry points, tests and handlers."""
    low = F.lower(name)
    own = [(language == k) & (low.isin(*(x.lower() for x in v[0]))) for k, v in RULES.items()]
    return _any(own + [name.isin("main", "init", "__init__", "__main__", "ServeHTTP", "ServeHTTPS"), low.startswith("handle"), low.endswith("handler")]) | is_test(name, language, path)


def serves_interfaces(language: Column) -> Column:
    return F.coalesce(language.isin(*(k for k, v in RULES.items() if v[2])), F.lit(False))
