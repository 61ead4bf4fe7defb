"""Version histories: texts that git prints become rows, with column functions only.

Texts are cut where a commit, a file or a blamed line begins, so nothing is
carried from line to line. Null and empty texts give no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: For `git log` and its numbers of changed lines.
LOG_FORMAT = "--format=%H%x00%h%x00%an%x00%ae%x00%at%x00%s%x00%P%x00%d"
#: How a function or class is named in a hunk's header, first match counts.
CONTEXTS = [r"func\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", r"def\s+(\w+)\s*\(", r"(?:function\s+)?(\w+)\s*(?:=\s*)?\(", r"class\s+(\w+)"]
#: How changed lines of a file with such an extension define something.
DEFINITIONS = {
    "go": [r"[+-]\s*func\s+(?:\([^)]+\)\s+)?(\w+)\s*\("],
    "py": [r"[+-]\s*def\s+(\w+)\s*\(", r"[+-]\s*class\s+(\w+)"],
    "js ts jsx tsx": [r"[+-]\s*(?:function\s+)?(\w+)\s*(?:=\s*)?(?:async\s*)?\(", r"[+-]\s*class\s+(\w+)"],
    "java c cpp h hpp": [r"[+-]\s*(?:public|private|protected|static|\s)+\s+\w+\s+(\w+)\s*\(", r"[+-]\s*class\s+(\w+)"],
    "rs": [r"[+-]\s*(?:pub\s+)?fn\s+(\w+)", r"[+-]\s*(?:pub\s+)?struct\s+(\w+)"],
}
HUNK = r"(?m)^@@ -(\d+),?(\d*) \+(\d+),?(\d*) @@(.*)$"


def _beginning(text: Column, head: str) -> Column:
    """Parts of a text, each from a line that begins with head to the next."""
    return F.filter(F.split(text, f"(?m)^(?={head})", -1), lambda x: x.rlike(f"^(?:{head})"))


def _lines(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?m)^{pattern}"), F.lit(0))


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("long"), F.lit(0).cast("long"))


def commits(logs: DataFrame, text: str = "log") -> DataFrame:
    """One row for each commit of logs in LOG_FORMAT with --numstat; other columns of logs stay."""
    others = [F.col(f"`{c}`") for c in logs.columns if c != text]
    part = logs.select(*others, F.posexplode(_beginning(F.col(text), r"[^\x00\n]*\x00")).alias("ordinal", "__part"))
    part = part.withColumn("__f", F.split(F.regexp_extract("__part", r"^[^\n]*", 0), "\x00", -1)).filter(F.size("__f") >= 6)
    stats = _lines(F.col("__part"), r"(?:\d+|-)\s+(?:\d+|-)\s+\S[^\n]*")
    field = lambda k: F.coalesce(F.get("__f", F.lit(k)), F.lit(""))
    names = F.filter(F.split(F.trim(field(7), F.lit(" ()\r")), r",\s+"), lambda x: x != "")
    total = lambda k: F.aggregate(stats, F.lit(0).cast("long"), lambda acc, x: acc + _number(F.get(F.split(x, r"\s+"), F.lit(k))))
    tags = F.transform(F.filter(names, lambda x: x.startswith("tag: ")), lambda x: F.substr(x, F.lit(6)))
    branch = F.get(F.filter(names, lambda x: x.startswith("HEAD -> ")), F.lit(0))
    return part.select(
        *others, "ordinal", field(0).alias("hash"), field(1).alias("short_hash"), field(2).alias("author"), field(3).alias("author_email"), F.timestamp_seconds(_number(field(4))).alias("date"), field(5).alias("message"),
        F.substring_index(field(6), " ", 1).alias("parent_hash"), F.size(stats).cast("long").alias("files_changed"), total(0).alias("insertions"), total(1).alias("deletions"),
        field(5).startswith("Merge").alias("is_merge"), (F.size(tags) > 0).alias("is_tagged"), tags.alias("tags"), F.coalesce(F.substr(branch, F.lit(9)), F.lit("")).alias("branch"),
    )


def changes(diffs: DataFrame) -> DataFrame:
    """One row for each changed file of (commit_hash, diff): numbers of changed lines, kind of change and hunks.

    Lines are counted in the hunks, so no second listing is read; a file without
    hunks keeps its header as content.
    """
    part = diffs.select("commit_hash", F.explode(_beginning(F.col("diff"), "diff --git a/")).alias("content"))
    head = F.split(F.col("content"), r"(?m)^@@ ", 2)[0]
    body = F.coalesce(F.get(F.split(F.col("content"), r"(?m)^(?=@@ )", 2), F.lit(1)), F.lit(""))
    count = lambda sign: F.size(_lines(body, sign)).cast("long")
    take = lambda h, k: F.regexp_extract(h, HUNK, k)
    many = lambda h, k: F.when(take(h, k) == "", 1).otherwise(_number(take(h, k)))
    hunk = lambda h: F.struct(_number(take(h, 1)).alias("old_start"), many(h, 2).alias("old_lines"), _number(take(h, 3)).alias("new_start"), many(h, 4).alias("new_lines"), F.trim(take(h, 5)).alias("context"))
    kind = F.when(head.rlike("(?m)^new file mode"), "A").when(head.rlike("(?m)^deleted file mode"), "D").when(head.rlike("(?m)^rename from "), "R").otherwise("M")
    path = F.regexp_extract("content", r"^diff --git a/.+ b/([^\n]+)", 1)
    return part.select(
        F.concat(F.left("commit_hash", F.lit(8)), F.lit(":"), path).alias("id"), "commit_hash", path.alias("file_path"), kind.alias("change_type"), F.regexp_extract(head, r"(?m)^rename from ([^\n]+)", 1).alias("old_path"),
        F.col("content").alias("diff_content"), count(r"\+").alias("additions"), count("-").alias("deletions"), F.transform(F.regexp_extract_all(body, F.lit(HUNK), F.lit(0)), hunk).alias("hunks"),
    )


def affected_functions(path: Column, diff: Column, contexts: Column) -> Column:
    """Distinct names of what hunk headers and changed lines define, sorted."""

    def named(context: Column) -> Column:
        return F.coalesce(F.get(F.array_remove(F.array(*(F.regexp_extract(context, p, 1) for p in CONTEXTS)), ""), F.lit(0)), F.lit(""))

    extension, lines = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)), F.split(diff, "\n", -1)
    found = F.array().cast("array<string>")
    for extensions, patterns in DEFINITIONS.items():
        names = F.flatten(F.transform(lines, lambda x: F.array(*(F.regexp_extract(x, p, 1) for p in patterns))))
        found = F.when(extension.isin(*extensions.split()), names).otherwise(found)
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_remove(F.array_union(F.coalesce(F.transform(contexts, named), none), F.coalesce(found, none)), ""))


def blamed_lines(blames: DataFrame) -> DataFrame:
    """(path, line, hash, author, email, date, summary) of porcelain blames (path, blame): a commit's facts stand once and hold for all its lines."""
    part = blames.select("path", F.explode(_beginning(F.col("blame"), r"[0-9a-f]{40} \d+ \d+")).alias("p"))
    fact = lambda name: F.nullif(F.regexp_extract("p", rf"(?m)^{name} ([^\n]*)", 1), F.lit(""))
    w = W.partitionBy("path", "hash")
    rows = part.select("path", F.regexp_extract("p", r"^\S+ \d+ (\d+)", 1).cast("long").alias("line"), F.left("p", F.lit(40)).alias("hash"), fact("author").alias("author"), F.trim(fact("author-mail"), F.lit("<>")).alias("email"), F.timestamp_seconds(_number(fact("author-time"))).alias("date"), fact("summary").alias("summary"), F.col("p").rlike(r"(?m)^\t").alias("has_text"))
    return rows.select("path", "line", "hash", *(F.max(c).over(w).alias(c) for c in ("author", "email", "date", "summary")), "has_text").filter("has_text").drop("has_text")


def blame_summary(lines: DataFrame) -> DataFrame:
    """(path, author, lines, earliest, latest) of blamed lines."""
    return lines.groupBy("path", "author").agg(F.count("*").alias("lines"), F.min("date").alias("earliest"), F.max("date").alias("latest"))
