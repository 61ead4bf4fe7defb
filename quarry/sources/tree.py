"""Folder trees as rows, with roll-ups and a printed form.

Defined cases: a tree of one file has its folders; null paths are passed over; a
depth of 0 keeps the top alone; what is hidden begins with a dot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quarry.functions.code import matches_glob

#: Folders that are never listed.
EXCLUDED = ("node_modules", "vendor", ".git", "dist", "build", "target", "bin", "obj", "__pycache__", ".venv", "venv")


def _in_excluded(path: Column, exclude: list[str]) -> Column:
    out = F.exists(F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1)), lambda x: x.isin(*EXCLUDED))
    for g in exclude:
        out = out | matches_glob(path, g, "tree")
    return out


def nodes(files: DataFrame, depth: int = 3, files_too: bool = True, hidden: bool = False, include: list[str] = (), exclude: list[str] = (), indexed: DataFrame | None = None) -> DataFrame:
    """(path, name, parent, level, is_dir, size, files, indexed, truncated) of files (path, size) and their folders, folders first, then by name.

    files and indexed count what lies below, at any depth; folders at the last
    level are truncated if they hold anything. indexed is a table (path).
    """
    f = files.filter("path is not null").filter(~_in_excluded(F.col("path"), list(exclude)))
    if not hidden:
        f = f.filter(~F.exists(F.split("path", "/"), lambda x: x.startswith(".")))
    if include:
        hit = F.lit(False)
        for g in include:
            hit = hit | matches_glob(F.col("path"), g, "tree")
        f = f.filter(hit)
    if indexed is not None:
        f = f.join(indexed.select("path").distinct().withColumn("__i", F.lit(True)), "path", "left")
    f = f.withColumn("__i", F.col("__i").isNotNull() if indexed is not None else F.lit(False))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, ".").otherwise(F.array_join(F.slice(parts, F.lit(1), k), "/")))
    dirs = f.select(F.posexplode(above).alias("level", "path"), "__i", (F.size(parts) - 1).alias("__n")).groupBy("path", "level").agg(F.count("*").alias("files"), F.count_if("__i").alias("indexed"))
    dirs = dirs.select("path", "level", F.lit(True).alias("is_dir"), F.lit(None).cast("long").alias("size"), "files", "indexed", (F.col("level") >= depth).alias("truncated"))
    rows = f.select("path", F.size(parts).alias("level"), F.lit(False).alias("is_dir"), F.col("size").cast("long").alias("size"), F.lit(1).cast("long").alias("files"), F.col("__i").cast("long").alias("indexed"), F.lit(False).alias("truncated"))
    rows = (dirs.unionByName(rows) if files_too else dirs).filter(F.col("level") <= depth)
    parent = F.when(F.col("path") == ".", None).when(F.col("path").contains("/"), F.regexp_extract("path", r"^(.*)/", 1)).otherwise(".")
    return rows.select("path", F.substring_index("path", "/", -1).alias("name"), parent.alias("parent"), "level", "is_dir", "size", "files", "indexed", "truncated").orderBy("level", "parent", F.desc("is_dir"), "name")


def printed(tree: DataFrame) -> DataFrame:
    """(place, line) of a tree's nodes in the order in which they are read, each indented by its level; folders end in a slash and their counts."""
    below = F.filter(F.split("path", "/"), lambda x: x != ".")
    # folders sort before files of the same folder
    key = F.array_join(F.transform(below, lambda x, k: F.concat(F.when(F.col("is_dir") | (k < F.size(below) - 1), "0").otherwise("1"), x)), "/")
    text = F.concat(F.repeat(F.lit("  "), F.col("level")), "name", F.when(F.col("is_dir"), F.format_string("/ (%d files, %d indexed)", "files", "indexed")).otherwise(""))
    return tree.select(key.alias("place"), text.alias("line")).orderBy("place")
