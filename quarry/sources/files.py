"""Source files and record files as DataFrames.

Defined cases: contents that aren't UTF-8 are decoded with replacement marks; a
file that repeats in a list is read once for each; empty folders raise, as Spark does.
"""

from __future__ import annotations

import functools
import operator
import os
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quarry.functions.code import matches_glob

UNITS = {"KB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "B": 1}
#: File extensions and the language they name.
LANGUAGES = {"go": "go", "py": "python", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "rs": "rust", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php", "kt": "kotlin", "swift": "swift", "scala": "scala", "lua": "lua", "sql": "sql", "md": "markdown", "sh": "bash", "css": "css", "html": "html", "yaml": "yaml", "yml": "yaml", "json": "json", "toml": "toml"}


def size_of(text: str) -> int:
    """Bytes of a literal such as 1MB; 0 where it has no known unit."""
    s = text.strip().upper()
    for unit, n in UNITS.items():
        if s.endswith(unit) and s[: -len(unit)].strip().isdigit():
            return int(s[: -len(unit)]) * n
    return 0


def language_of(path: Column, unknown: str = "text") -> Column:
    table = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit(unknown))


def globbed(paths: DataFrame, include: list[str] = (), exclude: list[str] = (), dialect: str = "index") -> DataFrame:
    """Rows (path) that any include takes, or all if there is none, and no exclude."""
    hit = lambda globs: functools.reduce(operator.or_, (matches_glob(F.col("path"), g, dialect) for g in globs))
    rows = paths.filter(hit(include)) if include else paths
    return rows.filter(~hit(exclude)) if exclude else rows


def source_files(spark: SparkSession, root: str, most_bytes: int | str = 1 << 20, include: list[str] = (), exclude: list[str] = (), most: int | None = None) -> DataFrame:
    """(path, content, language, hash) of all files under a folder up to a size, paths under the folder.

    Size and globs are tested on names and lengths before contents are read. More
    than `most` files raise; nothing is left out silently.
    """
    most_bytes = size_of(most_bytes) if isinstance(most_bytes, str) else most_bytes
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= most_bytes)
    base = root.rstrip("/").split("://")[-1].removeprefix("file:")
    raw = globbed(raw.withColumn("path", F.regexp_replace("path", rf"^(?:file:)?/*?{re.escape(base)}/", "")), include, exclude)
    if most is not None and raw.select("path").limit(most + 1).count() > most:
        raise ValueError(f"more than {most} files under {root}")
    return raw.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"))


def read_files(root: str, paths: DataFrame, most_bytes: int = 1 << 20) -> DataFrame:
    """source_files of listed files (path) under a folder that all executors see; files that are gone or too large are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column(0).to_pylist():
                at = os.path.join(root, p)
                if os.path.isfile(at) and os.path.getsize(at) <= most_bytes:
                    with open(at, "rb") as f:
                        yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([f.read()], pa.binary())], ["path", "raw"])

    rows = paths.select("path").mapInArrow(run, "path string, raw binary")
    return rows.select("path", F.make_valid_utf8(F.col("raw").cast("string")).alias("content"), language_of(F.col("path")).alias("language"), F.sha2("raw", 256).alias("hash"))


def walked(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), most: int = 50_000) -> DataFrame:
    """source_files by git's list where that gives any file, else by walking the folder."""
    from quarry.sources import git

    try:
        listed = git.tracked(spark, root, include, exclude, most)
        if listed.limit(1).count():
            return read_files(root, listed)
    except git.GitError:
        pass
    return source_files(spark, root, include=include, exclude=exclude, most=most)


#: Longest line of a strictly read file, in characters.
LINE = 1 << 20


def records(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; strict fails on a bad line or one over LINE characters, else bad lines are passed over; blank lines are none."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    if strict:
        checked = F.when(F.length("value") > LINE, F.raise_error(F.lit(f"a line has more than {LINE} characters")).cast("string")).otherwise(F.col("value"))
        return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return _lenient(lines, schema)


def parsed(spark: SparkSession, text: str, schema: StructType | str) -> DataFrame:
    """Records of a JSON-lines text, bad lines passed over."""
    return _lenient(spark.createDataFrame([(x,) for x in text.splitlines() if x.strip()], "value string"), schema)


def _lenient(lines: DataFrame, schema: StructType | str) -> DataFrame:
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    whole = StructType(list(kind.fields)).add("__bad", "string")
    rows = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("r"))
    return rows.filter("r is not null and r.__bad is null").select("r.*").drop("__bad")


def save_records(table: DataFrame, path: str) -> None:
    """Writes JSON lines to a folder beside the wanted one and then renames it, so a reader sees the old table or the new one."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    name = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fresh, old = f"{path}.{uuid.uuid4().hex}.new", f"{path}.{uuid.uuid4().hex}.old"
    table.write.option("ignoreNullFields", "false").json(fresh)
    fs = name(path).getFileSystem(conf)
    if fs.exists(name(path)):
        fs.rename(name(path), name(old))
    fs.rename(name(fresh), name(path))
    fs.delete(name(old), True)


def append_records(rows: DataFrame, path: str) -> None:
    rows.write.option("ignoreNullFields", "false").mode("append").json(path)


def exported(tables: dict[str, DataFrame], root: str) -> None:
    """Writes named record tables as JSON lines, a folder each."""
    for name, table in tables.items():
        save_records(table, f"{root}/{name}")


def imported(spark: SparkSession, root: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: records(spark, f"{root}/{name}", schema, strict=False) for name, schema in schemas.items()}


def cleared(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables without rows."""
    return {name: table.limit(0) for name, table in tables.items()}


#: Bytes a core under which a table is dealt out anew: a small file may be one row group, which is one task.
SMALL = 4 << 20


def spread(table: DataFrame) -> DataFrame:
    """A table whose plan is small dealt to all cores; a larger one as it is. Rows are the same."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores) if size < cores * SMALL else table


def put_hashes(cache: DataFrame, files: DataFrame) -> DataFrame:
    """The cache (path, hash, config_hash) with the given files' hashes; a null config_hash is one."""
    new = files.select(*(F.col(c) if c in files.columns else F.lit(None).cast("string").alias(c) for c in ("path", "hash", "config_hash"))).dropDuplicates(["path"])
    return cache.join(new.select("path"), "path", "left_anti").select("path", "hash", "config_hash").unionByName(new)


def stale(files: DataFrame, cached: DataFrame, config_hash: str | None = None) -> DataFrame:
    """Files whose path, hash and configuration the cache lacks (Q21)."""
    known = cached.filter(F.col("config_hash").eqNullSafe(F.lit(config_hash)))
    return changed(files, known)


def changed(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Files whose (path, hash) the cache lacks."""
    return files.join(cached.select("path", "hash"), ["path", "hash"], "left_anti")


def deleted(files: DataFrame, cached: DataFrame) -> DataFrame:
    """Cached files that are gone (Q23)."""
    return cached.join(files.select("path"), "path", "left_anti")
