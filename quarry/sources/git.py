"""What git knows, as DataFrames: the driver runs git in a working copy, texts go to the parsers of `history`.

Diffs of many commits are read by the executors, which need the working copy at
the same path. Times are UTC. A folder that isn't a working copy raises
GitError; a repository without commits gives empty tables.
"""

from __future__ import annotations

import os
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.functions.code import matches_glob
from quarry.sources import files, history


class GitError(RuntimeError):
    """What git said when it failed."""


def git(root: str, *args: str, fails: bool = True) -> str:
    """Output of a git command in a folder; with fails unset "" if it fails."""
    done = subprocess.run(["git", "-C", root, *args], capture_output=True)
    if done.returncode:
        if fails:
            raise GitError(done.stderr.decode(errors="replace").strip())
        return ""
    return done.stdout.decode(errors="replace")


def tracked(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), most: int | None = None) -> DataFrame:
    """(path) of tracked and new files that aren't ignored, in order; includes first, then excludes, then the limit."""
    names = [n for n in git(root, "ls-files", "-z", "--cached", "--others", "--exclude-standard").split("\0") if n]
    rows = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "path string")
    rows = files.globbed(rows, include, exclude)
    return rows if most is None else rows.orderBy("path").limit(most)


def log(spark: SparkSession, root: str, *args: str) -> DataFrame:
    """Commits of `git log` with further arguments; see `history.commits`."""
    text = git(root, "log", history.LOG_FORMAT, "--numstat", *args, fails=False)
    return history.commits(spark.createDataFrame([(text,)], "log string")).drop("ordinal")


def commits(spark: SparkSession, root: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    return log(spark, root, *([f"--since={since}"] if since else []), *([f"-n{limit}"] if limit else []))


def commits_after(spark: SparkSession, root: str, commit_hash: str) -> DataFrame:
    """Commits that HEAD has and a commit hasn't; all of them if it is ""."""
    return log(spark, root, f"{commit_hash}..HEAD") if commit_hash else log(spark, root)


def commits_between(spark: SparkSession, root: str, first: str, last: str) -> DataFrame:
    """Commits after first up to and with last; an empty last is HEAD (Q06)."""
    return log(spark, root, f"{first}..{last or 'HEAD'}")


def diffs(hashes: DataFrame, root: str) -> DataFrame:
    """(commit_hash, diff) of commits (hash): each executor asks git for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h in b.column(0).to_pylist():
                text = git(root, "diff-tree", "-p", "-r", "--root", "--no-commit-id", "-M", h)
                yield pa.RecordBatch.from_arrays([pa.array([h]), pa.array([text])], ["commit_hash", "diff"])

    return hashes.select("hash").mapInArrow(run, "commit_hash string, diff string")


def changes(hashes: DataFrame, root: str) -> DataFrame:
    """Changed files of commits (hash); see `history.changes`."""
    return history.changes(diffs(hashes, root))


def blame(spark: SparkSession, root: str, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Blamed lines of a file or of its lines first to last; see `history.blamed_lines`."""
    lines = [f"-L{first},{last}"] if first else []
    return history.blamed_lines(spark.createDataFrame([(path, git(root, "blame", "--porcelain", *lines, "--", path))], "path string, blame string"))


def recent_files(changes_of: DataFrame, since) -> DataFrame:
    """(file_path, last) of changes (file_path, date) since a time, latest first."""
    rows = changes_of.filter(F.col("date") >= F.lit(since)).groupBy("file_path").agg(F.max("date").alias("last"))
    return rows.orderBy(F.desc("last"), "file_path")


def file_history(commits_of: DataFrame, changes_of: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """Commits (hash, ...) that changed a file, newest first."""
    hit = changes_of.filter(F.col("file_path") == path).select(F.col("commit_hash").alias("hash")).distinct()
    rows = commits_of.join(hit, "hash", "left_semi").orderBy(F.desc("date"), "hash")
    return rows if limit is None else rows.limit(limit)


def head(root: str) -> str:
    """Hash of HEAD, "" before the first commit."""
    return git(root, "rev-parse", "--verify", "-q", "HEAD", fails=False).strip()


def tags(spark: SparkSession, root: str) -> DataFrame:
    """(tag, hash): each tag's commit."""
    text = git(root, "for-each-ref", "--format=%(refname:short)%09%(objectname)%09%(*objectname)", "refs/tags", fails=False)
    rows = [x.split("\t") for x in text.splitlines()]
    return spark.createDataFrame([(r[0], r[2] or r[1]) for r in rows], "tag string, hash string")


STATE = "branch string, commit string, dirty_files array<string>, ahead int, behind int, merging boolean, rebasing boolean, conflicts array<string>, project_id string"


def state(spark: SparkSession, root: str) -> DataFrame:
    """One row about a working copy; see STATE."""
    folder = git(root, "rev-parse", "--absolute-git-dir").strip()
    lines = [x for x in git(root, "status", "--porcelain", "-z").split("\0") if x]
    counts = git(root, "rev-list", "--left-right", "--count", "@{u}...HEAD", fails=False).split() or ["0", "0"]
    there = lambda *names: any(os.path.exists(os.path.join(folder, n)) for n in names)
    roots = git(root, "rev-list", "--max-parents=0", "HEAD", fails=False).split()
    conflicts = git(root, "diff", "--name-only", "--diff-filter=U", fails=False).splitlines()
    branch = git(root, "symbolic-ref", "--short", "-q", "HEAD", fails=False).strip()
    row = (branch, head(root), [x[3:] for x in lines if x[2:3] == " "], int(counts[1]), int(counts[0]), there("MERGE_HEAD"), there("rebase-merge", "rebase-apply"), conflicts, roots[0][:8] if roots else "")
    return spark.createDataFrame([row], STATE)


def changed_since(spark: SparkSession, root: str, commit_hash: str) -> DataFrame:
    """(path) of files that differ between a commit and HEAD."""
    names = git(root, "diff", "--name-only", "-z", commit_hash, "HEAD").split("\0")
    return spark.createDataFrame([(n,) for n in names if n], "path string")


def status_of(spark: SparkSession, root: str, globs: list[str]) -> DataFrame:
    """(path, status) of the changed files that a glob takes: the two letters of git's short status."""
    lines = [x for x in git(root, "status", "--porcelain", "-z", "--untracked-files=all").split("\0") if x[2:3] == " "]
    rows = spark.createDataFrame([(x[3:], x[:2]) for x in lines], "path string, status string")
    hit = F.lit(False)
    for g in globs:
        hit = hit | matches_glob(F.col("path"), g)
    return rows.filter(hit)


def merge_sides(spark: SparkSession, root: str, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(base, ours, theirs) of a JSON-lines file in conflict, from git's stages 1 to 3; bad lines are passed over, a missing stage is empty."""
    return tuple(files.parsed(spark, git(root, "show", f":{k}:{path}", fails=False), schema) for k in (1, 2, 3))
