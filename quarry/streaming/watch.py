"""Changes of files as they come: events, re-indexing by batch, logs of sessions.

The file source of Structured Streaming gives files that appear; what is removed is
found by comparing listings. Every batch is applied whole and once: its table is
written under the batch's number, so a batch that runs again after a loss writes
the same table again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.sources import files


def arriving(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = ()) -> DataFrame:
    """Stream of (path, content, language, hash, at): files that appear under a folder; hidden ones are passed over, new folders are seen."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(root)
    rows = files.globbed(raw.filter(~F.col("path").rlike(r"/\.[^/]+")), include, exclude)
    return rows.select("path", F.make_valid_utf8(F.col("content").cast("string")).alias("content"), files.language_of(F.col("path")).alias("language"), F.sha2("content", 256).alias("hash"), F.col("modificationTime").alias("at"))


def events(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, event) between two listings (path, hash): create, write or remove; what is equal gives none."""
    b, a = before.select("path", F.col("hash").alias("b")), after.select("path", F.col("hash").alias("a"))
    kind = F.when(F.col("b").isNull(), "create").when(F.col("a").isNull(), "remove").when(F.col("a") != F.col("b"), "write")
    return b.join(a, "path", "full_outer").select("path", kind.alias("event")).filter("event is not null")


def reindexed(index: DataFrame, changed: DataFrame, removed: DataFrame, rows_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """An index (path, ...) after changed files (whose rows rows_of makes) and removed ones (path)."""
    gone = changed.select("path").union(removed.select("path")).distinct()
    return index.join(gone, "path", "left_anti").unionByName(rows_of(changed), allowMissingColumns=True).select(*index.columns)


def follow(stream: DataFrame, out: str, rows_of: Callable[[DataFrame], DataFrame], checkpoint: str, progress: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Writes the rows of each batch of files to out/batch=N and tells progress(N, rows); all there is, then stops."""

    def apply(batch: DataFrame, number: int) -> None:
        rows_of(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if progress is not None:
            progress(number, batch.sparkSession.read.parquet(f"{out}/batch={number}").count())

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_batches(rows: DataFrame) -> DataFrame:
    """What `follow` wrote, of each path the rows of its last batch."""
    last = rows.groupBy("path").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["path", "batch"], "left_semi")


def recent_changes(changes: DataFrame, commits: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Changes (commit_hash) of commits (hash, date) of the last days, which are the ones whose diffs are embedded."""
    late = commits.filter(F.datediff(now, "date") <= days).select(F.col("hash").alias("commit_hash"))
    return changes.join(late, "commit_hash", "left_semi")


def worth_embedding(changes: DataFrame, least: int = 1, most: int = 1000) -> DataFrame:
    """Changes of between least and most added and deleted lines."""
    return changes.filter((F.col("additions") + F.col("deletions")).between(least, most))


def session_log(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """A log (at, event, detail), newest first."""
    rows = entries.orderBy(F.desc("at"), "event", "detail")
    return rows if limit is None else rows.limit(limit)


def branch_switch(entries: DataFrame, old: str, new: str, now: Column) -> DataFrame:
    """The log with a row for a switch of branches; none if they are the same."""
    if old == new:
        return entries
    row = entries.sparkSession.range(1).select(now.alias("at"), F.lit("branch_switch").alias("event"), F.lit(f"{old} -> {new}").alias("detail"))
    return entries.unionByName(row)
