"""Changes to record tables: upserts, deletions, transitions, sessions and snapshots.

A table is a DataFrame and a change gives the table after it; nothing is changed
in place, and a read never changes what it reads (`touched` is a step of its own).

Defined cases: an id that occurs more than once among new rows is taken once, the
last by `updated_at` where the table has it, else any one of the equal ids by the
whole row's order; a null id is a value like any other; new rows that lack a
column of the table get null there; empty tables are allowed everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def put(table: DataFrame, rows: DataFrame, key: list[str] | tuple[str, ...] = ("id",)) -> DataFrame:
    """The table with `rows` in place of the rows of their keys; of rows with one key the last by updated_at stays."""
    order = ([F.desc_nulls_last("updated_at")] if "updated_at" in rows.columns else []) + [F.desc(F.to_json(F.struct(*rows.columns)))]
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    last = rows.withColumn("__n", n).filter("__n = 1").drop("__n")
    gone = last.select(*(F.col(k).alias(f"__{k}") for k in key))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return table.join(gone, on, "left_anti").unionByName(last, allowMissingColumns=True).select(*table.columns)


def removed(table: DataFrame, where: Column) -> DataFrame:
    """The table without the rows for which `where` is true; null isn't true."""
    return table.filter(~F.coalesce(where, F.lit(False)))


# ---- the code index ----------------------------------------------------------------------


def put_symbols(symbols: DataFrame, rows: DataFrame) -> DataFrame:
    """Upsert by id; a line_count of 0 or null is filled from the lines, 1 at least."""
    count = F.when(F.col("end_line") >= F.col("start_line"), F.col("end_line") - F.col("start_line") + 1).otherwise(F.lit(1))
    own = F.col("line_count") if "line_count" in rows.columns else F.lit(None)
    return put(symbols, rows.withColumn("line_count", F.when(F.coalesce(own, F.lit(0)) == 0, count).otherwise(own).cast("long")))


def put_chunks(chunks: DataFrame, vectors: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, vectors) after new chunks (columns of chunks, and embedding): vectors keep a row a chunk that has one.

    Vectors of other chunks stay, whatever else the process has stored before (Q04).
    """
    new = rows.filter("embedding is not null").select(F.col("id").alias("chunk_id"), "embedding")
    ids = rows.select(F.col("id").alias("chunk_id")).distinct()
    return put(chunks, rows.drop("embedding")), vectors.join(ids, "chunk_id", "left_anti").unionByName(put(vectors.limit(0), new, ["chunk_id"]))


def without_file(index: dict[str, DataFrame], path: str | Column) -> dict[str, DataFrame]:
    """The tables chunks, vectors, symbols and refs without the rows of a file."""
    ids = index["chunks"].filter(F.col("file_path") == path).select(F.col("id").alias("chunk_id"))
    out = {name: removed(index[name], F.col("file_path") == path) for name in ("chunks", "symbols", "refs")}
    return out | {"vectors": index["vectors"].join(ids, "chunk_id", "left_anti")}


def without_files(index: dict[str, DataFrame], cache: DataFrame) -> dict[str, DataFrame]:
    """The tables without the rows of all cached files; rows of files that the cache doesn't know stay."""
    paths = cache.select(F.col("path").alias("file_path")).distinct()
    gone = index["chunks"].join(paths, "file_path", "left_semi").select(F.col("id").alias("chunk_id"))
    out = {name: index[name].join(paths, "file_path", "left_anti").select(*index[name].columns) for name in ("chunks", "symbols", "refs")}
    return out | {"vectors": index["vectors"].join(gone, "chunk_id", "left_anti")}


def put_metadata(state: DataFrame, values: DataFrame, key: str = "index_metadata") -> DataFrame:
    """State (key, value) with a one-row table as JSON under a key."""
    return put(state, values.select(F.lit(key).alias("key"), F.to_json(F.struct(*values.columns)).alias("value")), ["key"])


def metadata(state: DataFrame, schema: str, key: str = "index_metadata") -> DataFrame:
    """The one-row table under a key, no row if there is none."""
    return state.filter(F.col("key") == key).select(F.from_json("value", schema).alias("v")).select("v.*")


def watermark(state: DataFrame, key: str = "last_indexed_commit") -> str:
    """The hash up to which the history is indexed, "" if none is."""
    row = state.filter(F.col("key") == key).select("value").first()
    return row["value"] if row and row["value"] else ""


def put_watermark(state: DataFrame, value: str, key: str = "last_indexed_commit") -> DataFrame:
    return put(state, state.sparkSession.createDataFrame([(key, value)], "key string, value string"), ["key"])


# ---- memories, sessions, checkpoints -----------------------------------------------------


def put_memories(memories: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Upsert by id; a row that was never accessed counts as accessed when it was created (Q14), an update moves updated_at."""
    known = memories.select(F.col("id").alias("__id")).distinct()
    rows = rows.join(known, F.col("id").eqNullSafe(F.col("__id")), "left")
    rows = rows.withColumn("updated_at", F.when(F.col("__id").isNotNull(), now).otherwise(F.coalesce("updated_at", "created_at"))).withColumn("accessed_at", F.coalesce("accessed_at", "created_at"))
    return put(memories, rows.drop("__id"))


def touched(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """Memories of which those in hits (id) were read once more, now."""
    h = hits.select(F.col("id").alias("__id")).distinct()
    rows = memories.join(h, F.col("id").eqNullSafe(F.col("__id")), "left")
    hit = F.col("__id").isNotNull()
    out = {"access_count": F.col("access_count") + hit.cast("int"), "accessed_at": F.when(hit, now).otherwise(F.col("accessed_at"))}
    return rows.withColumns(out).select(*memories.columns)


def sessions_with_counts(sessions: DataFrame, memories: DataFrame) -> DataFrame:
    """Sessions with their number of memories (memory_count), newest first."""
    n = memories.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("memory_count"))
    rows = sessions.join(n, "id", "left").withColumn("memory_count", F.coalesce("memory_count", F.lit(0)).cast("long"))
    return rows.select(*sessions.columns, "memory_count").orderBy(F.desc("started_at"), "id")


def active_sessions(sessions: DataFrame) -> DataFrame:
    return sessions.filter("ended_at is null")


def ended(sessions: DataFrame, session_id: str | Column, now: Column, summary: str | None = None) -> DataFrame:
    """Sessions of which one ends now; a session that has ended keeps its end."""
    hit = (F.col("id") == session_id) & F.col("ended_at").isNull()
    out = {"ended_at": F.when(hit, now).otherwise(F.col("ended_at"))}
    if summary is not None:
        out["summary"] = F.when(hit, F.lit(summary)).otherwise(F.col("summary"))
    return sessions.withColumns(out)


def checkpoint(memories: DataFrame, name: Column, channel: Column, now: Column) -> DataFrame:
    """(channel, name, created_at, memory_ids): a snapshot of the ids of every channel's memories (Q17); ids are one array a channel."""
    rows = memories.groupBy(F.col("channel").alias("channel")).agg(F.sort_array(F.collect_set("id")).alias("memory_ids"))
    return rows.filter(F.col("channel").eqNullSafe(channel)).select("channel", name.alias("name"), now.alias("created_at"), "memory_ids")


def restored(memories: DataFrame, saved: DataFrame) -> DataFrame:
    """Memories without those of the checkpoint's channel that aren't in it; a checkpoint (channel, memory_ids) without ids changes nothing.

    Rows deleted since stay deleted: a checkpoint holds ids.
    """
    kept = saved.filter(F.size("memory_ids") > 0)
    ids = kept.select("channel", F.explode("memory_ids").alias("id")).withColumn("__saved", F.lit(True))
    marked = memories.join(F.broadcast(kept.select("channel").distinct().withColumn("__covered", F.lit(True))), "channel", "left")  # channels of one checkpoint
    marked = marked.join(ids, ["channel", "id"], "left")
    return marked.filter(F.col("__covered").isNull() | F.col("__saved").isNotNull()).select(*memories.columns)


def pruned(memories: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(memories that haven't expired, one row with the number of those that have)."""
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return memories.filter(~gone), memories.agg(F.count_if(gone).alias("pruned"))


def consolidated(memories: DataFrame) -> DataFrame:
    """Memories as they are: consolidation has no rule to follow yet."""
    return memories


# ---- todos -------------------------------------------------------------------------------


def without_todo(todos: DataFrame, todo_id: str | Column) -> DataFrame:
    """Todos without one and its children, but not theirs."""
    return removed(todos, (F.col("id") == todo_id) | (F.col("parent_id") == todo_id))


def moved(todos: DataFrame, todo_id: str | Column, channel: str | Column, now: Column) -> DataFrame:
    hit = F.coalesce(F.col("id") == todo_id, F.lit(False))
    channel = F.lit(channel) if isinstance(channel, str) else channel
    return todos.withColumns({"channel": F.when(hit, channel).otherwise(F.col("channel")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def with_children(todos: DataFrame, parents: DataFrame | None = None) -> DataFrame:
    """Todos with the array of their children's (rank, created_at, id, title, status), by priority rank and then newest first (Q: lexical order isn't kept)."""
    rank = priority_rank(F.col("priority"))
    kids = todos.filter("parent_id is not null and parent_id <> ''").groupBy(F.col("parent_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct(rank.alias("rank"), (-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("newest"), F.col("id"), F.col("title"), F.col("status")))).alias("children")
    )
    return (todos if parents is None else parents).join(kids, "id", "left")


def priority_rank(priority: Column) -> Column:
    """0 urgent, 1 high, 2 medium, 3 all else."""
    return F.when(priority == "urgent", 0).when(priority == "high", 1).when(priority == "medium", 2).otherwise(3)


# ---- records kept as JSON lines ----------------------------------------------------------


def added(table: DataFrame, rows: DataFrame, required: list[str], now: Column, defaults: dict[str, str] | None = None) -> DataFrame:
    """The table and new rows that have all required texts, with defaults for empty ones; an id is made of the row's content and time where it has none."""
    for name in required:
        rows = rows.filter(F.trim(F.coalesce(F.col(name), F.lit(""))) != "")
    for name, value in (defaults or {}).items():
        own = F.nullif(F.col(name), F.lit("")) if name in rows.columns else F.lit(None).cast("string")
        rows = rows.withColumn(name, F.coalesce(own, F.lit(value)))
    content = F.to_json(F.struct(*(c for c in rows.columns if c != "id")))
    own = F.nullif(F.col("id"), F.lit("")) if "id" in rows.columns else F.lit(None).cast("string")
    rows = rows.withColumn("id", F.coalesce(own, F.left(F.sha2(F.concat(content, F.lit("|"), now.cast("string")), 256), F.lit(16))))
    rows = rows.withColumns({"created_at": now, "updated_at": now})
    return table.unionByName(rows, allowMissingColumns=True).select(*table.columns)


def updated(table: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """Partial update by id: a null in changes keeps the old value, an empty array replaces it; ids that the table lacks are passed over."""
    names = [c for c in changes.columns if c != "id"]
    c = changes.select(F.col("id").alias("__id"), *(F.col(n).alias(f"__{n}") for n in names)).dropDuplicates(["__id"])
    rows = table.join(c, table["id"] == F.col("__id"), "left")
    new = {n: F.coalesce(F.col(f"__{n}"), F.col(n)) for n in names}
    new["updated_at"] = F.when(F.col("__id").isNotNull(), now).otherwise(F.col("updated_at"))
    return rows.withColumns(new).select(*table.columns)


def moved_to(table: DataFrame, status: Column, now: Column, ends: str, final: str) -> DataFrame:
    """Records with a new status (null: as it was): column `ends` is set on the first move to `final` and cleared by any other move."""
    s = F.coalesce(status, F.col("status"))
    end = F.when(status.isNull(), F.col(ends)).when(status == final, F.coalesce(F.col(ends), now))
    return table.withColumn("__s", s).withColumn(ends, end).withColumn("updated_at", F.when(status.isNotNull(), now).otherwise(F.col("updated_at"))).withColumn("status", F.col("__s")).drop("__s")


def superseded(decisions: DataFrame, old: str | Column, new: str | Column, now: Column) -> DataFrame:
    """Decisions of which one is superseded by another, whatever its status was."""
    hit = F.coalesce(F.col("id") == old, F.lit(False))
    new = F.lit(new) if isinstance(new, str) else new
    return decisions.withColumns({"status": F.when(hit, "superseded").otherwise(F.col("status")), "superseded_by": F.when(hit, new).otherwise(F.col("superseded_by")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))})


def with_context(context: DataFrame, **values: str | None) -> DataFrame:
    """The one-row working context with new values; None and "" keep the old ones."""
    return context.withColumns({k: F.lit(v) for k, v in values.items() if v})


def with_relevant_file(context: DataFrame, path: str, present: bool = True) -> DataFrame:
    """The context with a relevant file appended once, or taken out."""
    files = F.coalesce("relevant_files", F.array().cast("array<string>"))
    return context.withColumn("relevant_files", F.array_distinct(F.array_append(files, F.lit(path))) if present else F.array_remove(files, path))


def cleared_context(context: DataFrame) -> DataFrame:
    """The context with no value but its branch."""
    return context.select(*(F.col(c) if c == "branch" else F.lit(None).cast(t).alias(c) for c, t in context.dtypes))


def last_searches(log: DataFrame, most: int = 20) -> DataFrame:
    """The last searches of a log (query, at), newest first: what a ring buffer of that size holds."""
    return log.orderBy(F.desc("at"), "query").limit(most)
