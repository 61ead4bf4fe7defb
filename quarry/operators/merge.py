"""Three-way merge of record tables by id.

The three sides meet in one grouping by id, so a table is read and shuffled once.

Defined cases: an id that a side repeats is taken once, its greatest row; a null
id is an id like any other; empty sides are allowed; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Fixed value: what stands between two contents that both sides have changed.
JOINT = "\n\n---\n**[Merged from other branch]:**\n"


def sides(base: DataFrame, ours: DataFrame, theirs: DataFrame, columns: list[str]) -> DataFrame:
    """(id, b, o, t): a struct of the columns for each side, null where a side lacks the id."""
    parts = [d.select("id", F.lit(n).alias("__n"), F.struct(*columns).alias("__s")) for d, n in ((base, "b"), (ours, "o"), (theirs, "t"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("id").agg(*(F.max(F.when(F.col("__n") == n, F.col("__s"))).alias(n) for n in "bot"))


def _action(same: Column, o_same: Column, t_same: Column) -> Column:
    """What becomes of an id, by which sides have it and which are equal."""
    in_b, in_o, in_t = (F.col(c).isNotNull() for c in "bot")
    return (
        F.when(in_o & in_t, F.when(same, "same").when(in_b & o_same, "theirs").when(in_b & t_same, "ours").when(in_b, "both").otherwise("ours_added"))
        .when(in_o, F.when(~in_b, "ours").when(o_same, "deleted").otherwise("ours_kept"))
        .when(in_t, F.when(~in_b, "theirs").when(t_same, "deleted").otherwise("theirs_kept"))
        .otherwise("deleted")
    )


#: Actions that take our row, take theirs, and are conflicts.
OURS, THEIRS = ("same", "ours", "ours_kept", "ours_added"), ("theirs", "theirs_kept")
CONFLICTS = ("both", "ours_added", "ours_kept", "theirs_kept")


def merge_notes(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, content, action, conflict) of tables (id, content): a side that left the base alone yields; two changes conflict."""
    r = sides(base, ours, theirs, ["content"])
    eq = lambda x, y: F.col(f"{x}.content").eqNullSafe(F.col(f"{y}.content"))
    r = r.withColumn("action", _action(eq("o", "t"), eq("o", "b"), eq("t", "b")))
    both = F.concat("o.content", F.lit(JOINT), "t.content")
    content = F.when(F.col("action").isin(*OURS), F.col("o.content")).when(F.col("action").isin(*THEIRS), F.col("t.content")).when(F.col("action") == "both", both)
    return r.select("id", content.alias("content"), "action", F.col("action").isin(*CONFLICTS).alias("conflict"))


def merge_note_records(base: DataFrame, ours: DataFrame, theirs: DataFrame, strategy: str = "auto") -> DataFrame:
    """(id, title, content, file, tags, action, conflict) of notes (id, title, content, file, tags).

    Notes are equal by title, content and file. Where both sides changed one, contents
    are joined and tags united; with strategy "ours" or "theirs" that side's row
    stands and nothing conflicts (Q18). A deletion against a change keeps the change.
    """
    r = sides(base, ours, theirs, ["title", "content", "file", "tags"])

    def eq(x: str, y: str) -> Column:
        same = F.lit(True)
        for c in ("title", "content", "file"):
            same = same & F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}"))
        return same

    r = r.withColumn("action", _action(eq("o", "t"), eq("o", "b"), eq("t", "b")))
    none = F.array().cast("array<string>")
    united = F.array_sort(F.array_union(F.coalesce("o.tags", none), F.coalesce("t.tags", none)))
    both = F.struct(F.col("o.title").alias("title"), F.concat(F.coalesce("o.content", F.lit("")), F.lit(JOINT), F.coalesce("t.content", F.lit(""))).alias("content"), F.col("o.file").alias("file"), united.alias("tags"))
    contested = F.col("action").isin("both", "ours_added")
    side = F.when(contested & (F.lit(strategy) == "theirs"), F.col("t")).when(contested & (F.lit(strategy) == "ours"), F.col("o"))
    pick = F.coalesce(side, F.when(F.col("action").isin(*OURS), F.col("o")).when(F.col("action").isin(*THEIRS), F.col("t")).when(F.col("action") == "both", both))
    conflict = F.col("action").isin(*CONFLICTS) & ~(contested & F.lit(strategy != "auto"))
    return r.select("id", pick.alias("p"), "action", conflict.alias("conflict")).select("id", "p.title", "p.content", "p.file", "p.tags", "action", "conflict")


def merge_latest(base: DataFrame, ours: DataFrame, theirs: DataFrame, final: str | None = None) -> DataFrame:
    """(id, status, updated) of tables (id, status, updated): a final status wins (ours first), else the later row, theirs on a tie; a deletion wins."""
    return _latest(base, ours, theirs, final).filter("p is not null").select("id", "p.status", "p.updated")


def _latest(base: DataFrame, ours: DataFrame, theirs: DataFrame, final: str | None) -> DataFrame:
    r = sides(base, ours, theirs, ["status", "updated"])
    both = F.when(F.col("o.updated") > F.col("t.updated"), F.col("o")).otherwise(F.col("t"))
    if final is not None:
        both = F.when(F.col("o.status") == final, F.col("o")).when(F.col("t.status") == final, F.col("t")).otherwise(both)
    pick = F.when(F.col("o").isNotNull() & F.col("t").isNotNull(), both).when(F.col("b").isNull(), F.coalesce("o", "t"))
    return r.withColumn("p", pick)


def merge_decisions(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Decisions: the later of two rows, theirs on a tie."""
    return merge_latest(base, ours, theirs)


def merge_todos(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Todos: one that is done stays done."""
    return merge_latest(base, ours, theirs, "done")


def merge_issues(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Issues: one that is resolved stays resolved."""
    return merge_latest(base, ours, theirs, "resolved")


def merge_counts(base: DataFrame, ours: DataFrame, theirs: DataFrame, final: str | None = None) -> DataFrame:
    """One row: added, modified (on both sides and in the base, changed or not) and deleted (by one side); ids that both sides deleted count nowhere."""
    in_b, in_o, in_t = (F.col(c).isNotNull() for c in "bot")
    return _latest(base, ours, theirs, final).agg(F.count_if(~in_b).alias("added"), F.count_if(in_b & in_o & in_t).alias("modified"), F.count_if(in_b & (in_o != in_t)).alias("deleted"))
