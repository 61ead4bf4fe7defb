"""Filters and orders of record tables; every argument that is None filters nothing.

Comparisons said to ignore case do so for all letters. `like` takes a user's
text as a pattern with live % and _ (Q20) unless `escape` is set. Orders always
end in the id, so that equal rows come in one order (Q16).
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, functions as F

from quarry.operators.stores import priority_rank


def every(*conditions: Column | None) -> Column:
    return functools.reduce(operator.and_, (c for c in conditions if c is not None), F.lit(True))


def some(*conditions: Column) -> Column:
    return functools.reduce(operator.or_, conditions, F.lit(False))


def one_of(column: str, values: list | None) -> Column | None:
    return F.col(column).isin(*values) if values else None


def same_name(column: str, value: str | None) -> Column | None:
    """Equal but for case."""
    return F.lower(column) == value.lower() if value else None


def holds(column: str, value: str | None) -> Column | None:
    """Contains a text, case and all."""
    return F.col(column).contains(value) if value else None


def mentions(columns: list[str], value: str | None) -> Column | None:
    """Any of the columns contains a text but for case; null columns don't."""
    return some(*(F.coalesce(F.lower(c).contains(value.lower()), F.lit(False)) for c in columns)) if value else None


def like(column: Column, text: str, escape: bool = False) -> Column:
    """A text anywhere in a column, but for case."""
    if escape:
        text = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return column.ilike(f"%{text}%")


def at_least(column: str, value) -> Column | None:
    return F.col(column) >= F.lit(value) if value is not None else None


def at_most(column: str, value) -> Column | None:
    return F.col(column) <= F.lit(value) if value is not None else None


def tagged(tags: list[str] | None, whole: bool = False) -> Column | None:
    """Every tag is in the record's tags: as part of one of them but for case, or whole; tags may be null."""
    if not tags:
        return None
    hit = lambda t: F.exists("tags", lambda x: F.lower(x) == t.lower() if whole else F.lower(x).contains(t.lower()))
    return every(*(F.coalesce(hit(t), F.lit(False)) for t in tags))


def any_tag(tags: list[str] | None) -> Column | None:
    """Any of the tags is among the record's, but for case."""
    if not tags:
        return None
    return F.coalesce(F.exists("tags", lambda x: F.lower(x).isin(*(t.lower() for t in tags))), F.lit(False))


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of ordered rows; the order must be total for pages to fit together."""
    rows = rows.orderBy(*order)
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def symbols(table: DataFrame, query: str | None = None, kind: str | None = None, least_lines: int | None = None, longest_first: bool = False, limit: int | None = None, escape: bool = False) -> DataFrame:
    """Symbols by part of their name, kind and lines, by name or longest first."""
    rows = table.filter(every(like(F.col("name"), query, escape) if query else None, F.col("kind") == kind if kind else None, at_least("line_count", least_lines)))
    return page(rows, [F.desc("line_count"), "id"] if longest_first else ["name", "id"], 0, limit)


def long_functions(table: DataFrame, least_lines: int, limit: int | None = None) -> DataFrame:
    return symbols(table.filter(F.col("kind").isin("function", "method")), least_lines=least_lines, longest_first=True, limit=limit)


def memories(table: DataFrame, now: Column, channel: str | None = None, categories: list[str] | None = None, least_importance: float | None = None, expired: bool = False, created_after=None, created_before=None, accessed_after=None, tags: list[str] | None = None) -> DataFrame:
    alive = None if expired else F.col("expires_at").isNull() | (F.col("expires_at") > now)
    same = F.col("channel") == channel if channel else None
    return table.filter(every(same, one_of("category", categories), at_least("importance", least_importance), alive, at_least("created_at", created_after), at_most("created_at", created_before), at_least("accessed_at", accessed_after), tagged(tags)))


def todos(table: DataFrame, channel: str | None = None, statuses: list[str] | None = None, completed: bool = False, priorities: list[str] | None = None, parent: str | None = None, due_before=None, due_after=None, created_after=None, tags: list[str] | None = None) -> DataFrame:
    """Todos of a parent, or those without one; completed and cancelled ones only if asked for."""
    open_ = one_of("status", statuses) if statuses else (None if completed else ~F.col("status").isin("completed", "cancelled"))
    level = F.col("parent_id") == parent if parent else F.col("parent_id").isNull() | (F.col("parent_id") == "")
    same = F.col("channel") == channel if channel else None
    return table.filter(every(same, open_, one_of("priority", priorities), level, at_most("due_date", due_before), at_least("due_date", due_after), at_least("created_at", created_after), tagged(tags)))


def listed_todos(table: DataFrame, channel: str | None = None, statuses: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Top-level todos by priority rank, newest first within one."""
    rows = todos(table, channel, statuses, completed=True)
    return page(rows, [priority_rank(F.col("priority")), F.desc("created_at"), "id"], 0, limit)


def overdue(table: DataFrame, now: Column, channel: str | None = None) -> DataFrame:
    rows = table.filter(every(F.col("due_date") < now, ~F.col("status").isin("completed", "cancelled"), F.col("channel") == channel if channel else None))
    return rows.orderBy("due_date", "id")


def of_priority(table: DataFrame, priority: str, channel: str | None = None, limit: int | None = None) -> DataFrame:
    rows = table.filter(every(F.col("priority") == priority, ~F.col("status").isin("completed", "cancelled"), F.col("channel") == channel if channel else None))
    return page(rows, [F.desc("created_at"), "id"], 0, limit)


def blocked(table: DataFrame, channel: str | None = None) -> DataFrame:
    return table.filter(every(F.col("status") == "blocked", F.col("channel") == channel if channel else None))


def notes(table: DataFrame, tags: list[str] | None = None, file: str | None = None, author: str | None = None, branch: str | None = None, search: str | None = None, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Notes, newest first; any tag suffices."""
    rows = table.filter(every(any_tag(tags), holds("file", file), same_name("author", author), F.col("branch") == branch if branch else None, mentions(["title", "content"], search)))
    return page(rows, [F.desc("created_at"), "id"], offset, limit)


def decisions(table: DataFrame, statuses: list[str] | None = None, author: str | None = None, search: str | None = None, active: bool = False, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Decisions, newest first; active ones are proposed or accepted."""
    wanted = one_of("status", ["proposed", "accepted"]) if active else one_of("status", statuses)
    rows = table.filter(every(wanted, same_name("author", author), mentions(["title", "context", "decision"], search)))
    return page(rows, [F.desc("created_at"), "id"], offset, limit)


def work_items(table: DataFrame, statuses: list[str] | None = None, priorities: list[str] | None = None, file: str | None = None, assignee: str | None = None, search: str | None = None, due_before=None) -> DataFrame:
    """Todos kept as JSON lines; with due_before those not done and due earlier."""
    late = F.coalesce(F.col("due_date") < F.lit(due_before), F.lit(False)) & ~F.col("status").isin("done", "cancelled") if due_before is not None else None
    rows = table.filter(every(one_of("status", statuses), one_of("priority", priorities), holds("file", file), same_name("assignee", assignee), mentions(["title", "description"], search), late))
    return rows.orderBy(F.desc("created_at"), "id")


def issues(table: DataFrame, statuses: list[str] | None = None, severities: list[str] | None = None, file: str | None = None, search: str | None = None, open_only: bool = False) -> DataFrame:
    """Issues, newest first; open ones are open or investigating."""
    wanted = one_of("status", ["open", "investigating"]) if open_only else one_of("status", statuses)
    rows = table.filter(every(wanted, one_of("severity", severities), holds("file", file), mentions(["title", "description"], search)))
    return rows.orderBy(F.desc("created_at"), "id")


def history(commits: DataFrame, changes: DataFrame, since=None, until=None, authors: list[str] | None = None, paths: list[str] | None = None, kinds: list[str] | None = None, functions: list[str] | None = None) -> DataFrame:
    """All changes of the commits (hash, author, author_email, date) that pass: each kind of test must hold for any of a commit's changes.

    Changes are (commit_hash, file_path, change_type, affected_functions). Tests are
    made before anything is ranked (Q10), in one pass over the changes.
    """
    from quarry.functions.code import matches_glob

    low = [a.lower() for a in authors or []]
    by = some(F.lower("author_email").isin(*low), F.lower("author").isin(*low)) if low else None
    kept = commits.filter(every(at_least("date", since), at_most("date", until), by))
    tests = {
        "p": some(*(matches_glob(F.col("file_path"), p, "history") for p in paths)) if paths else None,
        "k": one_of("change_type", kinds),
        "f": some(*(F.exists("affected_functions", _named(f)) for f in functions)) if functions else None,
    }
    tests = {k: F.coalesce(v, F.lit(False)) for k, v in tests.items() if v is not None}
    if tests:
        passed = changes.groupBy("commit_hash").agg(*(F.bool_or(v).alias(k) for k, v in tests.items())).filter(every(*(F.col(k) for k in tests)))
        kept = kept.join(passed.select(F.col("commit_hash").alias("hash")), "hash", "left_semi")
    return changes.join(kept.select(F.col("hash").alias("commit_hash"), "author", "author_email", "date"), "commit_hash")


def _named(part: str):
    return lambda name: F.lower(name).contains(part.lower())


def refs_to(refs: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    """References to a symbol given as path:name:line or a name: by the id, the name, folder.name, or any name that ends in .name."""
    name, qualified = names_of(symbol)
    hit = some(F.col("to_symbol").isin(*{symbol, name, qualified or name}), F.col("to_symbol").ilike(f"%.{name}"))
    return page(refs.filter(hit), ["id"], 0, limit)


def refs_from(refs: DataFrame, symbol: str, limit: int | None = None) -> DataFrame:
    name, _ = names_of(symbol)
    return page(refs.filter(F.col("from_symbol").isin(*{symbol, name})), ["id"], 0, limit)


def refs_of_kind(refs: DataFrame, kind: str | None = None, internal: bool = False, limit: int | None = None) -> DataFrame:
    return page(refs.filter(every(F.col("kind") == kind if kind else None, ~F.col("is_external") if internal else None)), ["id"], 0, limit)


def names_of(symbol: str) -> tuple[str, str]:
    """(name, folder.name) of path:name:line, "" where there is no folder; an id of another form is its own name."""
    parts = symbol.split(":")
    name = parts[-2] if len(parts) >= 2 else symbol
    folders = [f for f in ":".join(parts[:-2]).split("/")[:-1] if f not in ("", ".")]
    return name, f"{folders[-1]}.{name}" if folders else ""
