"""Reference graphs: resolution, reachability, dead code, entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quarry.functions import code
from quarry.operators import tables

#: Why a symbol counts as dead.
REASONS = ("no callers found (exported - verify if public API)", "no callers found", "only called by dead code", "unreachable")

#: Nodes of a frontier up to which all executors get it whole: a few MB.
SMALL = 20_000


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node) reachable over edges (src, dst) from roots (node), roots included: a frontier at a time, cycles welcome.

    Edges are made distinct once and kept; each round writes its frontier only,
    and what is seen is the union of the frontiers. Null nodes are passed over.
    """
    return _reached(tables.kept(edges.filter("src <> dst").select("src", "dst").distinct()), roots)


def _reached(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """reachable over edges that are kept already."""
    frontier = tables.kept(roots.filter("node is not null").select("node").distinct())
    seen, n = frontier, frontier.count()
    while True:
        # only a small frontier goes to all executors; what is seen never does
        near = F.broadcast(frontier) if n <= SMALL else frontier.hint("merge")
        step = edges.join(near, edges.src == frontier.node, "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = tables.kept(step.join(seen.hint("merge"), "node", "left_anti"))
        n = frontier.count()
        if not n:
            return seen
        seen = seen.union(frontier)


def dead_confidence(name: Column, exported: Column, method: Column, dead_callers: Column) -> Column:
    """Confidence that an unreachable symbol is dead, 0 to 1."""
    n = F.lower(name)
    score = F.lit(0.85) - F.when(exported, 0.3).otherwise(0.0) - F.when(name.rlike("^(New|Create|Make)"), 0.15).otherwise(0.0) - F.when(method, 0.2).otherwise(0.0)
    score = score + F.when(dead_callers, 0.1).otherwise(0.0) - F.when(n.contains("handler") | n.contains("middleware"), 0.15).otherwise(0.0) - F.when(name.rlike("^[oO]n"), 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def call_graph(symbols: DataFrame, refs: DataFrame, internal_only: bool = False) -> DataFrame:
    """Distinct edges (src, dst) between symbols (id, name, path) that references (id, from_symbol, to_symbol, kind) name, without loops.

    Both ends are resolved by `resolve`. References to other files count unless
    internal_only is set (Q05).
    """
    if internal_only:
        refs = refs.filter(~F.col("is_external"))
    folder = lambda path: F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    names = symbols.select(F.col("id").alias("symbol_id"), "name", folder(F.col("path")).alias("dir"))
    # no folder holds a line break, so one stands for the null folder, which no symbol is near
    rows = refs.select("from_symbol", "to_symbol", F.coalesce(folder(F.col("file_path")), F.lit("\n")).alias("dir")).distinct()
    # each name of a folder is resolved once, however many references name it
    ends = rows.select("dir", F.explode(F.array("from_symbol", "to_symbol")).alias("target")).filter("target is not null").distinct()
    ends = ends.select(F.struct("target", "dir").alias("ref_id"), F.substring_index("target", ".", -1).alias("__short"), "target", "dir")
    found = resolve(ends, names, "__short").select("ref_id.target", "ref_id.dir", "symbol_id")
    end = lambda column, out: found.select(F.col("target").alias(column), "dir", F.col("symbol_id").alias(out)).hint("merge")
    rows = rows.join(end("from_symbol", "src"), ["from_symbol", "dir"]).join(end("to_symbol", "dst"), ["to_symbol", "dir"])
    return rows.filter("src <> dst").select("src", "dst").distinct()


def dead_code(symbols: DataFrame, edges: DataFrame, least: float = 0.5) -> DataFrame:
    """Symbols (id, name, kind, path, language, visibility) that no root reaches and no test holds, with confidence, reason, callers and dead_callers.

    All are judged before any limit is taken (Q16).
    """
    edges = tables.kept(edges)
    live = _reached(edges, symbols.filter(code.is_root(F.col("name"), F.col("language"), F.col("path"))).select(F.col("id").alias("node")))
    marked = edges.join(live.select(F.col("node").alias("src"), F.lit(True).alias("__live")).hint("merge"), "src", "left")
    callers = marked.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"), F.count_if(F.col("__live").isNull()).alias("dead_callers"))
    rows = symbols.join(live.select(F.col("node").alias("id")).hint("merge"), "id", "left_anti").filter(~code.is_test(F.col("name"), F.col("language"), F.col("path")))
    rows = rows.join(callers.hint("merge"), "id", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("callers", "dead_callers")})
    exported = code.is_exported(F.col("name"), F.col("language"), F.col("visibility"))
    method = (F.col("kind") == "method") & code.serves_interfaces(F.col("language"))
    only_dead = (F.col("callers") > 0) & (F.col("callers") == F.col("dead_callers"))
    reason = F.when((F.col("callers") == 0) & exported, REASONS[0]).when(F.col("callers") == 0, REASONS[1]).when(only_dead, REASONS[2]).otherwise(REASONS[3])
    scored = rows.select("id", "name", "kind", "path", F.round(dead_confidence(F.col("name"), exported, method, only_dead), 6).alias("confidence"), reason.alias("reason"), "callers", "dead_callers")
    return scored.filter(F.col("confidence") >= least)


def dead_functions(dead: DataFrame, limit: int | None = None) -> DataFrame:
    rows = dead.filter(F.col("kind").isin("function", "method")).orderBy(F.desc("confidence"), "id")
    return rows if limit is None else rows.limit(limit)


def unused_types(dead: DataFrame, limit: int | None = None) -> DataFrame:
    rows = dead.filter(F.col("kind").isin("type", "interface")).orderBy(F.desc("confidence"), "id")
    return rows if limit is None else rows.limit(limit)


def graph_stats(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: symbols, entry_points, reachable, dead, edges."""
    roots = symbols.filter(code.is_root(F.col("name"), F.col("language"), F.col("path"))).select(F.col("id").alias("node"))
    edges = tables.kept(edges)
    live = _reached(edges, roots).join(symbols.select(F.col("id").alias("node")).hint("merge"), "node", "left_semi").agg(F.count("*").alias("reachable"))
    one = symbols.agg(F.count("*").alias("symbols")).join(F.broadcast(roots.agg(F.count("*").alias("entry_points")))).join(F.broadcast(live)).join(F.broadcast(edges.agg(F.count("*").alias("edges"))))  # one row each
    return one.select("symbols", "entry_points", "reachable", (F.col("symbols") - F.col("reachable")).alias("dead"), "edges")


def entry_points(symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, name, type, confidence) of functions; one that fits several types comes once for each."""
    name = F.col("name")
    types = [("main", 1.0, name == "main"), ("test", 1.0, name.startswith("Test")), ("init", 1.0, name == "init")]
    types += [("handler", 0.8, name.contains(p)) for p in ("Handle", "ServeHTTP", "Handler")] + [("cli", 0.6, name.contains(p)) for p in ("Execute", "Run", "Cmd")]
    found = F.filter(F.array(*(F.when(hit, F.struct(F.lit(kind).alias("type"), F.lit(c).alias("confidence"))) for kind, c, hit in types)), lambda x: x.isNotNull())
    rows = symbols.filter("kind = 'function'").select("id", "name", F.explode(found).alias("t")).select("id", "name", "t.type", "t.confidence").orderBy(F.desc("confidence"), "id", "type")
    return rows if limit is None else rows.limit(limit)


def complexity_candidates(symbols: DataFrame, least_lines: int = 30, limit: int | None = None) -> DataFrame:
    """Long functions with complexity and nesting as their lines let them be guessed."""
    n = F.col("line_count")
    rows = symbols.filter(F.col("kind").isin("function", "method") & (n >= least_lines)).select("id", "name", "line_count", F.floor(n / 5).cast("long").alias("complexity"), F.when(n > 100, 4).when(n > 50, 3).otherwise(2).cast("long").alias("nesting"))
    rows = rows.orderBy(F.desc("line_count"), "id")
    return rows if limit is None else rows.limit(limit)


def refactoring_report(symbols: DataFrame, dead: DataFrame, least_lines: int = 50) -> DataFrame:
    """(topic, id, name, value): long functions, likely complex ones, and dead ones, one after the other."""
    long_ = symbols.filter(F.col("kind").isin("function", "method") & (F.col("line_count") >= least_lines)).select(F.lit("long").alias("topic"), "id", "name", F.col("line_count").cast("double").alias("value"))
    hard = complexity_candidates(symbols).select(F.lit("complex").alias("topic"), "id", "name", F.col("complexity").cast("double").alias("value"))
    gone = dead.filter(F.col("kind").isin("function", "method")).select(F.lit("dead").alias("topic"), "id", "name", F.col("confidence").alias("value"))
    return long_.unionByName(hard).unionByName(gone)


def resolve(refs: DataFrame, symbols: DataFrame, name: str = "target") -> DataFrame:
    """(ref_id, symbol_id) of refs (ref_id, target, dir): exact id first, then the name in the same directory, then the first id of that name.

    `name` is the column of refs that holds the name where the target isn't it.

    Names are reduced to one symbol before they are joined, so a common name makes no pairs.
    """
    first = F.min("symbol_id")
    near = symbols.groupBy(F.col("name").alias(name), "dir").agg(first.alias("near"))
    far = symbols.groupBy(F.col("name").alias(name)).agg(first.alias("far"))
    exact = symbols.select(F.col("symbol_id").alias("target"), F.col("symbol_id").alias("exact")).distinct()
    rows = refs.join(exact.hint("merge"), "target", "left").join(near.hint("merge"), [name, "dir"], "left").join(far.hint("merge"), name, "left")
    return rows.select("ref_id", F.coalesce("exact", "near", "far").alias("symbol_id")).filter("symbol_id is not null")


def latest(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Keep-last upsert: one row for each key, the last in order."""
    n = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    return rows.withColumn("__n", n).filter("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new in place of those of old with their key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)
