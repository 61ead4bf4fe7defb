"""Records that change their state: decay, transitions, severities, sampling, routes, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def decayed(confidence: Column, created: Column, now: Column, half_life_days: float) -> Column:
    """Confidence halved for every half-life since creation; 0.01 and less stays."""
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(created.cast("timestamp"))) / (86_400e6 * half_life_days)
    return F.when(confidence > 0.01, confidence * F.exp(-0.693147 * age)).otherwise(confidence)


def with_status(todos: DataFrame, status: Column, now: Column) -> DataFrame:
    """Todos (status, started_at, completed_at, updated_at) moved to a status: the first start stays, an end holds while completed."""
    return todos.withColumn("__s", status).select(
        *(c for c in todos.columns if c not in ("status", "started_at", "completed_at", "updated_at")),
        F.col("__s").alias("status"), F.coalesce("started_at", F.when(F.col("__s") == "in_progress", now)).alias("started_at"), F.when(F.col("__s") == "completed", now).alias("completed_at"), now.alias("updated_at"),
    )


def severity(labels: Column) -> Column:
    """critical, major or minor by an issue's labels; null labels are none."""
    any_of = lambda *names: F.coalesce(F.exists(labels, lambda x: F.lower(x).isin(*names)), F.lit(False))
    return F.when(any_of("critical", "urgent", "p0"), "critical").when(any_of("major", "high", "p1"), "major").otherwise("minor")


def is_sampled(commit_hash: Column, age_days: Column, tagged: Column, merge: Column, rate: float) -> Column:
    """Whether a commit is indexed: all of 30 days; tags, merges and a share by hash of a year; older ones with tags."""
    codes = F.aggregate(F.split(commit_hash, ""), F.lit(0), lambda acc, x: acc + F.ascii(x))
    return F.when(age_days <= 30, F.lit(True)).when(age_days <= 365, tagged | merge | (F.pmod(codes, F.lit(100)) < rate * 100)).otherwise(tagged)


def routes(requests: DataFrame, id_col: str, text_col: str, keywords: dict[str, list[str]], most: int = 3) -> DataFrame:
    """(id, tool, score, rank): tools by the summed length of their keywords that a request contains, best first."""
    low = F.lower(text_col)
    scores = [F.struct(F.lit(tool).alias("tool"), sum((F.when(low.contains(w), len(w)).otherwise(0) for w in words), F.lit(0)).cast("long").alias("score")) for tool, words in keywords.items()]
    best = F.slice(F.sort_array(F.transform(F.filter(F.array(*scores), lambda s: s["score"] > 0), lambda s: F.struct((-s["score"]).alias("less"), s["tool"].alias("tool")))), 1, most)
    rows = requests.select(F.col(id_col), F.posexplode(best).alias("at", "b"))
    return rows.select(id_col, F.col("b.tool").alias("tool"), (-F.col("b.less")).alias("score"), (F.col("at") + 1).cast("long").alias("rank"))


def regression_candidates(commits: DataFrame, changes: DataFrame, description: str, limit: int | None = 20) -> DataFrame:
    """(hash, score) of commits (hash, message, date) most likely to have brought what is described.

    Each word counts 0.2 in the message, 0.3 for every changed function with it and
    0.1 for every diff with it, of changes (hash, functions, diff); up to 0.2 goes
    by the commit's place in the range, as it is sorted newest first.
    """
    words = description.lower().split()
    hits = lambda text, each: sum((F.when(F.lower(text).contains(w), each).otherwise(0.0) for w in words), F.lit(0.0))
    of_change = F.aggregate(F.coalesce("functions", F.array().cast("array<string>")), F.lit(0.0), lambda acc, f: acc + F.coalesce(hits(f, 0.3), F.lit(0.0))) + hits(F.coalesce("diff", F.lit("")), 0.1)
    summed = changes.withColumn("__hits", of_change).groupBy("hash").agg(F.sum("__hits").alias("__hits"))
    # a commit's place: those of later days, which are counted by day, and those before it on its own
    dated = commits.select("hash", "date", F.to_date("date").alias("__d"))
    days = dated.groupBy("__d").agg(F.count("*").alias("__n")).withColumn("__later", F.sum("__n").over(W.orderBy(F.desc("__d"))) - F.col("__n"))
    placed = dated.join(days, "__d").withColumn("__at", F.col("__later") + F.row_number().over(W.partitionBy("__d").orderBy(F.desc("date"), "hash")) - 1)
    total = commits.count()
    bonus = F.col("__at") / total * 0.2 if total > 1 else F.lit(0.0)
    rows = commits.join(placed.select("hash", "__at"), "hash").join(summed, "hash", "left")
    rows = rows.select("hash", (hits(F.coalesce("message", F.lit("")), 0.2) + F.coalesce("__hits", F.lit(0.0)) + bonus).alias("score")).filter("score > 0")
    return rows if limit is None else rows.orderBy(F.desc("score"), "hash").limit(limit)


def directories(files: DataFrame, path: Column, indexed: Column) -> DataFrame:
    """(dir, files, indexed) for every folder above a file, at any depth."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rows = files.select(F.explode(F.when(F.size(parts) > 1, above)).alias("dir"), indexed.alias("__i"))
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.count_if("__i").alias("indexed"))


def project_counts(notes: DataFrame, decisions: DataFrame, todos: DataFrame, issues: DataFrame) -> DataFrame:
    """One row: notes, decisions, todos, pending_todos, issues, open_issues."""
    parts = [
        notes.agg(F.count("*").alias("notes")), decisions.agg(F.count("*").alias("decisions")), todos.agg(F.count("*").alias("todos"), F.count_if(F.col("status") == "pending").alias("pending_todos")),
        issues.agg(F.count("*").alias("issues"), F.count_if(F.col("status").isin("open", "investigating")).alias("open_issues")),
    ]
    out = parts[0]
    for p in parts[1:]:  # one row each
        out = out.join(F.broadcast(p))
    return out


def project_summary(notes: DataFrame, todos: DataFrame, issues: DataFrame, most: int = 5) -> DataFrame:
    """(topic, id, title): the last notes, the todos of high rank that aren't done, and the critical issues that are open."""
    last = notes.orderBy(F.desc("created_at"), "id").limit(most).select(F.lit("note").alias("topic"), "id", "title")
    high = todos.filter(F.col("priority").isin("urgent", "high") & ~F.col("status").isin("done", "cancelled")).orderBy(F.desc("created_at"), "id").limit(most).select(F.lit("todo").alias("topic"), "id", "title")
    bad = issues.filter(F.col("status").isin("open", "investigating") & (F.col("severity") == "critical")).orderBy(F.desc("created_at"), "id").limit(most).select(F.lit("issue").alias("topic"), "id", "title")
    return last.unionByName(high).unionByName(bad)


def index_state(chunks: Column, indexed_at: Column, now: Column, hours: int = 24) -> Column:
    """missing without chunks, stale if indexed more than some hours ago, else ready."""
    return F.when(chunks == 0, "missing").when(F.unix_micros(now) - F.unix_micros(indexed_at) > hours * 3_600_000_000, "stale").otherwise("ready")


#: What to do by state: a condition over the columns of a one-row table, and the action's name.
ACTIONS = (("index_state = 'missing'", "index"), ("index_state = 'stale'", "update_index"), ("conflicts > 0", "resolve_conflicts"), ("dirty > 0", "commit"), ("open_issues > 0", "review_issues"), ("pending_todos > 0", "work_on_todos"))


def suggested_actions(state: DataFrame) -> DataFrame:
    """(place, action) for a one-row table (index_state, conflicts, dirty, open_issues, pending_todos)."""
    hits = F.array_compact(F.array(*(F.when(F.expr(c), F.lit(a)) for c, a in ACTIONS)))
    return state.select(F.posexplode(hits).alias("place", "action"))


def issue_rows(found: DataFrame) -> DataFrame:
    """Issues (number, title, body, labels, state, author, url) of a tracker as issue records: id, title, description, severity, status."""
    parts = F.array_compact(F.array(F.nullif(F.col("body"), F.lit("")), F.concat(F.lit("Labels: "), F.nullif(F.array_join("labels", ", "), F.lit(""))), F.concat(F.lit("Author: "), "author"), F.concat(F.lit("URL: "), "url")))
    return found.select(
        F.concat(F.lit("gh-"), F.col("number").cast("string")).alias("id"), F.concat(F.lit("[#"), F.col("number").cast("string"), F.lit("] "), "title").alias("title"), F.array_join(parts, "\n").alias("description"), severity(F.col("labels")).alias("severity"),
        F.when(F.lower("state") == "closed", "resolved").otherwise("open").alias("status"),
    )


#: Columns of what a tracker's command line prints as JSON.
TRACKED = "array<struct<number:long,title:string,body:string,state:string,url:string,author:struct<login:string>,labels:array<struct<name:string>>>>"


def tracked_issues(printed: DataFrame, text: str = "json") -> DataFrame:
    """Issues or pull requests of a tracker's JSON listings, a listing a row; unreadable listings give none."""
    rows = printed.select(F.explode(F.from_json(text, TRACKED)).alias("i"))
    names = F.transform("i.labels", lambda x: x["name"])
    return rows.select("i.number", "i.title", "i.body", "i.state", "i.url", F.col("i.author.login").alias("author"), F.coalesce(names, F.array().cast("array<string>")).alias("labels"))
