"""Named queries over record tables: filters, orders, changes, recall, merges; each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.operators import filters, merge, search, stores
from quarry.plans.catalogue import query, r6
from quarry.plans.shapes import NOW, made, twin

EVENT_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
RANK = "CASE priority WHEN 'urgent' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def now(text: str = NOW):
    return F.expr(text.replace("TIMESTAMP", "TIMESTAMP_NTZ"))


@query(f"SELECT id, category, importance FROM {twin('memories')} WHERE channel = 'u1' AND category IN ('click', 'view') AND importance >= 0.05 AND (expires_at IS NULL OR expires_at > {EVENT_NOW}) AND created_at >= TIMESTAMP '2024-01-05' AND len(list_filter(tags, lambda x: contains(lower(x), 'k'))) > 0")
def memory_filter(t) -> DataFrame:
    return filters.memories(made(t, "memories"), now(EVENT_NOW), "u1", ["click", "view"], 0.05, created_after=F.expr("TIMESTAMP_NTZ '2024-01-05'"), tags=["K"]).select("id", "category", "importance")


@query(f"SELECT id, status, priority FROM {twin('todos')} WHERE channel = 'c1' AND status NOT IN ('completed', 'cancelled') AND priority IN ('urgent', 'low') AND parent_id IS NULL AND due_date <= {NOW} AND len(list_filter(tags, lambda x: contains(lower(x), 'ship'))) > 0")
def todo_filter(t) -> DataFrame:
    return filters.todos(made(t, "todos"), "c1", priorities=["urgent", "low"], due_before=now(), tags=["ship"]).select("id", "status", "priority")


@query(f"SELECT id, priority, created_at FROM {twin('todos')} WHERE channel = 'c2' AND parent_id IS NULL ORDER BY {RANK}, created_at DESC, id LIMIT 50")
def todo_list(t) -> DataFrame:
    return filters.listed_todos(made(t, "todos"), "c2", limit=50).select("id", "priority", "created_at")


@query(f"SELECT id, due_date FROM {twin('todos')} WHERE due_date < {NOW} AND status NOT IN ('completed', 'cancelled')")
def todo_overdue(t) -> DataFrame:
    return filters.overdue(made(t, "todos"), now()).select("id", "due_date")


@query(f"SELECT id FROM {twin('todos')} WHERE priority = 'high' AND status NOT IN ('completed', 'cancelled') ORDER BY created_at DESC, id LIMIT 30")
def todo_by_priority(t) -> DataFrame:
    return filters.of_priority(made(t, "todos"), "high", limit=30).select("id")


@query(f"SELECT id FROM {twin('todos')} WHERE status = 'blocked' AND channel = 'c0'")
def todo_blocked(t) -> DataFrame:
    return filters.blocked(made(t, "todos"), "c0").select("id")


@query(f"SELECT id, score FROM (SELECT id, round(1.0 + CASE priority WHEN 'urgent' THEN 0.4 WHEN 'high' THEN 0.2 WHEN 'medium' THEN 0.1 ELSE 0 END + coalesce(CASE WHEN due_date < {NOW} THEN 0.5 WHEN due_date < {NOW} + INTERVAL 1 DAY THEN 0.3 WHEN due_date < {NOW} + INTERVAL 7 DAY THEN 0.1 END, 0), 6)::DOUBLE AS score FROM {twin('todos')} WHERE parent_id IS NULL AND status NOT IN ('completed', 'cancelled')) ORDER BY score DESC, id LIMIT 40")
def todo_search(t) -> DataFrame:
    return search.ranked_todos(filters.todos(made(t, "todos")), now(), 40).select("id", r6("score").alias("score"))


@query(f"SELECT p.id, count(*) AS children, arg_min(c.id, ({RANK.replace('priority', 'c.priority')}, -epoch_us(c.created_at), c.id)) AS first_child FROM {twin('todos')} p JOIN {twin('todos')} c ON c.parent_id = p.id GROUP BY p.id")
def todo_children(t) -> DataFrame:
    rows = stores.with_children(made(t, "todos")).filter("children is not null")
    return rows.select("id", F.size("children").cast("long").alias("children"), F.col("children")[0]["id"].alias("first_child"))


@query(f"SELECT id, channel FROM (SELECT * FROM {twin('todos')} WHERE id <> 't5' AND (parent_id IS NULL OR parent_id <> 't5')) WHERE channel = 'c1'")
def todo_delete(t) -> DataFrame:
    return stores.without_todo(made(t, "todos"), "t5").filter("channel = 'c1'").select("id", "channel")


@query(f"SELECT id, CASE WHEN id = 't7' THEN 'moved' ELSE channel END AS channel FROM {twin('todos')}")
def todo_move(t) -> DataFrame:
    return stores.moved(made(t, "todos").withColumn("updated_at", F.col("created_at")), "t7", "moved", now()).select("id", "channel")


@query(f"SELECT id, title FROM {twin('notes')} WHERE len(list_filter(tags, lambda x: lower(x) IN ('user', 't3'))) > 0 AND contains(file, 'src/') AND lower(author) = 'ai' AND branch = 'main' AND (contains(lower(title), 'la') OR contains(lower(content), 'la')) ORDER BY created_at DESC, id LIMIT 25 OFFSET 2")
def notes_page(t) -> DataFrame:
    return filters.notes(made(t, "notes"), ["User", "T3"], "src/", "ai", "main", "LA", 2, 25).select("id", "title")


@query(f"SELECT id, status FROM {twin('decisions')} WHERE status IN ('proposed', 'accepted') AND lower(author) = 'ann' AND (contains(lower(title), 'ring') OR contains(lower(context), 'ring') OR contains(lower(decision), 'ring'))")
def decisions_filter(t) -> DataFrame:
    return filters.decisions(made(t, "decisions"), author="ANN", search="Ring", active=True).select("id", "status")


@query(f"SELECT id, status, priority FROM {twin('work_items')} WHERE status = 'pending' AND priority IN ('urgent', 'high') AND contains(file, '.py') AND lower(assignee) = 'bob' AND due_date < {NOW}")
def work_items_overdue(t) -> DataFrame:
    return filters.work_items(made(t, "work_items"), ["pending"], ["urgent", "high"], ".py", "BOB", due_before=now()).select("id", "status", "priority")


@query(f"SELECT id, severity, status FROM {twin('issues')} WHERE status IN ('open', 'investigating') AND severity = 'critical' AND contains(file, 'f1') AND contains(lower(description), 'part 1')")
def issues_open(t) -> DataFrame:
    return filters.issues(made(t, "issues"), severities=["critical"], file="f1", search="Part 1", open_only=True).select("id", "severity", "status")


@query(f"SELECT g.id, g.commit_hash, c.author FROM {twin('changes')} g JOIN {twin('commits')} c ON c.hash = g.commit_hash WHERE c.date >= TIMESTAMP '1997-01-01' AND c.date <= TIMESTAMP '1999-01-01' AND (lower(c.author_email) IN ('a7@x.org', 'author 9') OR lower(c.author) IN ('a7@x.org', 'author 9')) AND c.hash IN (SELECT commit_hash FROM {twin('changes')} GROUP BY 1 HAVING bool_or(contains(file_path, 'src/d1')) AND bool_or(change_type = 'A') AND bool_or(len(list_filter(affected_functions, lambda x: contains(lower(x), 'open'))) > 0))")
def history_filter(t) -> DataFrame:
    return filters.history(made(t, "commits"), made(t, "changes"), F.expr("TIMESTAMP_NTZ '1997-01-01'"), F.expr("TIMESTAMP_NTZ '1999-01-01'"), ["A7@x.org", "author 9"], ["src/d1*"], ["A"], ["open"]).select("id", "commit_hash", "author")


@query(f"WITH r AS (SELECT g.id, round(CASE WHEN contains(c.message, 'urgent') THEN 0.4 ELSE 0 END + CASE WHEN g.change_type = 'D' THEN 0.4 ELSE 0 END + 0.2 * exp(-epoch({NOW} - c.date) / 3600.0 / (24.0 * 60 * 6.931471805599453e-1)), 6)::DOUBLE AS score, contains(c.message, 'urgent') OR g.change_type = 'D' AS hit FROM {twin('changes')} g JOIN {twin('commits')} c ON c.hash = g.commit_hash) SELECT id, score FROM r WHERE hit ORDER BY score DESC, id LIMIT 50")
def history_ranked(t) -> DataFrame:
    commits, changes = made(t, "commits"), made(t, "changes")
    rows = changes.join(commits.select(F.col("hash").alias("commit_hash"), "date"), "commit_hash")
    hits = search.history_hits(rows, commits.filter(F.col("message").contains("urgent")), changes.filter("change_type = 'D'"), now(), None, 0.5)
    return hits.select("id", r6("score").alias("score")).orderBy(F.desc("score"), "id").limit(50)


@query(f"SELECT b.file_path, max(c.date) AS last FROM {twin('changes')} b JOIN {twin('commits')} c ON c.hash = b.commit_hash WHERE c.date >= TIMESTAMP '2001-07-01' GROUP BY 1")
def recent_files(t) -> DataFrame:
    from quarry.sources.git import recent_files as recent

    rows = made(t, "changes").join(made(t, "commits").select(F.col("hash").alias("commit_hash"), "date"), "commit_hash")
    return recent(rows, F.expr("TIMESTAMP_NTZ '2001-07-01'"))


@query(f"SELECT hash, author, date FROM {twin('commits')} WHERE hash IN (SELECT commit_hash FROM {twin('changes')} WHERE file_path = 'src/d3/f7.go') ORDER BY date DESC, hash LIMIT 20")
def file_history(t) -> DataFrame:
    from quarry.sources.git import file_history as of_file

    return of_file(made(t, "commits"), made(t, "changes"), "src/d3/f7.go", 20).select("hash", "author", "date")


@query(f"SELECT id, round(0.5 * 0.25 + 0.2 * exp(-epoch({EVENT_NOW} - coalesce(accessed_at, created_at)) / 3600.0 / (720.0 * 6.931471805599453e-1)) + 0.2 * importance * confidence + 0.1 * least(1.0, log10(access_count + 1) / 3), 6) AS score FROM {twin('memories')} WHERE category = 'error'")
def memory_search(t) -> DataFrame:
    rows = made(t, "memories")
    hits = rows.filter("category = 'error'").select("id", F.lit(0.25).alias("vector_score"))
    return search.recall(rows, hits, now(EVENT_NOW), None).select("id", r6("score").alias("score"))


@query("WITH v AS (SELECT vec_id AS id, 0.5 AS score FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS id, label + 1.0 AS bm25 FROM embeddings WHERE vec_id % 3 = 0) SELECT id, round(CASE WHEN score IS NOT NULL AND bm25 IS NOT NULL THEN (score + bm25 / (1 + bm25)) / 2 ELSE coalesce(score, bm25 / (1 + bm25)) END, 6)::DOUBLE AS vector_score FROM v FULL JOIN b USING (id)")
def averaged_scores(t) -> DataFrame:
    e = t("embeddings")
    near = e.filter("vec_id % 2 = 0").select(F.col("vec_id").alias("id"), F.lit(0.5).alias("score"))
    text = e.filter("vec_id % 3 = 0").select(F.col("vec_id").alias("id"), (F.col("label") + 1.0).alias("bm25"))
    return search.averaged(near, text).withColumn("vector_score", r6("vector_score"))


@query(f"SELECT id, access_count + CASE WHEN category = 'view' THEN 1 ELSE 0 END AS access_count, CASE WHEN category = 'view' THEN {EVENT_NOW} ELSE accessed_at END AS accessed_at FROM {twin('memories')}")
def memory_touch(t) -> DataFrame:
    m = made(t, "memories")
    return stores.touched(m, m.filter("category = 'view'"), now(EVENT_NOW)).select("id", "access_count", "accessed_at")


@query(f"SELECT id, category, coalesce(accessed_at, created_at) AS accessed_at, CASE WHEN id IN (SELECT id FROM {twin('memories')} WHERE channel = 'u1') THEN {EVENT_NOW} ELSE created_at END AS updated_at FROM (SELECT id, category, accessed_at, created_at FROM {twin('memories')} WHERE channel IN ('u1', 'u2'))")
def memory_upsert(t) -> DataFrame:
    m = made(t, "memories").withColumn("updated_at", F.col("created_at"))
    new = m.filter("channel in ('u1', 'u2')").withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return stores.put_memories(m.filter("channel = 'u1'"), new, now(EVENT_NOW)).select("id", "category", "accessed_at", "updated_at")


@query(f"SELECT id FROM {twin('memories')} WHERE channel <> 'u3' AND id <> 'm1'")
def memory_delete(t) -> DataFrame:
    return stores.removed(stores.removed(made(t, "memories"), F.col("id") == "m1"), F.col("channel") == "u3").select("id")


@query(f"SELECT count(*) AS pruned FROM {twin('memories')} WHERE expires_at < {EVENT_NOW}")
def memory_pruned(t) -> DataFrame:
    return stores.pruned(made(t, "memories"), now(EVENT_NOW))[1]


@query(f"SELECT s.id, coalesce(n, 0) AS memory_count FROM {twin('sessions')} s LEFT JOIN (SELECT session_id, count(*) AS n FROM {twin('memories')} GROUP BY 1) m ON m.session_id = s.id WHERE s.ended_at IS NULL")
def sessions_active(t) -> DataFrame:
    return stores.sessions_with_counts(stores.active_sessions(made(t, "sessions")), made(t, "memories")).select("id", "memory_count")


@query(f"SELECT id, coalesce(ended_at, CASE WHEN agent = 'HOUSEHOLD' THEN {EVENT_NOW} END) AS ended_at FROM {twin('sessions')}")
def sessions_end(t) -> DataFrame:
    return stores.ended(made(t, "sessions"), F.when(F.col("agent") == "HOUSEHOLD", F.col("id")), now(EVENT_NOW)).select("id", "ended_at")


@query(f"SELECT id FROM {twin('memories')} WHERE channel <> 'u2' OR category <> 'click'")
def checkpoint_restored(t) -> DataFrame:
    m = made(t, "memories")
    saved = stores.checkpoint(m.filter("category <> 'click'"), F.lit("before"), F.lit("u2"), now(EVENT_NOW))
    return stores.restored(m, saved).select("id")


@query(f"SELECT channel, count(*) AS memories, min(id) AS first_id FROM {twin('memories')} WHERE channel = 'u4' GROUP BY 1")
def checkpoint_create(t) -> DataFrame:
    saved = stores.checkpoint(made(t, "memories"), F.lit("all"), F.lit("u4"), now(EVENT_NOW))
    return saved.select("channel", F.size("memory_ids").cast("long").alias("memories"), F.col("memory_ids")[0].alias("first_id"))


@query(f"SELECT id, title, CASE WHEN id LIKE 'd1%' THEN 'accepted' ELSE status END AS status, CASE WHEN id LIKE 'd1%' THEN {NOW} ELSE updated_at END AS updated_at FROM {twin('decisions')}")
def decisions_accept(t) -> DataFrame:
    d = made(t, "decisions")
    changes = d.filter("id like 'd1%'").select("id", F.lit("accepted").alias("status"), F.lit(None).cast("string").alias("title"))
    return stores.updated(d, changes, now()).select("id", "title", "status", "updated_at")


@query(f"SELECT id, CASE WHEN id = 'd9' THEN 'superseded' ELSE status END AS status, CASE WHEN id = 'd9' THEN 'd10' END AS superseded_by FROM {twin('decisions')}")
def decisions_supersede(t) -> DataFrame:
    return stores.superseded(made(t, "decisions"), "d9", "d10", now()).select("id", "status", "superseded_by")


@query(f"SELECT id, CASE severity WHEN 'critical' THEN 'resolved' WHEN 'major' THEN 'open' ELSE status END AS status, CASE severity WHEN 'critical' THEN coalesce(resolved_at, {NOW}) WHEN 'major' THEN NULL ELSE resolved_at END AS resolved_at FROM {twin('issues')}")
def issues_transition(t) -> DataFrame:
    to = F.when(F.col("severity") == "critical", "resolved").when(F.col("severity") == "major", "open")
    return stores.moved_to(made(t, "issues"), to, now(), "resolved_at", "resolved").select("id", "status", "resolved_at")


@query(f"SELECT id, title, author, content FROM {twin('notes')} WHERE branch = 'dev' UNION ALL SELECT concat('x', id), title, 'ai', content FROM {twin('notes')} WHERE branch = 'main' AND trim(content) <> ''")
def notes_add(t) -> DataFrame:
    n = made(t, "notes").withColumn("updated_at", F.col("created_at"))
    new = n.filter("branch = 'main'").select(F.concat(F.lit("x"), "id").alias("id"), "title", "content", F.lit("").alias("author"))
    return stores.added(n.filter("branch = 'dev'"), new, ["title", "content"], now(), {"author": "ai"}).select("id", "title", "author", "content")


@query(f"WITH b AS (SELECT id, title, content, file, tags FROM {twin('notes')} WHERE branch = 'main' OR id LIKE '%2'), o AS (SELECT id, CASE WHEN id LIKE '%0' THEN upper(title) ELSE title END AS title, content, file, tags FROM {twin('notes')} WHERE id NOT LIKE '%3'), h AS (SELECT id, title, CASE WHEN id LIKE 'n1%' THEN '-' ELSE content END AS content, file, split('z,' || author, ',') AS tags FROM {twin('notes')} WHERE id NOT LIKE '%4'), j AS (SELECT id, b.id IS NOT NULL AS ib, o.id IS NOT NULL AS io, h.id IS NOT NULL AS ih, o.title IS NOT DISTINCT FROM h.title AND o.content IS NOT DISTINCT FROM h.content AND o.file IS NOT DISTINCT FROM h.file AS oh, o.title IS NOT DISTINCT FROM b.title AND o.content IS NOT DISTINCT FROM b.content AS ob, h.title IS NOT DISTINCT FROM b.title AND h.content IS NOT DISTINCT FROM b.content AS hb, o.title AS ot, h.title AS ht, len(list_distinct(list_concat(o.tags, h.tags))) AS united, len(o.tags) AS otags, len(h.tags) AS htags FROM b FULL JOIN o USING (id) FULL JOIN h USING (id)), a AS (SELECT *, CASE WHEN io AND ih THEN CASE WHEN oh THEN 'same' WHEN ib AND ob THEN 'theirs' WHEN ib AND hb THEN 'ours' WHEN ib THEN 'both' ELSE 'ours_added' END WHEN io THEN CASE WHEN NOT ib THEN 'ours' WHEN ob THEN 'deleted' ELSE 'ours_kept' END WHEN ih THEN CASE WHEN NOT ib THEN 'theirs' WHEN hb THEN 'deleted' ELSE 'theirs_kept' END ELSE 'deleted' END AS action FROM j) SELECT id, action, CASE WHEN action IN ('same', 'ours', 'ours_kept', 'ours_added', 'both') THEN ot WHEN action IN ('theirs', 'theirs_kept') THEN ht END AS title, CASE WHEN action = 'both' THEN united WHEN action IN ('same', 'ours', 'ours_kept', 'ours_added') THEN otags WHEN action IN ('theirs', 'theirs_kept') THEN htags END::BIGINT AS n_tags, action IN ('both', 'ours_added', 'ours_kept', 'theirs_kept') AS conflict FROM a")
def merge_note_records(t) -> DataFrame:
    n = made(t, "notes").select("id", "title", "content", "file", "tags", "author", "branch")
    c = F.col("id")
    base = n.filter((F.col("branch") == "main") | c.like("%2"))
    ours = n.filter(~c.like("%3")).withColumn("title", F.when(c.like("%0"), F.upper("title")).otherwise(F.col("title")))
    theirs = n.filter(~c.like("%4")).withColumn("content", F.when(c.like("n1%"), "-").otherwise(F.col("content"))).withColumn("tags", F.array(F.lit("z"), F.col("author")))
    rows = merge.merge_note_records(base, ours, theirs)
    return rows.select("id", "action", "title", F.when(F.col("tags").isNotNull(), F.size("tags")).cast("long").alias("n_tags"), "conflict")


_SIDES = "bb AS (SELECT o_orderkey AS id, {'s': o_orderstatus, 'u': o_orderdate} AS b FROM orders WHERE o_orderkey % 5 <> 0), oo AS (SELECT o_orderkey AS id, {'s': o_orderstatus, 'u': o_orderdate + to_days((o_orderkey % 3)::INT)} AS o FROM orders WHERE o_orderkey % 7 <> 0), tt AS (SELECT o_orderkey AS id, {'s': CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE o_orderstatus END, 'u': o_orderdate + to_days((o_orderkey % 2)::INT)} AS t FROM orders WHERE o_orderkey % 11 <> 0), j AS (SELECT * FROM bb FULL JOIN oo USING (id) FULL JOIN tt USING (id))"


def _three(t) -> list[DataFrame]:
    rows, k = t("orders"), F.col("o_orderkey")
    later = lambda n: F.expr(f"o_orderdate + make_dt_interval(cast(o_orderkey % {n} as int))")
    side = lambda keep, status, updated: rows.filter(keep).select(k.alias("id"), status.alias("status"), updated.alias("updated"))
    status = F.col("o_orderstatus")
    return [side(k % 5 != 0, status, F.col("o_orderdate")), side(k % 7 != 0, status, later(3)), side(k % 11 != 0, F.when(k % 2 == 0, "P").otherwise(status), later(2))]


@query(f"WITH {_SIDES}, p AS (SELECT id, CASE WHEN o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o.u > t.u THEN o ELSE t END WHEN b IS NULL THEN coalesce(o, t) END AS p FROM j) SELECT id, p.s AS status, p.u AS updated FROM p WHERE p IS NOT NULL")
def merge_decisions(t) -> DataFrame:
    return merge.merge_decisions(*_three(t))


@query(f"WITH {_SIDES} SELECT count(*) FILTER (b IS NULL) AS added, count(*) FILTER (b IS NOT NULL AND o IS NOT NULL AND t IS NOT NULL) AS modified, count(*) FILTER (b IS NOT NULL AND (o IS NULL) <> (t IS NULL)) AS deleted FROM j")
def merge_counts(t) -> DataFrame:
    return merge.merge_counts(*_three(t))


@query(f"WITH {_SIDES}, p AS (SELECT id, CASE WHEN o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o.s = 'O' THEN o WHEN t.s = 'O' THEN t WHEN o.u > t.u THEN o ELSE t END WHEN b IS NULL THEN coalesce(o, t) END AS p FROM j) SELECT id, CASE p.s WHEN 'O' THEN 'resolved' ELSE p.s END AS status, p.u AS updated FROM p WHERE p IS NOT NULL")
def merge_issues(t) -> DataFrame:
    as_issues = lambda d: d.withColumn("status", F.when(F.col("status") == "O", "resolved").otherwise(F.col("status")))
    return merge.merge_issues(*map(as_issues, _three(t)))


@query(f"SELECT (SELECT count(*) FROM {twin('notes')}) AS notes, (SELECT count(*) FROM {twin('decisions')}) AS decisions, count(*) AS todos, count(*) FILTER (status = 'pending') AS pending_todos, (SELECT count(*) FROM {twin('issues')}) AS issues, (SELECT count(*) FROM {twin('issues')} WHERE status IN ('open', 'investigating')) AS open_issues FROM {twin('work_items')}")
def project_counts(t) -> DataFrame:
    from quarry.operators.records import project_counts as counts

    return counts(made(t, "notes"), made(t, "decisions"), made(t, "work_items"), made(t, "issues"))


@query("SELECT lang, CASE WHEN count(*) = 0 THEN 'missing' WHEN max(doc_id) < 500 THEN 'stale' ELSE 'ready' END AS state FROM documents GROUP BY lang")
def index_state(t) -> DataFrame:
    from quarry.operators.records import index_state as state

    d = t("documents").groupBy("lang").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    base = F.lit("2024-01-01").cast("timestamp")
    return d.select("lang", state(F.col("n"), base + F.expr("make_dt_interval(0, cast(last as int))"), base + F.expr("make_dt_interval(0, 524)")).alias("state"))


@query(f"SELECT * FROM (SELECT 'note' AS topic, id, title FROM {twin('notes')} ORDER BY created_at DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'todo', id, title FROM {twin('work_items')} WHERE priority IN ('urgent', 'high') AND status NOT IN ('done', 'cancelled') ORDER BY created_at DESC, id LIMIT 5) UNION ALL SELECT * FROM (SELECT 'issue', id, title FROM (SELECT DISTINCT id, title, created_at FROM {twin('issues')} WHERE status IN ('open', 'investigating') AND severity = 'critical') ORDER BY created_at DESC, id LIMIT 5)")
def project_summary(t) -> DataFrame:
    from quarry.operators.records import project_summary as summary

    open_issues = made(t, "issues").dropDuplicates(["id", "title", "created_at", "status", "severity"])
    return summary(made(t, "notes"), made(t, "work_items"), open_issues.filter(F.col("status").isin("open", "investigating")).dropDuplicates(["id", "title", "created_at", "severity"]))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_quantity + l_linenumber BETWEEN 20 AND 30")
def worth_embedding(t) -> DataFrame:
    from quarry.streaming.watch import worth_embedding as worth

    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("additions"), F.col("l_linenumber").alias("deletions"))
    return worth(rows, 20, 30).select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 10 = 3 OR NOT regexp_matches(lower(text), '[\\pL\\pN]')")
def index_health(t) -> DataFrame:
    d = t("documents")
    return search.unindexed(d.select(F.col("doc_id").alias("id")), search.retrieval.postings(d.filter("doc_id % 10 <> 3"), "doc_id", "text"))
