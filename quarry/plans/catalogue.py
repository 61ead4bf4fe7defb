"""Named queries over the test tables, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions.code import decision_points, matches_glob, rating
from quarry.operators import chunking, code, graph, merge, records, retrieval, tables
from quarry.sources import history
from quarry.sources.files import spread
from quarry.streaming.debounce import debounced

QUERIES, ORACLES = {}, {}
#: Tables whose rows take long each.
TEXTS = ("documents", "pages")
NOW, THEN = "2024-01-31 00:00:00", "2001-12-01 00:00:00"
WORDS = r"regexp_extract_all(lower(text), '[\pL\pN]+')"


def query(sql: str | None):
    def add(f):
        def read(spark, sf_dir):
            whole = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
            return lambda t: spread(whole(t)) if t in TEXTS else whole(t)

        QUERIES[f.__name__] = lambda spark, sf_dir: f(read(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c):
    return F.round(c, 6)


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(t) -> DataFrame:
    e = t("embeddings")
    return retrieval.vector_topk(e, e.filter("vec_id = 0").first()["embedding"], 10).withColumn("score", r6("score"))


@query("WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, q WHERE label IN (1, 2) ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(t) -> DataFrame:
    e = t("embeddings")
    return retrieval.vector_topk(e, e.filter("vec_id = 0").first()["embedding"], 10, where=F.col("label").isin(1, 2)).withColumn("score", r6("score"))


def _bm25_sql(terms, mode):
    tf = [f"len(list_filter(ts, lambda x: x = '{w}'))" for w in terms]
    cols = ", ".join(f"{x} AS f{i}" for i, x in enumerate(tf))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((nd - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / an))" for i in range(len(terms)))
    cond = (" AND " if mode == "and" else " OR ").join(f"f{i} > 0" for i in range(len(terms)))
    return f"WITH a AS (SELECT doc_id, {WORDS} AS ts FROM documents), b AS (SELECT doc_id AS id, len(ts) AS n, {cols} FROM a), s AS (SELECT count(*)::DOUBLE AS nd, avg(n) AS an, {dfs} FROM b) SELECT id, round({score}, 6) AS bm25 FROM b, s WHERE {cond} ORDER BY {score} DESC, id LIMIT 20"


@query(_bm25_sql(["reed", "onre"], "and"))
def bm25_and(t) -> DataFrame:
    return retrieval.bm25(t("documents"), ["reed", "onre"], 20).withColumn("bm25", r6("bm25"))


@query(_bm25_sql(["reed", "ention"], "or"))
def bm25_or(t) -> DataFrame:
    return retrieval.bm25(t("documents"), ["reed", "ention"], 20, "or").withColumn("bm25", r6("bm25"))


@query("SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(" + WORDS + ") AS term FROM documents) GROUP BY ALL) GROUP BY term")
def postings_stats(t) -> DataFrame:
    return retrieval.postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query("WITH x AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents), y AS (SELECT id, unnest(ls) AS content, generate_subscripts(ls, 1)::BIGINT AS line FROM x) SELECT id, line, content FROM y WHERE regexp_matches(content, '(?i)licen[cs]ed? under')")
def grep_lines(t) -> DataFrame:
    return retrieval.line_matches(t("documents"), "licen[cs]ed? under")


@query("WITH x AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents), y AS (SELECT id, unnest(ls) AS content, generate_subscripts(ls, 1)::BIGINT AS line FROM x) SELECT id, line, content FROM y WHERE contains(content, 'License')")
def grep_literal(t) -> DataFrame:
    return retrieval.line_matches(t("documents"), "License", literal=True, ignore_case=False)


@query("SELECT p_type, p_partkey, levenshtein(p_name, 'blue part')::BIGINT AS distance FROM part WHERE levenshtein(p_name, 'blue part') <= 6")
def levenshtein_similar(t) -> DataFrame:
    d = F.levenshtein("p_name", F.lit("blue part")).cast("long")
    return t("part").filter(d <= 6).select("p_type", "p_partkey", d.alias("distance"))


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name ILIKE '%RIN%' AND p_size >= 30 ORDER BY p_size DESC, p_partkey LIMIT 50")
def find_symbols(t) -> DataFrame:
    return t("part").filter(F.col("p_name").ilike("%RIN%") & (F.col("p_size") >= 30)).select("p_partkey", "p_name", "p_size").orderBy(F.desc("p_size"), "p_partkey").limit(50)


@query("SELECT p_partkey, (p_size // 5)::BIGINT AS complexity, CASE WHEN p_size > 40 THEN 4 WHEN p_size > 35 THEN 3 ELSE 2 END::BIGINT AS nesting FROM part WHERE p_size >= 30")
def complexity_candidates(t) -> DataFrame:
    n = F.when(F.col("p_size") > 40, 4).when(F.col("p_size") > 35, 3).otherwise(2)
    return t("part").filter("p_size >= 30").select("p_partkey", F.floor(F.col("p_size") / 5).cast("long").alias("complexity"), n.cast("long").alias("nesting"))


@query("SELECT l_suppkey AS caller, count(*) AS calls FROM lineitem WHERE l_partkey = 7 GROUP BY 1")
def callers(t) -> DataFrame:
    return t("lineitem").filter("l_partkey = 7").groupBy(F.col("l_suppkey").alias("caller")).agg(F.count("*").alias("calls"))


@query("SELECT l_partkey AS callee, count(*) AS calls FROM lineitem WHERE l_suppkey = 3 GROUP BY 1")
def callees(t) -> DataFrame:
    return t("lineitem").filter("l_suppkey = 3").groupBy(F.col("l_partkey").alias("callee")).agg(F.count("*").alias("calls"))


@query("SELECT l_returnflag AS kind, count(*) AS refs, count(DISTINCT l_partkey) AS targets FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1")
def refs_by_kind(t) -> DataFrame:
    return t("lineitem").filter("l_linestatus = 'O'").groupBy(F.col("l_returnflag").alias("kind")).agg(F.count("*").alias("refs"), F.countDistinct("l_partkey").alias("targets"))


@query("SELECT l_partkey AS package, count(*) AS imports, count(DISTINCT l_suppkey) AS files FROM lineitem GROUP BY 1 ORDER BY imports DESC, package LIMIT 20")
def top_imports(t) -> DataFrame:
    return t("lineitem").groupBy(F.col("l_partkey").alias("package")).agg(F.count("*").alias("imports"), F.countDistinct("l_suppkey").alias("files")).orderBy(F.desc("imports"), "package").limit(20)


ALL_EDGES = "SELECT DISTINCT l_partkey AS src, l_suppkey * 7 + l_linenumber AS dst FROM lineitem"


def _all_edges(t) -> DataFrame:
    return t("lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") * 7 + F.col("l_linenumber")).alias("dst"))


@query(f"WITH RECURSIVE e AS ({ALL_EDGES}), r AS (SELECT 1::BIGINT AS node UNION SELECT dst FROM e, r WHERE e.src = r.node) SELECT node::BIGINT AS node FROM r")
def reachability(t) -> DataFrame:
    return graph.reachable(_all_edges(t), t("part").sparkSession.range(1, 2).select(F.col("id").alias("node")))


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS files, sum(n_chars)::BIGINT AS chars FROM documents")
def store_stats(t) -> DataFrame:
    return t("documents").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("files"), F.sum("n_chars").alias("chars"))


@query("SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS size, greatest(sum(n_chars) // 50 // 50, count(*))::BIGINT AS chunks FROM documents GROUP BY lang")
def lang_census(t) -> DataFrame:
    return t("documents").groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("size"), F.greatest(F.floor(F.floor(F.sum("n_chars") / 50) / 50), F.count("*")).cast("long").alias("chunks"))


@query("SELECT o_custkey AS author, count(*) AS changes, sum(l_quantity + l_linenumber)::DOUBLE AS lines, max(o_orderdate) AS latest, round(count(*) / max(count(*)) OVER (), 6) AS expertise FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def contributor_insights(t) -> DataFrame:
    n = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("author"))
    a = n.agg(F.count("*").alias("changes"), F.sum(F.col("l_quantity") + F.col("l_linenumber")).alias("lines"), F.max("o_orderdate").alias("latest"))
    top = a.agg(F.max("changes").alias("m"))  # one row
    return a.join(F.broadcast(top)).select("author", "changes", "lines", "latest", r6(F.col("changes") / F.col("m")).alias("expertise"))


@query("SELECT count(*) AS commits, count(DISTINCT o_custkey) AS authors, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders")
def git_stats(t) -> DataFrame:
    return t("orders").agg(F.count("*").alias("commits"), F.countDistinct("o_custkey").alias("authors"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query(f"SELECT l_orderkey, l_partkey, l_linenumber, round(0.4 + 0.2 * exp(-(epoch(TIMESTAMP '{THEN}') - epoch(o_orderdate)) / 3600.0 / (24.0 * 60 * 6.931471805599453e-1)), 6) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R'")
def history_search(t) -> DataFrame:
    age = (F.unix_timestamp(F.lit(THEN).cast("timestamp")) - F.unix_timestamp("o_orderdate")) / 3600.0
    rows = t("lineitem").filter("l_returnflag = 'R'").join(t("orders").filter("o_orderpriority = '1-URGENT'"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select("l_orderkey", "l_partkey", "l_linenumber", r6(0.4 + 0.2 * retrieval.recency(age, 60.0)).alias("score"))


@query("SELECT a.l_orderkey, a.l_partkey AS part, b.l_partkey AS related, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey GROUP BY ALL")
def related_changes(t) -> DataFrame:
    a = t("lineitem").filter("l_orderkey is not null and l_partkey is not null").select("l_orderkey", F.col("l_partkey").alias("part"))
    # one shuffle by order serves the counts and the join; pairs come out whole, so they are neither shuffled nor grouped
    a = a.repartition(tables.parts(a), "l_orderkey").groupBy("l_orderkey", "part").agg(F.count("*").alias("k"))
    b = a.select("l_orderkey", F.col("part").alias("related"), F.col("k").alias("m"))
    return a.join(b.hint("merge"), "l_orderkey").filter("part <> related").select("l_orderkey", "part", "related", (F.col("k") * F.col("m")).alias("n"))


@query("SELECT s.l_orderkey, s.l_linenumber, p.p_partkey, count(*) AS n FROM lineitem s JOIN part p ON s.l_partkey = p.p_partkey AND s.l_quantity <= p.p_size AND s.l_quantity + 5 >= p.p_size - 10 GROUP BY ALL")
def hunk_chunk_overlap(t) -> DataFrame:
    j = t("lineitem").join(t("part"), (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_quantity") <= F.col("p_size")) & (F.col("l_quantity") + 5 >= F.col("p_size") - 10))
    return j.groupBy("l_orderkey", "l_linenumber", "p_partkey").agg(F.count("*").alias("n"))


@query(f"WITH a AS (SELECT user_id, count(*) AS n, max(ts) AS seen FROM events GROUP BY 1) SELECT user_id, round(0.2 * exp(-(epoch(TIMESTAMP '{NOW}') - epoch(seen)) / 3600.0 / (720.0 * 6.931471805599453e-1)) + 0.1 * least(1.0, log10(n + 1) / 3), 6) AS score FROM a")
def memory_recall(t) -> DataFrame:
    a = t("events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("seen"))
    age = (F.lit(NOW).cast("timestamp").cast("double") - F.col("seen").cast("timestamp").cast("double")) / 3600.0
    return a.select("user_id", r6(0.2 * retrieval.recency(age) + 0.1 * F.least(F.lit(1.0), F.log10(F.col("n") + 1) / 3)).alias("score"))


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS sessions, min(turn) AS first_turn, max(turn) AS last_turn FROM conversations GROUP BY role")
def memory_stats(t) -> DataFrame:
    return t("conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("sessions"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query(f"SELECT event_id FROM events WHERE ts + INTERVAL 20 DAY >= TIMESTAMP '{NOW}'")
def memory_prune(t) -> DataFrame:
    return t("events").filter(F.col("ts") + F.expr("INTERVAL 20 DAYS") >= F.lit(NOW).cast("timestamp")).select("event_id")


@query("SELECT c.conv_id, c.turn FROM conversations c WHERE c.role <> 'user' OR c.conv_id IN (SELECT conv_id FROM conversations WHERE turn = 3)")
def checkpoint_restore(t) -> DataFrame:
    c = t("conversations")
    keep = c.filter("turn = 3").select("conv_id").distinct().withColumn("saved", F.lit(True))
    return c.join(keep, "conv_id", "left").filter("role <> 'user' or saved").select("conv_id", "turn")


@query("SELECT o_orderkey, round(CASE WHEN o_orderpriority LIKE '1%' THEN 0.4 WHEN o_orderpriority LIKE '2%' THEN 0.2 WHEN o_orderpriority LIKE '3%' THEN 0.1 ELSE 0 END + CASE WHEN o_orderdate < TIMESTAMP '2001-06-01' THEN 0.5 WHEN o_orderdate < TIMESTAMP '2001-06-02' THEN 0.3 WHEN o_orderdate < TIMESTAMP '2001-06-08' THEN 0.1 ELSE 0 END + 1.0, 6)::DOUBLE AS score FROM orders WHERE o_orderstatus = 'O'")
def todo_rank(t) -> DataFrame:
    p, d = F.col("o_orderpriority"), F.col("o_orderdate")
    bonus = F.when(p.startswith("1"), 0.4).when(p.startswith("2"), 0.2).when(p.startswith("3"), 0.1).otherwise(0.0)
    due = F.when(d < "2001-06-01", 0.5).when(d < "2001-06-02", 0.3).when(d < "2001-06-08", 0.1).otherwise(0.0)
    return t("orders").filter("o_orderstatus = 'O'").select("o_orderkey", r6(bonus + due + 1.0).alias("score"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, count(*) FILTER (o_orderdate < TIMESTAMP '2000-01-01') AS overdue FROM orders GROUP BY ALL")
def todo_stats(t) -> DataFrame:
    return t("orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderdate") < "2000-01-01").alias("overdue"))


@query("SELECT source, lang, count(*) AS notes, count(*) FILTER (quality = 0) AS flagged FROM documents JOIN labels USING (doc_id) WHERE lower(text) LIKE '%license%' GROUP BY ALL")
def notes_filter(t) -> DataFrame:
    d = t("documents").filter(F.lower("text").contains("license")).select("doc_id", "source", "lang")
    return d.join(t("labels"), "doc_id").groupBy("source", "lang").agg(F.count("*").alias("notes"), F.count_if(F.col("quality") == 0).alias("flagged"))


_POINTS = r"len(regexp_extract_all(lower(text), '\b(?:if|elif|for|while|case|catch)\b')) + len(regexp_extract_all(lower(text), '\belse if\b')) + len(regexp_extract_all(lower(text), '&&|\|\||\?'))"


@query(f"SELECT doc_id, ({_POINTS})::BIGINT AS points, CASE WHEN {_POINTS} <= 5 THEN 'low' WHEN {_POINTS} <= 10 THEN 'medium' WHEN {_POINTS} <= 20 THEN 'high' ELSE 'very_high' END AS rating FROM documents")
def decision_counts(t) -> DataFrame:
    p = decision_points(F.col("text")).cast("long")
    return t("documents").select("doc_id", p.alias("points"), rating(p).alias("rating"))


@query("SELECT page_id, len(regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>'))::BIGINT AS scripts FROM pages")
def script_extract(t) -> DataFrame:
    return t("pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*>(.*?)</script>"), F.lit(0))).cast("long").alias("scripts"))


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY user_id")
def upsert_latest(t) -> DataFrame:
    return graph.latest(t("events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "ts")


_J = "chr(10) || chr(10) || '---' || chr(10) || '**[Merged from other branch]:**' || chr(10)"


@query(f"WITH b AS (SELECT doc_id AS id, source AS b FROM documents WHERE doc_id % 5 <> 0), o AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN source || '+' ELSE source END AS o FROM documents WHERE doc_id % 11 <> 0), t AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN source || '-' ELSE source END AS t FROM documents WHERE doc_id % 13 <> 0), j AS (SELECT id, b, o, t, CASE WHEN o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o = t THEN 'same' WHEN b IS NOT NULL AND o = b THEN 'theirs' WHEN b IS NOT NULL AND t = b THEN 'ours' WHEN b IS NOT NULL THEN 'both' ELSE 'ours_added' END WHEN o IS NOT NULL THEN CASE WHEN b IS NULL THEN 'ours' WHEN o = b THEN 'deleted' ELSE 'ours_kept' END WHEN t IS NOT NULL THEN CASE WHEN b IS NULL THEN 'theirs' WHEN t = b THEN 'deleted' ELSE 'theirs_kept' END ELSE 'deleted' END AS action FROM b FULL JOIN o USING (id) FULL JOIN t USING (id)) SELECT id, CASE WHEN action IN ('same', 'ours', 'ours_kept', 'ours_added') THEN o WHEN action IN ('theirs', 'theirs_kept') THEN t WHEN action = 'both' THEN o || {_J} || t END AS content, action, action IN ('both', 'ours_added', 'ours_kept', 'theirs_kept') AS conflict FROM j")
def three_way_merge_notes(t) -> DataFrame:
    d, k, s = t("documents"), F.col("doc_id"), F.col("source")
    pick = lambda keep, c: d.filter(keep).select(k.alias("id"), c.alias("content"))
    return merge.merge_notes(pick(k % 5 != 0, s), pick(k % 11 != 0, F.when(k % 3 == 0, F.concat(s, F.lit("+"))).otherwise(s)), pick(k % 13 != 0, F.when(k % 2 == 0, F.concat(s, F.lit("-"))).otherwise(s)))


@query("WITH a AS (SELECT user_id AS path, ts, CASE WHEN lag(ts) OVER w IS NULL OR lag(ts) OVER w + INTERVAL 6 HOUR <= ts THEN 1 ELSE 0 END AS head FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), b AS (SELECT *, sum(head) OVER (PARTITION BY path ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM a) SELECT path, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM b GROUP BY path, g")
def debounce_sessions(t) -> DataFrame:
    return debounced(t("events").select(F.col("user_id").alias("path"), "ts"), "6 hours")


@query("SELECT url, page_id FROM pages WHERE regexp_matches(url, '^(?:.*/)?[^/]*1[^/]*$')")
def glob_paths(t) -> DataFrame:
    return t("pages").filter(matches_glob(F.col("url"), "**/*1*")).select("url", "page_id")


_TOPK = "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) DESC, vec_id LIMIT 20"


def _nearest(t) -> DataFrame:
    e = t("embeddings")
    return retrieval.vector_topk(e, e.filter("vec_id = 0").first()["embedding"], 20).select(F.col("vec_id").alias("id"), r6("score").alias("score"))


@query(f"WITH v AS ({_TOPK}), b AS ({_bm25_sql(['reed', 'onre'], 'or')}), f AS (SELECT id, 0.7 * coalesce(score, 0) + 0.3 * coalesce(bm25 / (1 + bm25), 0) AS fused FROM v FULL JOIN b USING (id)) SELECT id, round(fused, 6) AS fused FROM f ORDER BY f.fused DESC, id LIMIT 10")
def hybrid_search(t) -> DataFrame:
    text = retrieval.bm25(t("documents"), ["reed", "onre"], 20, "or").withColumn("bm25", r6("bm25"))
    return retrieval.fuse(_nearest(t), text, 10).withColumn("fused", r6("fused"))


@query(f"WITH v AS ({_TOPK}), r AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank, count(*) OVER () AS n FROM v) SELECT id, round(0.3 * score + 0.7 * (n - rank + 1) / n, 6) AS fused FROM r")
def rerank_by_rank(t) -> DataFrame:
    near = _nearest(t).withColumnRenamed("score", "fused")
    return retrieval.rerank_blend(near, retrieval.rank_scores(near)).withColumn("fused", r6("fused"))


_PARTS = r"list_filter(regexp_split_to_array(lower(regexp_replace(p_name, '(\p{Lu})', '_\1', 'g')), '[_\-. ]+'), lambda x: x <> '')"


@query(f"WITH a AS (SELECT p_partkey, lower(p_name) AS n, {_PARTS} AS ps FROM part), s AS (SELECT p_partkey, CASE WHEN n = 'pa_bl' THEN 1.0 WHEN starts_with(n, 'pa_bl') THEN 0.9 WHEN contains(n, 'pa_bl') THEN 0.7 ELSE ((len(list_filter(ps, lambda x: starts_with(x, 'pa'))) > 0)::INT + (len(list_filter(ps, lambda x: starts_with(x, 'bl'))) > 0)::INT) / 2 * 0.8 END::DOUBLE AS score FROM a) SELECT p_partkey, round(score, 6) AS score FROM s WHERE score > 0.3")
def fuzzy_symbols(t) -> DataFrame:
    rows = t("part").select("p_partkey", retrieval.fuzzy_score(F.col("p_name"), "pa_bl").alias("score"))
    return rows.filter("score > 0.3").withColumn("score", r6("score"))


@query("WITH x AS (SELECT doc_id AS id, string_split(text, chr(10)) AS ls FROM documents), y AS (SELECT id, ls, unnest(ls) AS content, generate_subscripts(ls, 1)::BIGINT AS line FROM x) SELECT id, line, array_to_string(ls[greatest(1, line - 1):line + 1], chr(10)) AS context FROM y WHERE regexp_matches(content, '(?i)licen[cs]ed? under')")
def grep_context(t) -> DataFrame:
    return retrieval.line_context(t("documents"), "licen[cs]ed? under", 1)


_HTML = "coalesce(html, '')"
_CYCLES = "1 + " + _POINTS.replace("lower(text)", f"lower({_HTML})")


@query(f"WITH x AS (SELECT page_id, string_split({_HTML}, chr(10)) AS ls FROM pages), l AS (SELECT page_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM x), d AS (SELECT page_id, line, sum(len(replace(line, '}}', '')) - len(replace(line, '{{', ''))) OVER (PARTITION BY page_id ORDER BY i) AS depth FROM l), n AS (SELECT page_id, greatest(0, max(depth))::BIGINT AS max_nesting, count(*) FILTER (contains(line, 'return ')) AS returns FROM d GROUP BY 1), c AS (SELECT page_id, ({_CYCLES})::BIGINT AS cyclomatic, len(string_split({_HTML}, chr(10))) - CASE WHEN {_HTML} = '' OR ends_with({_HTML}, chr(10)) THEN 1 ELSE 0 END AS lines FROM pages) SELECT page_id AS id, lines::BIGINT AS lines, returns, cyclomatic, max_nesting, cyclomatic + 2 * max_nesting AS cognitive, CASE WHEN cyclomatic <= 5 THEN 'low' WHEN cyclomatic <= 10 THEN 'medium' WHEN cyclomatic <= 20 THEN 'high' ELSE 'very_high' END AS rating FROM c JOIN n USING (page_id)")
def file_complexity(t) -> DataFrame:
    return code.complexity(t("pages"), "page_id", "html")


@query("WITH c AS (SELECT l_partkey AS part, l_suppkey, (o_orderdate, l_orderkey, l_linenumber, l_suppkey) AS moment FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT part, count(*) AS changes, count(DISTINCT l_suppkey) AS authors, arg_min(l_suppkey, moment) AS created_by, arg_max(l_suppkey, moment) AS changed_by FROM c GROUP BY part")
def chunk_evolution(t) -> DataFrame:
    rows = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return code.evolution(rows, "l_partkey", "l_suppkey", ["o_orderdate", "l_orderkey", "l_linenumber", "l_suppkey"])


@query("WITH bb AS (SELECT o_orderkey AS id, {'s': o_orderstatus, 'u': o_orderdate} AS b FROM orders WHERE o_orderkey % 5 <> 0), oo AS (SELECT o_orderkey AS id, {'s': o_orderstatus, 'u': o_orderdate + to_days((o_orderkey % 3)::INT)} AS o FROM orders WHERE o_orderkey % 7 <> 0), tt AS (SELECT o_orderkey AS id, {'s': CASE WHEN o_orderkey % 2 = 0 THEN 'P' ELSE o_orderstatus END, 'u': o_orderdate + to_days((o_orderkey % 2)::INT)} AS t FROM orders WHERE o_orderkey % 11 <> 0), j AS (SELECT id, CASE WHEN o IS NOT NULL AND t IS NOT NULL THEN CASE WHEN o.s = 'F' THEN o WHEN t.s = 'F' THEN t WHEN o.u > t.u THEN o ELSE t END WHEN b IS NULL THEN coalesce(o, t) END AS p FROM bb FULL JOIN oo USING (id) FULL JOIN tt USING (id)) SELECT id, p.s AS status, p.u AS updated FROM j WHERE p IS NOT NULL")
def three_way_merge_todos(t) -> DataFrame:
    rows, k = t("orders"), F.col("o_orderkey")
    later = lambda n: F.expr(f"o_orderdate + make_dt_interval(cast(o_orderkey % {n} as int))")
    side = lambda keep, status, updated: rows.filter(keep).select(k.alias("id"), status.alias("status"), updated.alias("updated"))
    status = F.col("o_orderstatus")
    return merge.merge_latest(side(k % 5 != 0, status, F.col("o_orderdate")), side(k % 7 != 0, status, later(3)), side(k % 11 != 0, F.when(k % 2 == 0, "P").otherwise(status), later(2)), "F")


@query("WITH n AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 3 = 0 GROUP BY 1) SELECT o_custkey, o_orderkey FROM n UNION ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n)")
def upsert_rows(t) -> DataFrame:
    rows = t("orders").select("o_custkey", "o_orderkey")
    return graph.upsert(rows, graph.latest(rows.filter("o_orderkey % 3 = 0"), ["o_custkey"], [F.desc("o_orderkey")]), ["o_custkey"])


@query("SELECT l_orderkey, l_orderkey || '-' || l_linenumber AS hash, 'x' || l_suppkey AS author, l_shipdate AS date, l_returnflag = 'R' AS is_merge, 1::BIGINT AS files_changed, l_quantity::BIGINT AS insertions, l_partkey::BIGINT AS deletions FROM lineitem")
def commit_log(t) -> DataFrame:
    field = lambda *c: F.concat_ws("\0", *c)
    head = field(F.concat_ws("-", "l_orderkey", "l_linenumber"), F.lit("h"), F.concat(F.lit("x"), F.col("l_suppkey")), F.lit("a@x"), F.unix_timestamp("l_shipdate").cast("string"), F.when(F.col("l_returnflag") == "R", "Merge").otherwise("Fix"), F.lit(""), F.lit(""))
    text = F.concat(head, F.lit("\n\n"), F.concat_ws("\t", F.col("l_quantity").cast("long"), "l_partkey", F.lit("a file.py")), F.lit("\n\n"))
    logs = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(text), "").alias("log"))
    return history.commits(logs).select("l_orderkey", "hash", "author", F.col("date").cast("timestamp_ntz").alias("date"), "is_merge", "files_changed", "insertions", "deletions")


@query(f"SELECT event_id, round(CASE WHEN value > 0.01 THEN value * exp(-0.693147 * epoch(TIMESTAMP '{NOW}' - ts) / 86400 / 30) ELSE value END, 6) AS confidence FROM events")
def confidence_decay(t) -> DataFrame:
    return t("events").select("event_id", r6(records.decayed(F.col("value"), F.col("ts"), F.lit(NOW).cast("timestamp"), 30)).alias("confidence"))


_MOVE = "CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'completed' ELSE 'pending' END"


@query(f"SELECT o_orderkey, {_MOVE} AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate WHEN o_orderstatus = 'O' THEN TIMESTAMP '{THEN}' END AS started_at, CASE WHEN o_orderstatus = 'F' THEN TIMESTAMP '{THEN}' END AS completed_at, TIMESTAMP '{THEN}' AS updated_at FROM orders")
def todo_transitions(t) -> DataFrame:
    now = F.lit(THEN).cast("timestamp_ntz")
    todos = t("orders").select("o_orderkey", "o_orderstatus", F.lit("pending").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderdate")).alias("started_at"), F.col("o_orderdate").alias("completed_at"), F.col("o_orderdate").alias("updated_at"))
    return records.with_status(todos, F.expr(_MOVE), now).drop("o_orderstatus")


#: Tools and words by which a request for them is known; a parameter of the operator.
_TOOLS = {"page_links": ["href", "link"], "page_text": ["text", "<p", "paragraph"], "page_scripts": ["script", "function"], "page_lists": ["<li", "list"], "page_tables": ["table", "<td"]}
_SCORES = " UNION ALL ".join("SELECT page_id, '" + k + "' AS tool, " + " + ".join(f"CASE WHEN contains(lower(html), '{w}') THEN {len(w)} ELSE 0 END" for w in v) + " AS score FROM pages" for k, v in _TOOLS.items())


@query(f"WITH s AS ({_SCORES}), r AS (SELECT page_id, tool, score::BIGINT AS score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, tool) AS rank FROM s WHERE score > 0) SELECT * FROM r WHERE rank <= 3")
def tool_routes(t) -> DataFrame:
    return records.routes(t("pages"), "page_id", "html", _TOOLS)


_RANGE = "o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'"


@query(f"WITH c AS (SELECT o_orderkey AS hash, lower(o_orderpriority) AS m, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) - 1 AS place, count(*) OVER () AS n FROM orders WHERE {_RANGE}), h AS (SELECT l_orderkey AS hash, sum(CASE WHEN l_linestatus = 'O' THEN 0.3 ELSE 0 END + CASE WHEN l_returnflag = 'R' THEN 0.1 ELSE 0 END) AS hits FROM lineitem GROUP BY 1), s AS (SELECT hash, CASE WHEN contains(m, 'urgent') THEN 0.2 ELSE 0 END + CASE WHEN contains(m, 'open') THEN 0.2 ELSE 0 END + coalesce(hits, 0) + CASE WHEN n > 1 THEN place / n * 0.2 ELSE 0 END AS score FROM c LEFT JOIN h USING (hash)) SELECT hash, round(score::DOUBLE, 6) AS score FROM s WHERE score > 0")
def regression_candidates(t) -> DataFrame:
    commits = t("orders").filter(_RANGE).select(F.col("o_orderkey").alias("hash"), F.col("o_orderpriority").alias("message"), F.col("o_orderdate").alias("date"))
    functions = F.when(F.col("l_linestatus") == "O", F.array(F.lit("openFile")))
    changes = t("lineitem").select(F.col("l_orderkey").alias("hash"), functions.alias("functions"), F.when(F.col("l_returnflag") == "R", "+ Urgent").alias("diff"))
    return records.regression_candidates(commits, changes, "Urgent open", None).withColumn("score", r6("score"))


@query("WITH p AS (SELECT page_id, string_split(url, '/') AS ps FROM pages), d AS (SELECT page_id, array_to_string(ps[1:k], '/') AS dir FROM p, LATERAL (SELECT unnest(range(1, len(ps))) AS k)) SELECT dir, count(*) AS files, count(*) FILTER (page_id % 3 = 0) AS indexed FROM d GROUP BY dir")
def directory_rollup(t) -> DataFrame:
    return records.directories(t("pages"), F.col("url"), F.col("page_id") % 3 == 0)


@query("WITH a AS (SELECT o_orderkey, o_orderkey::VARCHAR AS h, date_diff('day', o_orderdate, TIMESTAMP '1996-12-01') AS age, o_orderstatus = 'P' AS tagged, o_orderpriority = '1-URGENT' AS merge FROM orders) SELECT o_orderkey FROM a WHERE CASE WHEN age <= 30 THEN true WHEN age <= 365 THEN tagged OR merge OR list_sum(list_transform(string_split(h, ''), lambda x: ascii(x))) % 100 < 40 ELSE tagged END")
def commit_sampling(t) -> DataFrame:
    age = F.datediff(F.lit("1996-12-01").cast("timestamp"), "o_orderdate")
    return t("orders").filter(records.is_sampled(F.col("o_orderkey").cast("string"), age, F.col("o_orderstatus") == "P", F.col("o_orderpriority") == "1-URGENT", 0.4)).select("o_orderkey")


@query("WITH s AS (SELECT 'p' || p_partkey AS symbol_id, p_brand AS name, p_type AS dir FROM part WHERE p_partkey % 2 = 0), r AS (SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 4 = 0 THEN 'p' || p_partkey ELSE p_brand END AS target, p_type AS dir FROM part), n AS (SELECT name, dir, min(symbol_id) AS near FROM s GROUP BY 1, 2), f AS (SELECT name, min(symbol_id) AS far FROM s GROUP BY 1) SELECT ref_id, coalesce(s.symbol_id, near, far) AS symbol_id FROM r LEFT JOIN s ON target = s.symbol_id LEFT JOIN n ON target = n.name AND r.dir = n.dir LEFT JOIN f ON target = f.name WHERE coalesce(s.symbol_id, near, far) IS NOT NULL")
def resolve_symbols(t) -> DataFrame:
    p, own = t("part"), F.concat(F.lit("p"), F.col("p_partkey"))
    refs = p.select(F.col("p_partkey").alias("ref_id"), F.when(F.col("p_partkey") % 4 == 0, own).otherwise(F.col("p_brand")).alias("target"), F.col("p_type").alias("dir"))
    return graph.resolve(refs, p.filter("p_partkey % 2 = 0").select(own.alias("symbol_id"), F.col("p_brand").alias("name"), F.col("p_type").alias("dir")))


@query(None)  # chunks grow line by line, which SQL can't tell; tests hold them against their rule
def document_chunks(t) -> DataFrame:
    files = t("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("text").alias("language"))
    return chunking.chunks(files, 200).select(F.col("path").cast("long").alias("doc_id"), "chunk_type", "start_line", "end_line", "hash")


from quarry.plans import code_search, records as record_queries  # noqa: E402,F401  they register their queries
