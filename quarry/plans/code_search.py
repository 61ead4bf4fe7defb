"""Named queries over symbols, references, chunks and files; each with its SQL twin where SQL can tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.functions import code
from quarry.operators import filters, graph, search, stores, summary
from quarry.plans.catalogue import query, r6
from quarry.plans.shapes import made, twin
from quarry.sources import files, tree
from quarry.streaming import watch

SYMBOLS, REFS, CHUNKS = twin("symbols"), twin("refs"), twin("chunks")
LOW = "lower(name)"
TEST = "(language = 'go' AND (starts_with(name, 'Test') OR starts_with(name, 'Benchmark') OR starts_with(name, 'Example') OR starts_with(name, 'Fuzz')) OR language = 'python' AND (starts_with(name, 'test_') OR starts_with(name, 'Test')) OR language = 'typescript' AND (starts_with(name, 'test') OR starts_with(name, 'it') OR starts_with(name, 'describe') OR starts_with(name, 'Test')) OR language = 'java' AND (starts_with(name, 'test') OR starts_with(name, 'Test')) OR starts_with(name, 'Test') OR starts_with(name, 'test_') OR starts_with(name, 'Benchmark') OR starts_with(name, 'Example') OR contains(lower(path), '_test.') OR contains(lower(path), '/test/') OR contains(lower(path), '/tests/') OR contains(lower(path), '/testing/'))"
ROOT = f"({TEST} OR {LOW} IN ('main', 'init', '__init__', '__main__') AND (name IN ('main', 'init', '__init__', '__main__') OR {LOW} = 'main' AND language IN ('go', 'python', 'typescript', 'java')) OR name IN ('ServeHTTP', 'ServeHTTPS') OR starts_with({LOW}, 'handle') OR ends_with({LOW}, 'handler'))"
EXPORTED = "CASE language WHEN 'go' THEN regexp_matches(name, '^[A-Z]') WHEN 'python' THEN NOT starts_with(name, '_') WHEN 'typescript' THEN visibility IN ('public', '') WHEN 'java' THEN visibility = 'public' ELSE visibility = 'public' OR regexp_matches(name, '^[A-Z]') END"
#: Symbols by name: the least id of a name in a folder, and of a name anywhere.
FOUND = f"s AS (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM {SYMBOLS}), near AS (SELECT name, dir, min(id) AS id FROM s GROUP BY 1, 2), far AS (SELECT name, min(id) AS id FROM s GROUP BY 1), r AS (SELECT *, regexp_extract(file_path, '^(.*)/[^/]*$', 1) AS dir FROM {REFS}), e AS (SELECT DISTINCT coalesce(n1.id, f1.id) AS src, coalesce(n2.id, f2.id) AS dst FROM r LEFT JOIN near n1 ON n1.name = split_part(from_symbol, '.', -1) AND n1.dir = r.dir LEFT JOIN far f1 ON f1.name = split_part(from_symbol, '.', -1) LEFT JOIN near n2 ON n2.name = split_part(to_symbol, '.', -1) AND n2.dir = r.dir LEFT JOIN far f2 ON f2.name = split_part(to_symbol, '.', -1)), g AS (SELECT src, dst FROM e WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"
LIVE = f"{FOUND}, live AS (SELECT id AS node FROM s WHERE {ROOT} UNION SELECT g.dst FROM g, live WHERE g.src = live.node)"


@query(f"SELECT id, to_symbol FROM {REFS} WHERE to_symbol IN ('src/economy/f10.go:part10:10', 'part10', 'economy.part10') OR to_symbol ILIKE '%.part10'")
def callers_of_symbol(t) -> DataFrame:
    return filters.refs_to(made(t, "refs"), "src/economy/f10.go:part10:10").select("id", "to_symbol")


@query(f"SELECT id, to_symbol FROM {REFS} WHERE from_symbol IN ('src/economy/f10.go:part10:10', 'part10')")
def callees_of_symbol(t) -> DataFrame:
    return filters.refs_from(made(t, "refs"), "src/economy/f10.go:part10:10").select("id", "to_symbol")


@query(f"SELECT id, from_symbol FROM {REFS} WHERE kind = 'call' AND NOT is_external ORDER BY id LIMIT 100")
def internal_calls(t) -> DataFrame:
    return filters.refs_of_kind(made(t, "refs"), "call", True, 100).select("id", "from_symbol")


@query(f"SELECT id, name, line_count FROM {SYMBOLS} WHERE name ILIKE '%HANDLER%' AND kind = 'function' AND line_count >= 20 ORDER BY line_count DESC, id LIMIT 40")
def symbols_by_name(t) -> DataFrame:
    return filters.symbols(made(t, "symbols"), "HANDLER", "function", 20, True, 40).select("id", "name", "line_count")


@query(f"SELECT id, name, line_count FROM {SYMBOLS} WHERE kind IN ('function', 'method') AND line_count >= 100 ORDER BY line_count DESC, id LIMIT 60")
def long_functions(t) -> DataFrame:
    return filters.long_functions(made(t, "symbols"), 100, 60).select("id", "name", "line_count")


@query(f"SELECT id, split_part(id, ':', -2) AS name, regexp_extract(id, '^(?:.*/)?([^/:]+)/[^/]*:', 1) || '.' || split_part(id, ':', -2) AS qualified FROM {SYMBOLS}")
def symbol_names(t) -> DataFrame:
    return made(t, "symbols").select("id", code.short_name(F.col("id")).alias("name"), code.qualified_name(F.col("id")).alias("qualified"))


@query(f"SELECT id, {TEST} AS is_test, {ROOT} AS is_root, {EXPORTED} AS is_exported FROM {SYMBOLS}")
def symbol_predicates(t) -> DataFrame:
    args = F.col("name"), F.col("language"), F.col("path")
    return made(t, "symbols").select("id", code.is_test(*args).alias("is_test"), code.is_root(*args).alias("is_root"), code.is_exported(F.col("name"), F.col("language"), F.col("visibility")).alias("is_exported"))


_TYPES = " UNION ALL ".join(f"SELECT id, name, '{kind}' AS type, {c}::DOUBLE AS confidence FROM {SYMBOLS} WHERE kind = 'function' AND {hit}" for kind, c, hit in (("main", 1.0, "name = 'main'"), ("test", 1.0, "starts_with(name, 'Test')"), ("init", 1.0, "name = 'init'"), *(("handler", 0.8, f"contains(name, '{p}')") for p in ("Handle", "ServeHTTP", "Handler")), *(("cli", 0.6, f"contains(name, '{p}')") for p in ("Execute", "Run", "Cmd"))))


@query(_TYPES)
def entry_points(t) -> DataFrame:
    return graph.entry_points(made(t, "symbols"))


@query(f"WITH {FOUND} SELECT src, dst FROM g")
def call_graph(t) -> DataFrame:
    return graph.call_graph(made(t, "symbols"), made(t, "refs"))


def _dead(t) -> DataFrame:
    s = made(t, "symbols")
    return graph.dead_code(s, graph.call_graph(s, made(t, "refs")))


_DEAD = f"WITH RECURSIVE {LIVE}, c AS (SELECT dst AS id, count(*) AS callers, count(*) FILTER (src NOT IN (SELECT node FROM live)) AS dead_callers FROM g GROUP BY 1), d AS (SELECT s.id, name, kind, path, coalesce(callers, 0) AS callers, coalesce(dead_callers, 0) AS dead_callers, {EXPORTED} AS seen, language FROM s LEFT JOIN c ON c.id = s.id WHERE s.id NOT IN (SELECT node FROM live) AND NOT {TEST}), f AS (SELECT id, name, kind, path, round(greatest(0.0, least(1.0, 0.85 - CASE WHEN seen THEN 0.3 ELSE 0 END - CASE WHEN regexp_matches(name, '^(New|Create|Make)') THEN 0.15 ELSE 0 END - CASE WHEN kind = 'method' AND language IN ('go', 'typescript', 'java') THEN 0.2 ELSE 0 END + CASE WHEN callers > 0 AND callers = dead_callers THEN 0.1 ELSE 0 END - CASE WHEN contains({LOW}, 'handler') OR contains({LOW}, 'middleware') THEN 0.15 ELSE 0 END - CASE WHEN regexp_matches(name, '^[oO]n') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS confidence, CASE WHEN callers = 0 AND seen THEN '{graph.REASONS[0]}' WHEN callers = 0 THEN '{graph.REASONS[1]}' WHEN callers = dead_callers THEN '{graph.REASONS[2]}' ELSE '{graph.REASONS[3]}' END AS reason, callers, dead_callers FROM d)"


@query(f"{_DEAD} SELECT * FROM f WHERE confidence >= 0.5")
def dead_code(t) -> DataFrame:
    return _dead(t)


@query(f"{_DEAD} SELECT id, confidence FROM f WHERE confidence >= 0.5 AND kind IN ('function', 'method') ORDER BY confidence DESC, id LIMIT 30")
def dead_functions(t) -> DataFrame:
    return graph.dead_functions(_dead(t), 30).select("id", "confidence")


@query(f"{_DEAD} SELECT id, confidence FROM f WHERE confidence >= 0.5 AND kind IN ('type', 'interface') ORDER BY confidence DESC, id LIMIT 30")
def unused_types(t) -> DataFrame:
    return graph.unused_types(_dead(t), 30).select("id", "confidence")


@query(f"WITH RECURSIVE {LIVE} SELECT (SELECT count(*) FROM s) AS symbols, (SELECT count(*) FROM s WHERE {ROOT}) AS entry_points, (SELECT count(*) FROM live) AS reachable, (SELECT count(*) FROM s) - (SELECT count(*) FROM live) AS dead, (SELECT count(*) FROM g) AS edges")
def graph_stats(t) -> DataFrame:
    s = made(t, "symbols")
    return graph.graph_stats(s, graph.call_graph(s, made(t, "refs")))


@query(f"{_DEAD}, k AS (SELECT id, name, line_count FROM s WHERE kind IN ('function', 'method')) SELECT 'long' AS topic, id, name, line_count::DOUBLE AS value FROM k WHERE line_count >= 50 UNION ALL SELECT 'complex', id, name, (line_count // 5)::DOUBLE FROM k WHERE line_count >= 30 UNION ALL SELECT 'dead', id, name, confidence FROM f WHERE confidence >= 0.5 AND kind IN ('function', 'method')")
def refactoring_report(t) -> DataFrame:
    return graph.refactoring_report(made(t, "symbols"), _dead(t))


@query(f"SELECT path, count(*) FILTER (kind IN ('function', 'method')) AS functions, count(*) FILTER (kind IN ('type', 'interface')) AS types, count(*) FILTER (kind IN ('variable', 'constant')) AS variables, max(line_count) AS longest FROM {SYMBOLS} GROUP BY path")
def quick_summary(t) -> DataFrame:
    return summary.quick_summary(made(t, "symbols"))


# ---- search ------------------------------------------------------------------------------

#: A text's words as they are indexed: the texts' accents fold to their base letters.
_FOLDED = "regexp_extract_all(strip_accents(lower(content)), '[\\pL\\pN]+')"


def _ranked(cond: str, freqs: list[str], extra: str = "true") -> str:
    """Ranks by BM25 with term frequencies over the word list ts; cond over f0, f1 and so on."""
    cols = ", ".join(f"{f} AS f{i}" for i, f in enumerate(freqs))
    dfs = ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(freqs)))
    score = " + ".join(f"greatest(ln((nd - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / an))" for i in range(len(freqs)))
    return f"WITH a AS (SELECT *, {_FOLDED} AS ts FROM {CHUNKS}), b AS (SELECT id, language, chunk_type, len(ts) AS n, {cols} FROM a), s AS (SELECT count(*)::DOUBLE AS nd, avg(n) AS an, {dfs} FROM b) SELECT id, round({score}, 6) AS bm25 FROM b, s WHERE ({cond}) AND {extra} ORDER BY {score} DESC, id LIMIT 20"


def _count(pattern: str) -> str:
    return f"len(list_filter(ts, lambda x: regexp_matches(x, '^(?:{pattern})$')))"


def _phrase(a: str, b: str) -> str:
    return f"len(list_filter(range(1, len(ts)), lambda i: regexp_matches(ts[i], '^(?:{a})$') AND ts[i + 1] = '{b}'))"


@query(_ranked("f0 > 0 AND f1 > 0", [_count("licens(?:e|es|ed|ing)?"), _count("under")], "language = 'en' AND chunk_type = 'block'"))
def text_search_stemmed(t) -> DataFrame:
    where = (F.col("language") == "en") & (F.col("chunk_type") == "block")
    return search.text_search(made(t, "chunks"), "licenses under", 20, where=where).withColumn("bm25", r6("bm25"))


@query(_ranked("f0 > 0 AND NOT f1 > 0", [_phrase("licens(?:e|es|ed|ing)?", "under"), _count("apache")]))
def text_search_phrase(t) -> DataFrame:
    return search.text_search(made(t, "chunks"), '"licensing under" NOT Apache', 20).withColumn("bm25", r6("bm25"))


@query(_ranked("f0 > 0 OR f1 > 0", [_count("reed(?:e|es|s|ed|ing|ings)?"), _count("licens(?:e|es|ed|ing)?")]))
def text_search_or(t) -> DataFrame:
    return search.text_search(made(t, "chunks"), "réed OR licensed", 20).withColumn("bm25", r6("bm25"))


@query(f"WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0), v AS (SELECT 'k' || vec_id AS chunk_id, list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]) AS score FROM embeddings, q) SELECT c.id, c.language, c.file_path, c.start_line, round(score, 6) AS score FROM v JOIN {CHUNKS} c ON c.id = v.chunk_id WHERE language IN ('en', 'de') ORDER BY v.score DESC, c.id LIMIT 10")
def search_vectors(t) -> DataFrame:
    v = made(t, "vectors")
    request = search.Request(vector=v.filter("chunk_id = 'k0'").first()["embedding"], languages=("en", "de"))
    return search.search(made(t, "chunks"), v, request).select("id", "language", "file_path", "start_line", r6("score").alias("score"))


@query(None)  # fusion of stemmed ranks over several columns; tests hold it against its parts
def search_hybrid(t) -> DataFrame:
    v = made(t, "vectors")
    request = search.Request("licensed under", v.filter("chunk_id = 'k0'").first()["embedding"])
    return search.search(made(t, "chunks"), v, request).select("id", "language", "file_path", r6("score").alias("score"))


@query(f"SELECT id, array_to_string(ls[greatest(1, start_line - 2):start_line - 1], chr(10)) AS context_before, array_to_string(ls[end_line + 1:end_line + 2], chr(10)) AS context_after FROM (SELECT 'k' || doc_id AS id, string_split(text, chr(10)) AS ls, doc_id % 5 + 1 AS start_line, doc_id % 5 + 2 AS end_line FROM documents)")
def hits_in_context(t) -> DataFrame:
    d = t("documents")
    path = F.col("doc_id").cast("string")
    hits = d.select(F.concat(F.lit("k"), path).alias("id"), path.alias("file_path"), (F.col("doc_id") % 5 + 1).alias("start_line"), (F.col("doc_id") % 5 + 2).alias("end_line"))
    return search.with_context(hits, d.select(path.alias("path"), F.col("text").alias("content")), 2).select("id", "context_before", "context_after")


@query(f"WITH w AS (SELECT 'k' || doc_id AS wanted FROM documents WHERE doc_id % 3 = 0 UNION SELECT source || '/' || (doc_id % 25) || '.go:any:' || (doc_id % 70 + 5) FROM documents WHERE doc_id % 3 <> 0), x AS (SELECT wanted, id FROM w JOIN {CHUNKS} c ON c.id = wanted), o AS (SELECT wanted, split_part(wanted, ':', 1) AS p, try_cast(split_part(wanted, ':', 3) AS BIGINT) AS line FROM w WHERE contains(wanted, ':')) SELECT wanted, id FROM x UNION ALL SELECT wanted, arg_min(id, (end_line - start_line, id)) AS id FROM o JOIN {CHUNKS} c ON c.file_path = o.p AND line BETWEEN start_line AND end_line GROUP BY wanted")
def chunk_lookup(t) -> DataFrame:
    d, k = t("documents"), F.col("doc_id")
    names = F.concat("source", F.lit("/"), (k % 25).cast("string"), F.lit(".go:any:"), (k % 70 + 5).cast("string"))
    return search.chunk_of(made(t, "chunks"), d.select(F.when(k % 3 == 0, F.concat(F.lit("k"), k.cast("string"))).otherwise(names).alias("wanted")))


@query(f"WITH s AS (SELECT 's' || p_partkey AS symbol_id, 'src' || p_size % 20 || '/' || p_partkey % 25 || '.go' AS file_path, p_partkey % 120 AS line FROM part) SELECT symbol_id, c.id AS chunk_id FROM s JOIN {CHUNKS} c ON c.file_path = s.file_path AND line BETWEEN start_line AND end_line")
def symbols_in_chunks(t) -> DataFrame:
    k = F.col("p_partkey")
    s = t("part").select(F.concat(F.lit("s"), k.cast("string")).alias("id"), F.concat(F.lit("src"), (F.col("p_size") % 20).cast("string"), F.lit("/"), (k % 25).cast("string"), F.lit(".go")).alias("path"), (k % 120).alias("line"))
    return search.symbols_in_chunks(s, made(t, "chunks"))


@query(f"SELECT DISTINCT change_id, c.id AS chunk_id FROM {twin('hunks')} h JOIN {CHUNKS} c ON c.file_path = h.file_path AND new_start <= end_line AND new_start + new_lines >= start_line")
def hunks_in_chunks(t) -> DataFrame:
    return search.overlapping(made(t, "hunks"), made(t, "chunks"))


@query(f"WITH c AS (SELECT id, file_path, unnest(affected_functions) AS name FROM {twin('changes')}), k AS (SELECT 'k' || p_partkey AS chunk_id, 'src/d' || p_size % 20 || '/f' || p_partkey % 50 || '.go' AS file_path, 'part' || p_partkey AS name FROM part) SELECT DISTINCT id AS change_id, chunk_id FROM c JOIN k USING (file_path, name)")
def changed_chunks(t) -> DataFrame:
    k = F.col("p_partkey")
    chunks = t("part").select(F.concat(F.lit("k"), k.cast("string")).alias("id"), F.concat(F.lit("src/d"), (F.col("p_size") % 20).cast("string"), F.lit("/f"), (k % 50).cast("string"), F.lit(".go")).alias("file_path"), F.concat(F.lit("part"), k.cast("string")).alias("name"))
    return search.changed_chunks_by_name(made(t, "changes"), chunks)


@query("WITH n AS (SELECT p_partkey AS place, p_name AS name FROM part) SELECT name, place FROM n WHERE contains(lower(name), 'red bolt') OR contains('red bolt', lower(name)) OR levenshtein(lower(name), 'red bolt') <= 3 ORDER BY place LIMIT 3")
def similar_names(t) -> DataFrame:
    return search.similar_names(t("part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place")), "Red bolt").select("name", "place")


@query(None)  # letters compared by common subsequence; tests hold it against its rule
def fuzzy_files(t) -> DataFrame:
    return search.fuzzy_files(t("pages").select(F.regexp_extract("url", r"^[^?]*", 0).alias("path")).distinct(), "82", 20).withColumn("score", r6("score"))


# ---- files -------------------------------------------------------------------------------


@query("SELECT url, regexp_matches(url, '^(?:(?:.*/)?[^/]*7|(?:http)/?[^/]*7)$') AND starts_with(url, 'http') AS index, starts_with(url, 'http') AND regexp_matches(url, '(?:^|/)[^/]*7(?:/|$)') AS tree, contains(url, 'http/7') AS history, url ILIKE 'http%/%7' AS people FROM (SELECT regexp_extract(url, '^[^?]*') AS url FROM pages)")
def glob_dialects(t) -> DataFrame:
    url = F.regexp_extract("url", r"^[^?]*", 0)
    rows = t("pages").select(url.alias("url"))
    globs = {"index": "http**/*7", "tree": "http**/*7", "history": "http*/*7", "people": "http*/*7"}
    return rows.select("url", *(code.matches_glob(F.col("url"), g, d).alias(d) for d, g in globs.items()))


@query("WITH p AS (SELECT DISTINCT regexp_extract(url, '^https?://([^?]*)', 1) AS path, 1::BIGINT AS size FROM pages), f AS (SELECT * FROM p WHERE NOT regexp_matches(path, '(?:^|/)(?:node_modules|vendor|dist|build|target|bin|obj|venv)/') AND NOT regexp_matches(path, '(?:^|/)[.]')), d AS (SELECT unnest(list_transform(range(0, len(string_split(path, '/'))), lambda k: CASE WHEN k = 0 THEN '.' ELSE array_to_string(string_split(path, '/')[1:k], '/') END)) AS path FROM f), n AS (SELECT path, true AS is_dir, count(*) AS files FROM d GROUP BY path UNION ALL SELECT path, false, 1 FROM f), l AS (SELECT *, CASE WHEN path = '.' THEN 0 ELSE len(string_split(path, '/')) END::BIGINT AS level FROM n) SELECT path, is_dir, files, level FROM l WHERE level <= 2")
def tree_nodes(t) -> DataFrame:
    paths = t("pages").select(F.regexp_extract("url", r"^https?://([^?]*)", 1).alias("path"), F.lit(1).cast("long").alias("size")).distinct()
    return tree.nodes(paths, 2).select("path", "is_dir", "files", F.col("level").cast("long").alias("level"))


@query(f"WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), y AS (SELECT doc_id, unnest(CASE WHEN ls[-1] = '' THEN ls[:-2] ELSE ls END) AS line FROM x), z AS (SELECT doc_id, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM y), c AS (SELECT doc_id, count(*) AS total_lines, count(*) FILTER (line = '') AS blank_lines, count(*) FILTER (starts_with(line, '//') OR starts_with(line, '#')) AS comment_lines FROM z GROUP BY 1) SELECT doc_id, coalesce(total_lines, 0) AS total_lines, coalesce(blank_lines, 0) AS blank_lines, coalesce(comment_lines, 0) AS comment_lines, coalesce(total_lines - blank_lines - comment_lines, 0) AS code_lines FROM documents LEFT JOIN c USING (doc_id)")
def line_classes(t) -> DataFrame:
    f = t("documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"), F.col("lang").alias("language"))
    return summary.measures(f).select(F.col("path").alias("doc_id"), "total_lines", "blank_lines", "comment_lines", "code_lines")


@query("SELECT page_id, (i - 1)::BIGINT AS part, bodies[i] AS body FROM (SELECT page_id, bodies, unnest(range(1, len(bodies) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, '(?is)<script[^>]*>(.*?)</script>', 1) AS bodies FROM pages))")
def embedded_scripts(t) -> DataFrame:
    from quarry.operators.chunking import embedded_scripts as scripts

    return scripts(t("pages"), "page_id", "html").select("page_id", "part", "body")


@query("WITH b AS (SELECT doc_id AS path, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0), a AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS hash FROM documents WHERE doc_id % 7 <> 0) SELECT path, CASE WHEN b.hash IS NULL THEN 'create' WHEN a.hash IS NULL THEN 'remove' ELSE 'write' END AS event FROM b FULL JOIN a USING (path) WHERE b.hash IS DISTINCT FROM a.hash")
def file_events(t) -> DataFrame:
    d, k = t("documents"), F.col("doc_id")
    before = d.filter(k % 5 != 0).select(k.alias("path"), F.sha2("text", 256).alias("hash"))
    after = d.filter(k % 7 != 0).select(k.alias("path"), F.sha2(F.when(k % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("hash"))
    return watch.events(before, after)


@query("WITH c AS (SELECT doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE text END) AS hash FROM documents WHERE doc_id % 11 <> 0) SELECT d.doc_id AS path, sha256(d.text) AS hash FROM documents d LEFT JOIN c ON c.path = d.doc_id AND c.hash = sha256(d.text) WHERE c.path IS NULL")
def changed_files(t) -> DataFrame:
    d, k = t("documents"), F.col("doc_id")
    cached = d.filter(k % 11 != 0).select(k.alias("path"), F.sha2(F.when(k % 7 == 0, "old").otherwise(F.col("text")), 256).alias("hash"))
    return files.changed(d.select(k.alias("path"), F.sha2("text", 256).alias("hash")), cached)


@query(f"SELECT id FROM {CHUNKS} WHERE file_path <> 'src3/3.go'")
def file_removed(t) -> DataFrame:
    c = made(t, "chunks")
    s = made(t, "symbols").withColumnRenamed("path", "file_path")
    return stores.without_file({"chunks": c, "vectors": made(t, "vectors"), "symbols": s, "refs": made(t, "refs")}, "src3/3.go")["chunks"].select("id")


@query(f"SELECT g.id FROM {twin('changes')} g JOIN {twin('commits')} c ON c.hash = g.commit_hash WHERE date_diff('day', c.date, TIMESTAMP '1999-06-01') <= 30")
def recent_diffs(t) -> DataFrame:
    return watch.recent_changes(made(t, "changes"), made(t, "commits"), F.expr("TIMESTAMP_NTZ '1999-06-01'")).select("id")


@query(f"SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Changed: ' || array_to_string(CASE p_size % 4 WHEN 1 THEN ['a'] WHEN 2 THEN ['a', 'b'] ELSE ['a', 'b', 'c'] END, ', ') || ' ' END || '(+' || p_size || '/-' || p_partkey || ')' AS text FROM part")
def change_texts(t) -> DataFrame:
    names = F.slice(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.lit(1), (F.col("p_size") % 4).cast("int"))
    return t("part").select("p_partkey", summary.change_text(names, F.col("p_size"), F.col("p_partkey")).alias("text"))

