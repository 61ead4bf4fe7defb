"""Record tables in the engine's own shapes, made of the test tables by SQL that both engines read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame

NOW = "TIMESTAMP '2001-12-01 00:00:00'"
STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN o_orderkey % 5 = 0 THEN 'blocked' WHEN o_orderkey % 7 = 0 THEN 'in_progress' ELSE 'pending' END ELSE 'cancelled' END"
PRIORITY = "CASE substring(o_orderpriority, 1, 1) WHEN '1' THEN 'urgent' WHEN '2' THEN 'high' WHEN '3' THEN 'medium' ELSE 'low' END"
KIND = "CASE p_size % 6 WHEN 0 THEN 'function' WHEN 1 THEN 'method' WHEN 2 THEN 'type' WHEN 3 THEN 'interface' WHEN 4 THEN 'function' ELSE 'variable' END"
#: A name that shows every rule: constructors, handlers, callbacks, tests, entry points, private and plain names.
NAME = "CASE p_partkey % 23 WHEN 0 THEN concat('New', cast(p_partkey AS STRING)) WHEN 1 THEN concat('userHandler', cast(p_size AS STRING)) WHEN 2 THEN concat('onClick', cast(p_size AS STRING)) WHEN 3 THEN concat('TestPart', cast(p_size AS STRING)) WHEN 4 THEN concat('_hidden', cast(p_partkey AS STRING)) WHEN 5 THEN concat('handleOrder', cast(p_size AS STRING)) WHEN 6 THEN concat('RunJob', cast(p_partkey AS STRING)) WHEN 7 THEN concat('middleware', cast(p_partkey AS STRING)) WHEN 8 THEN CASE WHEN p_partkey % 115 = 8 THEN 'main' ELSE concat('ServeHTTP', cast(p_partkey AS STRING)) END ELSE concat('part', cast(p_partkey AS STRING)) END"
LANGUAGE = "CASE p_partkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'typescript' WHEN 3 THEN 'java' ELSE 'ruby' END"
PATH = "concat('src/', lower(p_type), '/f', cast(p_partkey % 40 AS STRING), CASE WHEN p_partkey % 17 = 0 THEN '_test.go' ELSE '.go' END)"

SHAPES = {
    "todos": f"SELECT concat('t', cast(o_orderkey AS STRING)) AS id, concat('Order of ', cast(o_custkey AS STRING)) AS title, {STATUS} AS status, {PRIORITY} AS priority, split(concat('o', cast(o_orderkey % 4 AS STRING), ',Ship', cast(o_custkey % 3 AS STRING)), ',') AS tags, CASE WHEN o_orderkey % 6 = 0 THEN concat('t', cast(o_orderkey - 1 AS STRING)) END AS parent_id, concat('c', cast(o_custkey % 3 AS STRING)) AS channel, o_orderdate AS created_at, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate + INTERVAL '900' DAY END AS due_date FROM {{orders}}",
    "memories": "SELECT concat('m', cast(event_id AS STRING)) AS id, event_type AS category, concat('u', cast(user_id % 5 AS STRING)) AS channel, concat('s', cast(user_id AS STRING)) AS session_id, value / 100 AS importance, CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0.9 END AS confidence, cast(event_id % 50 AS INT) AS access_count, split(concat(event_type, ',k', cast(event_id % 7 AS STRING)), ',') AS tags, ts AS created_at, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL '1' DAY END AS accessed_at, CASE WHEN event_id % 4 = 0 THEN ts + INTERVAL '10' DAY END AS expires_at FROM {events}",
    "sessions": "SELECT concat('s', cast(c_custkey AS STRING)) AS id, c_mktsegment AS agent, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR AS started_at, CASE WHEN c_custkey % 3 = 0 THEN TIMESTAMP '2024-01-02 00:00:00' END AS ended_at FROM {customer}",
    "notes": "SELECT concat('n', cast(conv_id AS STRING), '-', cast(turn AS STRING)) AS id, concat('Turn ', cast(turn AS STRING), ' by ', role) AS title, text AS content, concat('src/', role, '.go') AS file, CASE WHEN turn % 2 = 0 THEN 'Ai' ELSE 'human' END AS author, CASE WHEN conv_id % 2 = 0 THEN 'main' ELSE 'dev' END AS branch, split(concat(role, ',t', cast(turn AS STRING)), ',') AS tags, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' HOUR AS created_at FROM {conversations}",
    "decisions": "SELECT concat('d', cast(p_partkey AS STRING)) AS id, p_name AS title, CASE p_size % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'accepted' WHEN 2 THEN 'deprecated' ELSE 'superseded' END AS status, p_type AS context, concat('use ', p_brand) AS decision, cast(NULL AS STRING) AS superseded_by, CASE WHEN p_partkey % 2 = 0 THEN 'Ann' ELSE 'bob' END AS author, TIMESTAMP '2024-01-01 00:00:00' AS created_at, TIMESTAMP '2024-01-01 00:00:00' AS updated_at FROM {part}",
    "issues": "SELECT concat('i', cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING)) AS id, concat('line ', cast(l_linenumber AS STRING)) AS title, concat('part ', cast(l_partkey AS STRING)) AS description, CASE l_returnflag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'major' ELSE 'minor' END AS severity, concat('f', cast(l_suppkey AS STRING), '.go') AS file, CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_linenumber % 2 = 0 THEN 'open' ELSE 'investigating' END ELSE 'resolved' END AS status, l_shipdate AS created_at, l_shipdate AS updated_at, CASE WHEN l_linestatus <> 'O' THEN l_shipdate END AS resolved_at FROM {lineitem}",
    "work_items": f"SELECT concat('w', cast(o_orderkey AS STRING)) AS id, concat('Order of ', cast(o_custkey AS STRING)) AS title, o_orderpriority AS description, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'in_progress' ELSE 'pending' END AS status, {PRIORITY} AS priority, concat('f', cast(o_custkey % 9 AS STRING), '.py') AS file, CASE WHEN o_orderkey % 2 = 0 THEN 'Ann' ELSE 'bob' END AS assignee, o_orderdate AS created_at, o_orderdate + INTERVAL '30' DAY AS due_date FROM {{orders}}",
    "commits": "SELECT concat('h', cast(o_orderkey AS STRING)) AS hash, concat('Author ', cast(o_custkey % 50 AS STRING)) AS author, concat('a', cast(o_custkey % 50 AS STRING), '@x.org') AS author_email, o_orderdate AS date, concat('Change ', lower(o_orderpriority)) AS message FROM {orders}",
    "changes": "SELECT DISTINCT concat('h', cast(l_orderkey AS STRING), ':', cast(l_linenumber AS STRING), ':', cast(l_partkey AS STRING), ':', cast(l_suppkey AS STRING), l_returnflag) AS id, concat('h', cast(l_orderkey AS STRING)) AS commit_hash, concat('src/d', cast(l_suppkey % 20 AS STRING), '/f', cast(l_partkey % 50 AS STRING), '.go') AS file_path, CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'A' ELSE 'M' END AS change_type, split(concat('part', cast(l_partkey AS STRING), ',Open', cast(l_linenumber AS STRING)), ',') AS affected_functions FROM {lineitem}",
    "symbols": f"SELECT concat({PATH}, ':', {NAME}, ':', cast(p_partkey AS STRING)) AS id, {NAME} AS name, {KIND} AS kind, {PATH} AS path, {LANGUAGE} AS language, CASE WHEN p_size % 3 = 0 THEN 'public' WHEN p_size % 3 = 1 THEN 'private' ELSE '' END AS visibility, cast(p_size * 3 AS BIGINT) AS line_count, p_partkey AS line FROM {{part}}",
    "refs": f"SELECT DISTINCT concat('r', cast(l_orderkey AS STRING), '-', cast(l_linenumber AS STRING), '-', cast(l_partkey AS STRING), '-', cast(l_suppkey AS STRING), l_linestatus) AS id, concat('part', cast(l_partkey AS STRING)) AS from_symbol, CASE l_linenumber % 3 WHEN 0 THEN concat('pkg.part', cast(l_suppkey AS STRING)) ELSE concat('part', cast(l_suppkey * 2 AS STRING)) END AS to_symbol, CASE l_returnflag WHEN 'R' THEN 'import' WHEN 'A' THEN 'type_use' ELSE 'call' END AS kind, concat('src/economy/f', cast(l_partkey % 40 AS STRING), '.go') AS file_path, l_linestatus = 'F' AS is_external FROM {{lineitem}} WHERE l_returnflag = 'N'",
    "chunks": "SELECT concat('k', cast(doc_id AS STRING)) AS id, text AS content, concat('doc', cast(doc_id AS STRING)) AS name, lang AS language, CASE WHEN doc_id % 2 = 0 THEN 'function' ELSE 'block' END AS chunk_type, concat(source, '/', cast(doc_id % 25 AS STRING), '.go') AS file_path, doc_id % 90 + 1 AS start_line, doc_id % 90 + 20 AS end_line FROM {documents}",
    "vectors": "SELECT concat('k', cast(vec_id AS STRING)) AS chunk_id, embedding FROM {embeddings}",
    "hunks": "SELECT DISTINCT concat('h', cast(l_orderkey AS STRING), ':', cast(l_linenumber AS STRING)) AS change_id, concat('src', cast(l_suppkey % 20 AS STRING), '/', cast(l_partkey % 25 AS STRING), '.go') AS file_path, cast(l_quantity AS BIGINT) AS new_start, cast(l_linenumber AS BIGINT) AS new_lines FROM {lineitem}",
}


def made(t, name: str) -> DataFrame:
    """A shape as a DataFrame; t reads a test table."""
    tables = {x: t(x) for x in ("orders", "events", "customer", "conversations", "part", "lineitem", "documents", "embeddings") if f"{{{x}}}" in SHAPES[name]}
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(SHAPES[name], **tables)


def twin(name: str) -> str:
    """The same shape for the other engine, as a subquery."""
    return "(" + SHAPES[name].replace("{", "").replace("}", "") + ")"
