"""Retrieval and ranking: exact cosine, BM25, fusion, reranking, fuzzy names, recency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two number arrays; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def vector_topk(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", where: Column | None = None) -> DataFrame:
    """The k nearest rows to one query vector; filters come first, ties by id. One pass, a top-k in each task."""
    rows = vectors if where is None else vectors.filter(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(id_col, cosine(F.col("embedding"), q).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Inverted index (id, term, tf, doc_len)."""
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts"))
    return rows.select("id", F.size("ts").alias("doc_len"), F.explode("ts").alias("term")).groupBy("id", "doc_len", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, terms: list[str], k: int, mode: str = "and", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """BM25 top-k for a few literal terms (all of them, or any). Terms are looked up while texts are read; nothing else is indexed."""
    terms = list(dict.fromkeys(t.lower() for t in terms))
    wanted = F.array(*(F.lit(t) for t in terms))
    rows = docs.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("ts")).select("id", F.size("ts").alias("n"), F.filter("ts", lambda t: F.array_contains(wanted, t)).alias("hits"))
    stats = rows.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *(F.count_if(F.array_contains("hits", t)).alias(f"df{i}") for i, t in enumerate(terms))).first()
    score = F.lit(0.0)
    for i, t in enumerate(terms):
        n = stats[f"df{i}"] or 0
        idf = F.greatest(F.log((F.lit(float(stats["docs"])) - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        f = F.size(F.filter("hits", lambda x: x == F.lit(t))).cast("double")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.lit(float(stats["avg_n"] or 1.0))))
    matched = F.size(F.array_distinct("hits")) >= (len(terms) if mode == "and" else 1)
    return rows.filter(matched).select("id", score.alias("bm25")).orderBy(F.desc("bm25"), "id").limit(k)


def fuse(vector: DataFrame, text: DataFrame, limit: int, wv: float = 0.7, wb: float = 0.3, norm: str = "monotone") -> DataFrame:
    """Weighted sum of two scored candidate lists (id, score) and (id, bm25); a missing side counts 0."""
    b = F.abs("bm25")
    nb = b / (1 + b) if norm == "monotone" else 1 / (1 + b)
    both = vector.join(text.select("id", nb.alias("b")), "id", "full_outer")
    score = wv * F.coalesce("score", F.lit(0.0)) + wb * F.coalesce("b", F.lit(0.0))
    return both.select("id", score.alias("fused")).orderBy(F.desc("fused"), "id").limit(limit)


def rerank_blend(rows: DataFrame, scores: DataFrame | None) -> DataFrame:
    """0.3 original + 0.7 reranked; rows without a score, or no scores at all, keep the original."""
    if scores is None:
        return rows
    return rows.join(scores, "id", "left").select("id", F.when(F.col("rerank").isNull(), F.col("fused")).otherwise(0.3 * F.col("fused") + 0.7 * F.col("rerank")).alias("fused"))


def rank_scores(rows: DataFrame) -> DataFrame:
    """(id, rerank) of a candidate list (id, fused), a top-k of bounded length: (n - rank + 1) / n, ties by id."""
    n = F.count("*").over(W.partitionBy())
    return rows.select("id", ((n - F.row_number().over(W.orderBy(F.desc("fused"), "id")) + 1) / n).alias("rerank"))


def fuzzy_score(name: Column, query: str) -> Column:
    """Exact 1, prefix 0.9, contained 0.7, else the share of the query's parts that start a part of the name times 0.8."""
    n, q = F.lower(name), query.lower()
    parts = name_parts(name)
    hits = sum((F.exists(parts, _starts(w)).cast("int") for w in q.replace("-", "_").replace(" ", "_").split("_") if w), F.lit(0))
    words = max(1, len([w for w in q.replace("-", "_").replace(" ", "_").split("_") if w]))
    return F.when(n == q, 1.0).when(n.startswith(q), 0.9).when(n.contains(q), 0.7).otherwise(hits / words * 0.8)


def _starts(word: str):
    return lambda p: p.startswith(word)


def name_parts(name: Column) -> Column:
    """Parts of an identifier: split at separators and before each capital, lower-cased."""
    return F.filter(F.split(F.lower(F.regexp_replace(name, r"(\p{Lu})", "_$1")), r"[_\-. ]+"), lambda p: p != "")


def recency(age_hours: Column, days: float = 30.0) -> Column:
    return F.exp(-age_hours / (24.0 * days * 0.6931471805599453))


def line_matches(docs: DataFrame, pattern: str, literal: bool = False, ignore_case: bool = True) -> DataFrame:
    """Lines of texts (id, line, content) that match a regular expression or a literal."""
    rows = docs.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("at", "content"))
    if literal:
        hit = F.lower("content").contains(pattern.lower()) if ignore_case else F.col("content").contains(pattern)
    else:
        hit = F.col("content").rlike(f"(?i){pattern}" if ignore_case else pattern)
    return rows.filter(hit).select("id", (F.col("at") + 1).cast("long").alias("line"), "content")


def line_context(docs: DataFrame, pattern: str, around: int) -> DataFrame:
    """Lines that match (id, line), each with the lines around it, as far as the text has them (context); only hits leave the text's row."""
    rows = docs.filter(F.col("text").rlike(f"(?im){pattern}") if not set("^$") & set(pattern) and "(?" not in pattern else F.lit(True)).select(F.col("doc_id").alias("id"), F.split("text", "\n").alias("ls"))

    def hit(at: Column) -> Column:
        first = F.greatest(F.lit(1), at - around)
        return F.struct(at.cast("long").alias("line"), F.array_join(F.slice("ls", first, at + around + 1 - first), "\n").alias("context"))

    hits = F.filter(F.sequence(F.lit(1), F.size("ls")), lambda k: F.element_at("ls", k).rlike(f"(?i){pattern}"))
    return rows.select("id", F.explode(F.transform(hits, hit)).alias("h")).select("id", "h.line", "h.context")
