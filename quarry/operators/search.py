"""Search as a user means it: a query text becomes ranked rows with their content and context.

A query has words (all must occur), "phrases", AND, OR and NOT, in this order of
binding: neighbours, NOT, AND, OR. Words are folded (case, accents) and stemmed;
only words that begin as a query's stem does are ever stemmed, so Python sees a
small part of the texts. Scores are BM25 over all of a row's text columns taken as
one text; a phrase counts as one term.

Defined cases: a null text is empty; a query without a word finds nothing; a query
that cannot be parsed raises QueryError, and `search` then ranks by vectors alone
(R05); ids must be unique, ties are ordered by them; empty tables give no row.
"""

from __future__ import annotations

import dataclasses
import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, StringType

from quarry.functions.stemming import LOOSE_END, stem
from quarry.operators import filters, retrieval, tables

#: Signs that a query may hold without meaning: they part words.
BLANKS = "*():-^~"
#: Signs that make a query unreadable outside quotes.
UNREADABLE = ".,?'/"


class QueryError(ValueError):
    """A query that cannot be parsed."""


@dataclasses.dataclass(frozen=True)
class Term:
    """A phrase of one or more stems."""

    stems: tuple[str, ...]


@dataclasses.dataclass(frozen=True)
class Op:
    name: str
    left: Term | Op
    right: Term | Op


def folded(text: Column) -> Column:
    """Words of a text as they are indexed, unstemmed: lower-case, without accents."""
    plain = F.translate(F.lower(text), _ACCENTED, _PLAIN)
    return F.regexp_extract_all(F.regexp_replace(plain, r"\p{Mn}+", ""), F.lit(retrieval.TOKEN), F.lit(0))


def _accents() -> tuple[str, str]:
    """Letters with accents and their base letters, by the Unicode tables."""
    pairs = {}
    for cp in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(cp).lower())[0]
        if base != chr(cp).lower() and len(chr(cp).lower()) == 1:
            pairs[chr(cp).lower()] = base
    return "".join(pairs), "".join(pairs.values())


_ACCENTED, _PLAIN = _accents()


def words_of(text: str) -> list[str]:
    low = unicodedata.normalize("NFD", text.lower())
    return re.findall(r"[^\W_]+", "".join(c for c in low if unicodedata.category(c) != "Mn"))


def _tokens(query: str) -> Iterator[str | Term]:
    if query.count('"') % 2:
        raise QueryError("a quote isn't closed")
    for k, part in enumerate(query.split('"')):
        if k % 2:
            yield Term(tuple(stem(w) for w in words_of(part)))
            continue
        if any(c in UNREADABLE for c in part):
            raise QueryError(f"{part!r} has a sign outside quotes")
        for word in part.translate({ord(c): " " for c in BLANKS}).split():
            yield word if word in ("AND", "OR", "NOT") else Term(tuple(stem(w) for w in words_of(word)))


def parse(query: str) -> Term | Op | None:
    """The query's tree; None if it has no word."""
    todo = [t for t in _tokens(query) if t != Term(())]

    def near() -> Term | Op:
        if not todo or isinstance(todo[0], str):
            raise QueryError("a term is missing")
        out: Term | Op = todo.pop(0)
        while todo and not isinstance(todo[0], str):
            out = Op("AND", out, todo.pop(0))
        return out

    def chain(name: str, below) -> Term | Op:
        out = below()
        while todo and todo[0] == name:
            todo.pop(0)
            out = Op(name, out, below())
        return out

    if not todo:
        return None
    out = chain("OR", lambda: chain("AND", lambda: chain("NOT", near)))
    if todo:
        raise QueryError(f"{todo[0]} has no place")
    return out


def _terms(tree: Term | Op) -> list[Term]:
    return [tree] if isinstance(tree, Term) else _terms(tree.left) + _terms(tree.right)


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: [stem(w) for w in ws])


def text_search(table: DataFrame, query: str, k: int, id_col: str = "id", columns: tuple[str, ...] = ("content",), where: Column | None = None) -> DataFrame:
    """(id, bm25) of the k best rows for a query; `where` keeps rows before they are ranked, statistics are of all rows."""
    spark, tree = table.sparkSession, parse(query)
    kind = table.schema[id_col].dataType.simpleString()
    if tree is None:
        return spark.createDataFrame([], f"id {kind}, bm25 double")
    terms = list(dict.fromkeys(_terms(tree)))
    stems = list(dict.fromkeys(s for t in terms for s in t.stems))
    begins = {s[: max(1, len(s) - LOOSE_END)] for s in stems}
    text = F.concat_ws(" ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    passes = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
    rows = table.select(F.col(id_col).alias("id"), passes.alias("passes"), folded(text).alias("ws"))
    # words stay in their text's row: an exploded word would carry all words of its text to Python and into its queue on disk
    near = lambda x: filters.some(*(x["w"].startswith(b) for b in begins))
    rows = rows.select("id", "passes", F.size("ws").alias("n"), F.filter(F.transform("ws", lambda w, at: F.struct(at.alias("at"), w.alias("w"))), near).alias("near"))
    marks = rows.select("id", "passes", "n", F.arrays_zip(F.col("near.at").alias("at"), _stems(F.col("near.w")).alias("s")).alias("marks"))
    at = lambda s, shift=0: F.transform(F.filter("marks", lambda x: x["s"] == s), lambda x: x["at"] - shift)

    def times(term: Term) -> Column:
        return F.size(functools.reduce(F.array_intersect, (at(s, k) for k, s in enumerate(term.stems))))

    # texts are read once: what is kept is a row of numbers for each
    hits = tables.kept(marks.select("id", "passes", "n", *(times(t).alias(f"f{i}") for i, t in enumerate(terms))))
    stats = hits.agg(F.count("*").alias("docs"), F.avg("n").alias("avg_n"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms)))).first()

    def holds(t: Term | Op) -> Column:
        if isinstance(t, Term):
            return F.col(f"f{terms.index(t)}") > 0
        a, b = holds(t.left), holds(t.right)
        return a & b if t.name == "AND" else a | b if t.name == "OR" else a & ~b

    score = F.lit(0.0)
    for i, t in enumerate(terms):
        n, f = stats[f"d{i}"] or 0, F.col(f"f{i}").cast("double")
        idf = F.greatest(F.log((F.lit(float(stats["docs"])) - n + 0.5) / (n + 0.5)), F.lit(1e-6))
        score = score + idf * f * (retrieval.K1 + 1) / (f + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("n") / F.lit(float(stats["avg_n"] or 1.0))))
    return hits.filter(F.col("passes") & holds(tree)).select("id", score.alias("bm25")).orderBy(F.desc("bm25"), "id").limit(k)


@dataclasses.dataclass(frozen=True)
class Request:
    """What a search asks for; the defaults are the engine's (R06)."""

    query: str = ""
    vector: list[float] | None = None
    mode: str = "hybrid"  # or vector, bm25
    limit: int = 10
    vector_weight: float = 0.7
    bm25_weight: float = 0.3
    rerank_candidates: int = 0
    languages: tuple[str, ...] = ()
    chunk_types: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    norm: str = "monotone"  # Q01: "inverse" weighs weak matches more


def _wanted(request: Request) -> Column | None:
    """Filters that hold before anything is ranked; paths are globs (F02, an extension)."""
    from quarry.functions.code import matches_glob

    tests = [filters.one_of("language", list(request.languages)), filters.one_of("chunk_type", list(request.chunk_types))]
    if request.paths:
        tests.append(filters.some(*(matches_glob(F.col("file_path"), p) for p in request.paths)))
    return filters.every(*tests) if any(t is not None for t in tests) else None


def search(chunks: DataFrame, vectors: DataFrame, request: Request, reranker=None) -> DataFrame:
    """Ranked chunks, all their columns and `score`.

    chunks has id, content, name, language, chunk_type and file_path; vectors has
    chunk_id and embedding. A reranker is a function of (query, rows (id, content))
    to rows (id, rerank) and sees all candidates (Q02); if it raises, the order
    before it stands (Q03).
    """
    pool = request.rerank_candidates if reranker else 0
    each = max(pool, 3 * request.limit) if request.mode == "hybrid" else max(pool, request.limit)
    where, near, text = _wanted(request), None, None
    if request.vector is not None and request.mode != "bm25":
        rows = vectors.join(chunks.select(F.col("id").alias("chunk_id"), "language", "chunk_type", "file_path"), "chunk_id")
        near = retrieval.vector_topk(rows, request.vector, each, "chunk_id", where).select(F.col("chunk_id").alias("id"), "score")
    if request.query and request.mode != "vector":
        try:
            text = text_search(chunks, request.query, each, "id", ("id", "content", "name"), where)
        except QueryError:
            if near is None:
                raise
    if near is not None and text is not None:
        hits = retrieval.fuse(near, text, max(pool, request.limit), request.vector_weight, request.bm25_weight, request.norm)
    elif near is not None:
        hits = near.select("id", F.col("score").alias("fused"))
    elif text is not None:
        b = F.abs("bm25")
        hits = text.select("id", (b / (1 + b) if request.norm == "monotone" else 1 / (1 + b)).alias("fused"))
    else:
        hits = chunks.select("id", F.lit(0.0).alias("fused")).limit(0)
    if reranker is not None:
        try:
            hits = retrieval.rerank_blend(hits, reranker(request.query, hits.join(chunks.select("id", "content"), "id")))
        except Exception:  # noqa: BLE001  whatever a reranker does, results stand
            pass
    hits = hits.orderBy(F.desc("fused"), "id").limit(request.limit)  # a top-k: small enough for every executor
    return chunks.join(F.broadcast(hits.withColumnRenamed("fused", "score")), "id").select(*chunks.columns, "score").orderBy(F.desc("score"), "id")


def with_context(hits: DataFrame, files: DataFrame, around: int = 5) -> DataFrame:
    """Hits (file_path, start_line, end_line) with the lines around them in files (path, content), as far as the file has them."""
    rows = hits.join(files.select(F.col("path").alias("file_path"), F.split("content", "\n").alias("__ls")), "file_path", "left")
    first = F.greatest(F.lit(1), F.col("start_line") - around).cast("int")
    before = F.array_join(F.slice("__ls", first, F.greatest(F.lit(0), F.col("start_line").cast("int") - first)), "\n")
    after = F.array_join(F.slice("__ls", (F.col("end_line") + 1).cast("int"), F.lit(around)), "\n")
    return rows.withColumns({"context_before": F.coalesce(before, F.lit("")), "context_after": F.coalesce(after, F.lit(""))}).drop("__ls")


def chunk_of(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, id): the chunk of each id or symbol id path:name:line (column `wanted`); the narrowest chunk of the path that covers the line."""
    w = wanted.select("wanted").distinct()
    exact = w.join(chunks.select(F.col("id").alias("wanted"), "id"), "wanted")
    parts = F.split("wanted", ":")
    path = F.array_join(F.slice(parts, F.lit(1), F.greatest(F.lit(0), F.size(parts) - 2)), ":")
    other = w.join(exact, "wanted", "left_anti").filter(F.size(parts) >= 3).select("wanted", path.alias("file_path"), F.try_element_at(parts, F.lit(-1)).try_cast("long").alias("line"))
    cover = other.join(chunks.select("file_path", "start_line", "end_line", "id"), "file_path").filter(F.col("line").between(F.col("start_line"), F.col("end_line")))
    best = cover.groupBy("wanted").agg(F.min_by("id", F.struct(F.col("end_line") - F.col("start_line"), F.col("id"))).alias("id"))
    return exact.select("wanted", "id").unionByName(best)


def symbols_in_chunks(symbols: DataFrame, chunks: DataFrame, bin_lines: int = 64) -> DataFrame:
    """(symbol_id, chunk_id): chunks whose lines hold the symbol's; they meet in bins of lines, so a large file isn't one key."""
    s = symbols.select(F.col("id").alias("symbol_id"), F.col("path").alias("file_path"), "line", F.floor(F.col("line") / bin_lines).alias("bin"))
    c = chunks.select(F.col("id").alias("chunk_id"), "file_path", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))).alias("bin"))
    return s.join(c, ["file_path", "bin"]).filter(F.col("line").between(F.col("start_line"), F.col("end_line"))).select("symbol_id", "chunk_id")


#: Ids of chunks of one file and range that travel in one row, and parts that one bin's hunks are dealt to.
BLOCK, SALTS = 1024, 8


def overlapping(hunks: DataFrame, chunks: DataFrame, bin_lines: int = 64) -> DataFrame:
    """Distinct (change_id, chunk_id) of hunks (change_id, file_path, new_start, new_lines) and chunks of the same file whose lines overlap, ends included.

    Pairs may be thousands for each hunk, so none is shuffled: hunks are made one row
    for a change's ranges in a file, chunks of the same range share rows, and a pair
    comes from the first bin that both lie in. Only chunks whose id stands for several
    ranges need their pairs made distinct.
    """
    lo, hi = F.col("new_start"), F.col("new_start") + F.col("new_lines")
    bin_of = lambda x: F.floor(x / bin_lines)
    salt = F.pmod(F.xxhash64("change_id"), F.lit(SALTS)).cast("int").alias("salt")
    spans = hunks.select("change_id", "file_path", lo.alias("lo"), hi.alias("hi")).filter("lo is not null and hi is not null and file_path is not null")
    spans = spans.groupBy("change_id", "file_path").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))
    bins = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda x: F.sequence(bin_of(x["lo"]), bin_of(x["hi"]))))))
    spans = spans.select("change_id", "file_path", "spans", bins.alias("bins"), salt).select("*", F.explode("bins").alias("bin"))

    ranges = chunks.select(F.col("id").alias("chunk_id"), "file_path", "start_line", "end_line").distinct()
    ranges = ranges.filter("start_line is not null and end_line is not null and file_path is not null").withColumn("n", F.count("*").over(W.partitionBy("chunk_id")))
    at = ["file_path", "start_line", "end_line"]
    block = F.floor((F.row_number().over(W.partitionBy("n", *at).orderBy("chunk_id")) - 1) / BLOCK).alias("block")
    # a list leaves nulls out, and a null may be an id
    ranges = ranges.withColumn("n", F.col("n") > 1).select("*", block).groupBy("n", *at, "block").agg(F.collect_list(F.struct("chunk_id")).alias("ids"))
    ranges = ranges.select("n", *at, "ids", F.explode(F.sequence(bin_of(F.col("start_line")), bin_of(F.col("end_line")))).alias("bin"))
    ranges = ranges.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def met(rows: DataFrame, hit: Column, several: bool) -> DataFrame:
        some = ranges.filter("n" if several else "not n")
        pairs = rows.join(some.hint("merge"), ["file_path", "bin", "salt"]).filter(hit)
        return pairs.select("change_id", F.explode("ids").alias("c")).select("change_id", "c.chunk_id")

    hits = lambda x: (x["lo"] <= F.col("end_line")) & (x["hi"] >= F.col("start_line"))
    first = F.greatest(F.element_at("bins", 1), bin_of(F.col("start_line"))) == F.col("bin")
    one, more = (F.size("spans") == 1), (F.size("spans") > 1)
    single = spans.filter(one).select("change_id", "file_path", "bin", "salt", "bins", F.col("spans")[0]["lo"].alias("lo"), F.col("spans")[0]["hi"].alias("hi"))
    first_of = F.array_min(F.filter("bins", lambda b: b >= bin_of(F.col("start_line")))) == F.col("bin")
    in_one = met(single, (F.col("lo") <= F.col("end_line")) & (F.col("hi") >= F.col("start_line")) & first, False)
    in_more = met(spans.filter(more), first_of & F.exists("spans", hits), False)
    return in_one.unionByName(in_more).unionByName(met(spans, F.exists("spans", hits), True).distinct())


def changed_chunks_by_name(changes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct (change_id, chunk_id): chunks of a changed file whose name is among the change's affected functions."""
    c = changes.select(F.col("id").alias("change_id"), "file_path", F.explode("affected_functions").alias("name"))
    return c.join(chunks.select(F.col("id").alias("chunk_id"), "file_path", "name"), ["file_path", "name"]).select("change_id", "chunk_id").distinct()


def unindexed(table: DataFrame, postings: DataFrame) -> DataFrame:
    """Ids (id) of a table that no posting has: what an index lacks and a rebuild would add; texts without a word are among them."""
    return table.select("id").join(postings.select("id").distinct(), "id", "left_anti")


def averaged(near: DataFrame, text: DataFrame) -> DataFrame:
    """(id, vector_score) of two candidate lists (id, score) and (id, bm25): the mean where both have a row, else the one (J08)."""
    b = F.abs("bm25")
    both = near.join(text.select("id", (b / (1 + b)).alias("b")), "id", "full_outer")
    return both.select("id", F.when(F.col("score").isNotNull() & F.col("b").isNotNull(), (F.col("score") + F.col("b")) / 2).otherwise(F.coalesce("score", "b")).alias("vector_score"))


def recall(memories: DataFrame, candidates: DataFrame, now: Column, limit: int | None, weights: tuple[float, float, float, float] = (0.5, 0.2, 0.2, 0.1)) -> DataFrame:
    """Memories among candidates (id, vector_score) by a weighted sum of likeness, recency of access, importance times confidence, and accesses.

    Recency decays as exp(-hours / (720 ln 2)) (Q08). What is returned isn't
    touched: `stores.touched` does that.
    """
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.coalesce("accessed_at", "created_at").cast("timestamp"))) / 3.6e9
    parts = (F.col("vector_score"), retrieval.recency(age), F.col("importance") * F.col("confidence"), F.least(F.lit(1.0), F.log10(F.greatest(F.coalesce("access_count", F.lit(0)), F.lit(0)) + 1) / 3))
    score = sum((w * p for w, p in zip(weights, parts)), F.lit(0.0))
    rows = memories.join(candidates, "id").withColumn("score", score).orderBy(F.desc("score"), "id")
    return rows if limit is None else rows.limit(limit)


def ranked_todos(todos: DataFrame, now: Column, limit: int, candidates: DataFrame | None = None) -> DataFrame:
    """Todos by their base score (1 without a query, else of candidates (id, vector_score)) with bonuses for priority and for what is due."""
    rows = todos.withColumn("score", F.lit(1.0)) if candidates is None else todos.join(candidates, "id").withColumnRenamed("vector_score", "score")
    days = (F.unix_micros(F.col("due_date").cast("timestamp")) - F.unix_micros(now.cast("timestamp"))) / 86_400e6
    bonus = F.when(F.col("priority") == "urgent", 0.4).when(F.col("priority") == "high", 0.2).when(F.col("priority") == "medium", 0.1).otherwise(0.0)
    due = F.when(days < 0, 0.5).when(days < 1, 0.3).when(days < 7, 0.1).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + bonus + due).orderBy(F.desc("score"), "id").limit(limit)


def history_hits(changes: DataFrame, message_hits: DataFrame, diff_hits: DataFrame, now: Column, limit: int | None, half_life_factor: float = 1.0) -> DataFrame:
    """Changes (id, commit_hash, date and more, already filtered) of commits in message_hits (hash) or themselves in diff_hits (id).

    A message hit counts 0.4, a diff hit 0.4 (Q11), recency 0.2, decaying over 30 /
    half_life_factor days.
    """
    m = message_hits.select(F.col("hash").alias("commit_hash"), F.lit(1.0).alias("message_score")).distinct()
    d = diff_hits.select("id", F.lit(1.0).alias("diff_score")).distinct()
    rows = changes.join(m, "commit_hash", "left").join(d, "id", "left").filter("message_score is not null or diff_score is not null")
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("date").cast("timestamp"))) / 3.6e9
    part = lambda c: F.coalesce(c, F.lit(0.0))
    score = 0.4 * part("message_score") + 0.4 * part("diff_score") + 0.2 * retrieval.recency(age, 30.0 / half_life_factor)
    rows = rows.select(*changes.columns, score.alias("score")).orderBy(F.desc("score"), "id")
    return rows if limit is None else rows.limit(limit)


def fuzzy_files(files: DataFrame, query: str, limit: int | None = 20) -> DataFrame:
    """(path, score) of files by name: the whole name, its beginning, part of it or of the path, else likeness by common subsequence; over 0.2."""
    from quarry.operators.chunking import lcs_scores

    q = query.lower()
    low = F.lower("path")
    name = F.substring_index(low, "/", -1)
    score = F.when(name == q, 1.0).when(name.startswith(q), 0.9).when(name.contains(q), 0.7).when(low.contains(q), 0.5)
    sure = files.select("path", score.alias("score"))
    # only names that no rule fits are compared letter by letter
    rest = sure.filter("score is null").select("path", (lcs_scores(q)(F.substring_index(F.lower("path"), "/", -1)) * 0.4).alias("score"))
    rows = sure.filter("score is not null").unionByName(rest).filter(F.col("score") > 0.2).orderBy(F.desc("score"), "path")
    return rows if limit is None else rows.limit(limit)


def similar_names(names: DataFrame, query: str, most: int = 3) -> DataFrame:
    """(name, place) of the first names (name, place) that hold the query, lie in it, or differ from it in three letters at most."""
    low, q = F.lower("name"), query.lower()
    return names.filter(low.contains(q) | F.lit(q).contains(low) | (F.levenshtein(low, F.lit(q)) <= 3)).orderBy("place").limit(most)
