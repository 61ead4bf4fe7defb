"""Operator 4: personal data, and the terms that give it away.

Base spans (email, ip, card, phone) come from the stated patterns. Every letter
term of a document, wherever it stands outside base spans, co-occurs with all
entities of the document. Over all documents N, with n(e), n(t), n(t, e) the
documents that hold an entity, a term, and the two together, a term discloses

    PMI(t, e) / IC(e) = ln(N n(t, e) / (n(e) n(t))) / ln(N / n(e))

of an entity's information (at most 1: the term occurs with it only). Terms that
do so in at least SUPPORT different texts and disclose REMOVE or more are
removed, GENERALISE or more generalised, everywhere in documents that hold both.

Since n(t, e) <= n(e), a term that reaches GENERALISE has
n(t) <= n(e) (N / n(e)) ** (1 - GENERALISE): pairs beyond it are never made.

Defined cases: a null text is empty; a null doc_id is a value of its own;
repeated rows count each and get the same spans; an empty table gives no row;
extra columns are ignored. Spans, counts and terms move; texts only if flagged terms
are too many to go to all executors.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.native import joined, let, none_of, replaced, spans_of
from quarry.llm.storage import documents, keep, only

SUPPORT = 2
#: Flagged terms of all texts that may go to all executors at once.
BROADCAST_FLAGS = 200_000
REMOVE, GENERALISE = 0.95, 0.85
TERM = r"\p{L}{3,}"
KINDS = ["email", "ip", "card", "phone", "removed", "generalised"]
LABELS = ["[EMAIL]", "[IP]", "[CARD]", "[PHONE]", "[...]", "[TERM]"]
#: The base patterns, with starts inside a run and giving back within a run left out: neither can change a match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no match of the kind that passes.
HINTS = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]"}


def passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.coalesce(F.when(F.length(part(x)) <= 3, part(x)).otherwise("999").try_cast("int"), F.lit(0)) <= 255))
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def entity(kind: str, m: Column) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.lower(m) if kind in ("email", "ip") else F.regexp_replace(m, "[^0-9]", ""))


def outside_of_base(text: Column) -> Column:
    """The text with blanks in place of base spans that hold letters (email only), each of its span's length."""
    pattern = PATTERNS["email"]
    blanked = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda g, m: F.concat(g, F.coalesce(F.repeat(F.lit(" "), F.length(m)), F.lit(""))))
    return F.when(text.rlike(HINTS["email"]), F.array_join(blanked, "")).otherwise(text)


def found_in(text: Column) -> Column:
    """Base spans of a text as array<struct<start, kind, end, entity>>."""

    def of(k: int, kind: str) -> Column:
        spans = F.filter(spans_of(text, PATTERNS[kind]), lambda s: passes(kind, s["match"]))
        rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(k).alias("kind"), s["end"].alias("end"), entity(kind, s["match"]).alias("entity")))
        return F.when(text.rlike(HINTS[kind]), rows).otherwise(none_of("struct<start:int,kind:int,end:int,entity:string>"))

    return F.concat(*(of(k, kind) for k, kind in enumerate(PATTERNS)))


def key_of(text: Column) -> Column:
    return F.xxhash64(text)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, found) of every row; key is a hash of the text."""
    text = F.coalesce("text", F.lit(""))
    return only(docs, "doc_id", "text").select("doc_id", key_of(text).alias("key"), found_in(text).alias("found"))


def terms_of(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def hinted(docs: DataFrame) -> DataFrame:
    """(key, text) of all rows that may hold a base span."""
    texts = only(docs, "text").select(key_of(F.col("text")).alias("key"), "text")
    return texts.filter(functools.reduce(lambda a, b: a | b, (F.col("text").rlike(h) for h in HINTS.values())))


def held_entities(found: DataFrame) -> DataFrame:
    """(key, entity, n, n_entity) of the entities in at least SUPPORT texts; n rows have the text, n_entity the entity."""
    held = found.select("key", F.explode(F.array_distinct(F.transform("found", lambda s: s["entity"]))).alias("entity")).groupBy("key", "entity").agg(F.count("*").alias("n"))
    known = held.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")).filter(F.col("texts") >= SUPPORT).drop("texts")
    return held.join(known, "entity").select("key", "entity", "n", "n_entity")


def term_limit(n_entity: Column, total: int) -> Column:
    """Most documents of a term that can reach GENERALISE with an entity, a little more for rounding."""
    return n_entity * F.pow(F.lit(float(total)) / n_entity, F.lit(1 - GENERALISE)) * (1 + 1e-9)


def together(docs: DataFrame, held: DataFrame, total: int) -> DataFrame:
    """(key, entity, term, n, n_entity, n_term) for every entity of a text and every term of it that may disclose the entity."""
    most = held.agg(F.max(term_limit(F.col("n_entity"), total))).first()[0] or 0.0
    of_term = only(docs, "text").select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))
    of_term = of_term.filter((F.col("n_term") >= SUPPORT) & (F.col("n_term") <= most))
    words = hinted(docs).select("key", F.explode(terms_of(outside_of_base(F.col("text")))).alias("term")).join(of_term, "term").distinct()
    return words.join(held, "key").filter(F.col("n_term") <= term_limit(F.col("n_entity"), total))


def disclosing(pairs: DataFrame, total: int) -> DataFrame:
    """(entity, term, disclosure) of the terms that reach GENERALISE, from counts over all documents."""
    both = pairs.groupBy("entity", "term").agg(F.sum("n").alias("n_both"), F.count("*").alias("texts"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    pmi = F.log(F.lit(float(total)) * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    ic = F.log(F.lit(float(total)) / F.col("n_entity"))
    scored = both.filter(F.col("texts") >= SUPPORT).select("entity", "term", F.when(ic > 0, pmi / ic).alias("disclosure"))
    return scored.filter(F.col("disclosure") >= GENERALISE)


def flagged_terms(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, flags): the terms that go, as array<struct<term, kind>>, of the texts that hold them and their entity."""
    total = docs.count()
    held = keep(held_entities(found), "pii-held")
    pairs = keep(together(docs, held, total), "pii-pairs")
    kind = F.when(F.col("disclosure") >= REMOVE, 4).otherwise(5)
    hit = pairs.select("key", "entity", "term").join(disclosing(pairs, total), ["entity", "term"]).groupBy("key", "term").agg(F.min(kind).alias("kind"))
    return hit.groupBy("key").agg(F.collect_list(F.struct("term", "kind")).alias("flags"))


def flagged_spans(text: Column, flags: Column) -> Column:
    """Every place of the flagged terms outside base spans, as array<struct<start, kind, end>>."""
    kinds = F.map_from_entries(flags)
    spans = F.transform(spans_of(outside_of_base(text), TERM), lambda s: F.struct(s["start"].alias("start"), F.try_element_at(kinds, F.lower(s["match"])).alias("kind"), s["end"].alias("end")))
    return F.filter(spans, lambda s: s["kind"].isNotNull())


def term_spans(docs: DataFrame, found: DataFrame) -> DataFrame:
    """(key, terms): the spans that the method adds, of the texts that have any.

    Texts that may hold a base span move only if the flagged terms are too many to go to all executors.
    """
    flags = keep(flagged_terms(docs, found), "pii-flags")
    few = (flags.agg(F.sum(F.size("flags"))).first()[0] or 0) <= BROADCAST_FLAGS
    rows = hinted(docs).join(F.broadcast(flags) if few else flags, "key")
    return rows.select("key", flagged_spans(F.col("text"), F.col("flags")).alias("terms")).groupBy("key").agg(F.first("terms").alias("terms"))


def _joined_terms(left: DataFrame, terms: DataFrame) -> DataFrame:
    return left.join(terms, "key", "left").withColumn("terms", F.coalesce("terms", none_of("struct<start:int,kind:int,end:int>")))


def base_of(found: Column) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def sanitised(docs: DataFrame) -> DataFrame:
    """Documents with base spans and disclosing terms replaced in text, n_chars to match, and all else as it was.

    Texts move only if the added spans are too many to go to all executors.
    """
    terms = keep(term_spans(docs, keep(scanned(docs), "pii")), "pii-terms")
    names = docs.columns
    text = F.coalesce("text", F.lit(""))
    t = terms.select(F.col("key").alias("__k"), F.col("terms").alias("__terms"))
    few = (terms.agg(F.sum(F.size("terms"))).first()[0] or 0) <= BROADCAST_FLAGS
    rows = docs.withColumn("__key", key_of(text))
    rows = rows.join(F.broadcast(t) if few else t, F.col("__key") == F.col("__k"), "left")
    spans = F.concat(base_of(found_in(text)), F.coalesce("__terms", none_of("struct<start:int,kind:int,end:int>")))
    rows = rows.withColumn("__spans", spans).withColumn("text", F.when(F.size("__spans") > 0, replaced(text, F.col("__spans"), LABELS)).otherwise(F.col("text")))
    if "n_chars" in names:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    return rows.select(*(F.col(f"`{n}`") for n in names))


def op4_disclosure_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = keep(scanned(docs), "pii")
    rows = _joined_terms(found.select("doc_id", "key", base_of(F.col("found")).alias("base")), term_spans(docs, found))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", "terms"), KINDS).alias("spans"),
    )
