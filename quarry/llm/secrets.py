"""Operator 6: secrets, and weak parts that only count together.

Base spans (assign, access, hex) come from the stated patterns. Weak parts are
looked for besides: identifiers (user or key names being set, short access
identifiers), secrets (mixed tokens of 20 characters or more, short passwords
being set) and endpoints (addresses with a scheme or a port). A weak part is
reported only if a complementary part, weak or base, begins within SCOPE
characters of it in the same text: a secret needs an identifier or an endpoint,
those two need a secret. Parts meet in an interval join on cells of SCOPE
characters, each with its two neighbours, so a text's parts never all pair up.

Defined cases: a null text is empty; rows that repeat or lack a doc_id get their
own equal spans; an empty table gives no row; extra columns are ignored. Only
places of parts move, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.native import joined, none_of, replaced, spans_of
from quarry.llm.storage import documents, keep, only

SCOPE = 400
KINDS = ["assign", "access", "hex", "weak_identifier", "weak_secret", "weak_endpoint"]
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Pattern, what a text must have for any match to pass, and whether a match passes. Shorter runs of the last two kinds never pass.
BASE = {
    "assign": (ASSIGN, r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]""", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
    "access": (r"AKIA[A-Z0-9]{16,}+", "AKIA", None),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{24,}+", r"[0-9a-f]{24}", None),
}
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
WEAK = {
    "weak_identifier": (
        r"""(?i)\b(?:access_?key_?id|client_?id|user_?(?:name|id)?|login|account)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}|\bAKIA[A-Z0-9]{4,15}+(?![A-Z0-9])""",
        r"(?i)(?:access_?key_?id|client_?id|user_?(?:name|id)?|login|account)[\"']?\x20*[:=]|AKIA",
        None,
    ),
    "weak_secret": (
        rf"""{TOKEN}|(?i)\b(?:pwd|pass|passphrase|private_?key|credential|auth)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{4,}}""",
        r"(?i)[A-Z0-9+/_=-]{20}|(?:pwd|pass|passphrase|private_?key|credential|auth)[\"']?\x20*[:=]",
        lambda m: m.rlike("[:=]") | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")),
    ),
    "weak_endpoint": (r"""(?i)\bhttps?://[^\s"'<>]+|\b[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}\b""", r"://|\.[A-Za-z0-9-]++:[0-9]{2}", None),
}
#: What a kind's part is in a credential: 0 a secret, 1 an identifier or endpoint.
ROLE = {"assign": 0, "access": 1, "hex": 0, "weak_identifier": 1, "weak_secret": 0, "weak_endpoint": 1}
SPAN = "struct<start:int,kind:int,end:int>"


def parts_of(text: Column, kinds: dict) -> Column:
    def of(kind: str, pattern: str, hint: str, check) -> Column:
        spans = spans_of(text, pattern)
        if check is not None:
            spans = F.filter(spans, lambda s: check(s["match"]))
        rows = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))
        return F.when(text.rlike(hint), rows).otherwise(none_of(SPAN))

    return F.concat(*(of(kind, *x) for kind, x in kinds.items()))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, weak) of every row; weak parts that lie in a base span are none."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", F.xxhash64(text).alias("key"), parts_of(text, BASE).alias("base"), parts_of(text, WEAK).alias("weak"))
    apart = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return rows.withColumn("weak", apart)


def linked(found: DataFrame) -> DataFrame:
    """(doc_id, key, linked): the weak parts of each row that have a complement in their scope."""
    rows = found.filter(F.size("weak") > 0).dropDuplicates(["doc_id", "key"])
    role = F.element_at(F.array(*(F.lit(ROLE[k]) for k in KINDS)), F.col("p.kind") + 1)
    parts = rows.select("doc_id", "key", F.explode(F.concat("base", "weak")).alias("p")).select("doc_id", "key", "p.*", role.alias("role"), F.floor(F.col("p.start") / SCOPE).cast("int").alias("cell"))
    weak = parts.filter(F.col("kind") >= 3).select("doc_id", "key", "start", "kind", "end", "role", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    # of the complements in a cell only the first and last can matter to a place outside it; inside it, all are in scope
    other = parts.groupBy("doc_id", "key", "cell", (1 - F.col("role")).alias("role")).agg(F.min("start").alias("low"), F.max("start").alias("high"))
    near = weak.alias("w").join(other.alias("o"), F.col("w.doc_id").eqNullSafe(F.col("o.doc_id")) & (F.col("w.key") == F.col("o.key")) & (F.col("w.cell") == F.col("o.cell")) & (F.col("w.role") == F.col("o.role")))
    inside = (F.col("o.low") <= F.col("w.start") + SCOPE) & (F.col("o.high") >= F.col("w.start") - SCOPE)
    return near.filter(inside).select("w.doc_id", "w.key", "w.start", "w.kind", "w.end").distinct().groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "kind", "end")).alias("linked"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, linked) of every row of documents (doc_id, text)."""
    found = keep(scanned(docs), "secrets")
    r = linked(found).select(F.col("doc_id").alias("r_id"), F.col("key").alias("r_key"), "linked")
    rows = found.join(r, found["doc_id"].eqNullSafe(F.col("r_id")) & (found["key"] == F.col("r_key")), "left")
    return rows.select("doc_id", "key", "base", F.coalesce("linked", none_of(SPAN)).alias("linked"))


def redacted(text: Column, spans: Column) -> Column:
    """Text with spans of secrets replaced by their kind."""
    return replaced(text, spans, [f"[{k.upper()}]" for k in KINDS])


def op6_credential_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(documents(spark, sf_dir))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return rows.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)),
        F.sha2(joined(F.col("base"), KINDS), 256).alias("base_sha256"),
        joined(F.concat("base", "linked"), KINDS).alias("spans"),
    )
