"""Operator 2: document fingerprints from closed syncmers.

A text is a row of units. A k-mer of units is an anchor if the least of the
hashes of its inner s-mers is the first or the last: that depends on the k-mer
alone, so an edit moves no anchor that it doesn't touch. `anchors` gives them
with their positions, for positional matching. The fingerprint keeps the SKETCH
least hashes of a text's distinct anchors, from which likeness is the share of
both in the least of their union (the Jaccard of the anchor sets; exact for small
sets). Likeness takes no positions: an insertion moves all that follow it.

Where units end depends on characters alone, never on offsets: a character of a
script written without blanks is a unit; other characters form runs that end
before white space or such a character, or after one of CUTS. CUTS are seldom in
words and often in encoded or minified runs, which so fall into short units. Each
text has MARGIN empty units before and after it, so that texts of few units have
anchors too and compare with long ones.

Defined cases: a null text is empty, has no anchor and is like an empty text only
(1.0); a text of white space alone is one anchor; equal texts have equal
fingerprints and likeness 1; rows that share a doc_id are ordered by their text;
null doc_ids come last; a single document is its own next; an empty table gives
no row; extra columns are ignored. A long run of one character is one unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quarry.llm.native import let
from quarry.llm.storage import documents, only, parts_for
from quarry.llm.wavelet import id_ranges

SKETCH = 128
K, S = 5, 2
MARGIN = K - 1
#: Letters, digits and signs after which a run of characters is cut.
CUTS = r"zQX7;,.(){}=&/"
#: Thai to Myanmar, Khmer, and all from the CJK radicals on.
ALONE = r"\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\uFFFF\x{10000}-\x{10FFFF}"
UNIT = rf"[{ALONE}]|[^\x20\x09-\x0D{ALONE}{CUTS}]++[{CUTS}]?|[{CUTS}]"
#: Input bytes for each range of doc_ids.
RANGE_BYTES = 4 << 20


def _closed(s: Column, hash_at, window: int) -> Column:
    """struct<position, hash> of each k-mer whose least s-mer hash (of `window`) is the first or last."""

    def edge(i: Column) -> Column:
        inner = [F.element_at(s, i + k) for k in range(1, window - 1)]
        ends = F.least(F.element_at(s, i), F.element_at(s, i + (window - 1)))
        return ends <= (F.least(*inner) if len(inner) > 1 else inner[0])

    found = F.filter(F.sequence(F.lit(1), F.size(s) - (window - 1)), edge)
    return F.transform(found, lambda i: F.struct(i.alias("position"), hash_at(i).alias("hash")))


def text_anchors(text: Column) -> Column:
    """Anchors of a text as array<struct<position, hash>>; positions count units from 1, those before 1 begin in the margin."""

    def of(h: Column) -> Column:
        smers = F.transform(F.sequence(F.lit(1), F.size(h) - S + 1), lambda i: F.xxhash64(F.element_at(h, i), F.element_at(h, i + 1)))
        anchors = let(smers, lambda s: _closed(s, lambda i: F.xxhash64(F.slice(h, i, F.lit(K))), K - S + 1))
        return F.when(F.size(h) > 2 * MARGIN, anchors).otherwise(F.array(F.struct(F.lit(1).alias("position"), F.xxhash64(text).alias("hash"))))

    empty = F.array_repeat(F.lit(0).cast("long"), MARGIN)
    units = F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))
    return let(F.concat(empty, F.transform(units, lambda w: F.xxhash64(w)), empty), of)


def fingerprint(text: Column) -> Column:
    """Sketch of a text's anchors, its SKETCH least hashes of 32 bits; null for an empty text."""
    sketch = lambda t: F.slice(F.sort_array(F.array_distinct(F.transform(text_anchors(t), lambda a: F.shiftrightunsigned(a["hash"], 32)))), 1, SKETCH)
    return let(text, lambda t: F.when(F.length(t) > 0, sketch(t)))


def printed(fp: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(fp, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard estimate of two fingerprints; 1 if both texts are empty, 0 if one is."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = let(least, lambda u: F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(both)


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, position, hash): all closed syncmers of every text."""
    text = F.coalesce("text", F.lit(""))
    rows = only(docs, "doc_id", "text").select("doc_id", F.explode(F.when(F.length(text) > 0, text_anchors(text))).alias("a"))
    return rows.select("doc_id", (F.col("a.position") - MARGIN).alias("position"), "a.hash")


def range_of(doc_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below a doc_id (0 for null), by binary search in the literal list."""
    if not bounds:
        return F.lit(0)
    table = F.array(*(F.lit(b).cast("long") for b in bounds))
    steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
    at = let(table, lambda t: F.aggregate(steps, F.lit(0), lambda acc, s: F.when(acc + s > len(bounds), acc).when(F.element_at(t, F.least(acc + s, F.lit(len(bounds)))) <= doc_id, acc + s).otherwise(acc)))
    return F.when(doc_id.isNull(), 0).otherwise(at)


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, fp, next_text, next_fp): each document with the one after it in descending doc_id; the first follows the last.

    Documents meet in ranges of doc_ids; the first document of a range is also
    sent, as a guest, to the range before it. Nothing is ordered in one task but
    one number a range.
    """
    rows = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    bounds = id_ranges(docs, parts_for(docs, RANGE_BYTES))
    rows = rows.withColumn("range", range_of(F.col("doc_id"), bounds))
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head")).collect()  # one row a range, as many as bounds at most
    order = sorted(r["range"] for r in heads)
    target = dict(zip(order, order[1:] + order[:1]))
    guests = rows.sparkSession.createDataFrame([(r["range"], r["head"], target[r["range"]]) for r in heads], "g_range int, head long, target int")
    at_head = (F.col("range") == F.col("g_range")) & F.col("doc_id").eqNullSafe(F.col("head"))
    placed = rows.withColumn("fp", fingerprint(F.col("text"))).join(F.broadcast(guests), at_head, "left")
    places = F.array_compact(F.array(F.struct(F.col("range").alias("place"), F.lit(False).alias("guest")), F.when(F.col("target").isNotNull(), F.struct(F.col("target").alias("place"), F.lit(True).alias("guest")))))
    placed = placed.select("doc_id", "text", "fp", F.explode(places).alias("p")).select("doc_id", "text", "fp", "p.*")
    w = W.partitionBy("place").orderBy("guest", F.desc_nulls_last("doc_id"), "text")
    seen = placed.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w))
    return seen.filter("not guest").drop("place", "guest")


def edited_text() -> Column:
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    return F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))


def op2_closed_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(documents(spark, sf_dir))

    def out(e: Column) -> Column:
        return let(
            fingerprint(e),
            lambda f: F.struct(F.sha2(e, 256).alias("edited_sha256"), printed(F.col("fp")).alias("fingerprint"), printed(f).alias("edited_fingerprint"), likeness(F.col("fp"), f).alias("near_edited")),
        )

    done = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), let(edited_text(), out).alias("o"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
    return done.select("doc_id", "n_chars", "o.*", "near_next")
