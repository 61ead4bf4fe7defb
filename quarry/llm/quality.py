"""Operator 8: quality rules with thresholds that follow the data.

Every text gets its counts and from them METRICS, ratios that are high in bad
text. Of the documents that pass the base rules, the values above zero are
sketched per language and source: a sketch counts values in buckets of a fixed
ratio, so sketches add up exactly in any order and a quantile is right within
that ratio. A sketch's own threshold is the upper quartile plus FENCE
interquartile distances (a distance narrower than NARROW of the quartile counts
as that); nothing is a fixed cutoff. A language's threshold is the mean of its
own, weighted by its documents, and that of all, weighted by PRIOR documents,
and a source's within its language likewise, so small groups lean on larger ones
without a switch. Thresholds are joined to the documents, which fail above any.

Defined cases: a null text has no words and fails; null language or source is a
group of its own; repeated rows count each; a metric that is zero everywhere
has no threshold; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from quarry.llm.native import WORD, let
from quarry.llm.storage import documents, keep, only

WINDOW = 8
#: Ratio of neighbouring sketch buckets, in logarithms: values are right within 2 %.
STEP = 0.02
SMALLEST = 1e-4
#: Documents that the larger group's threshold counts as.
PRIOR = 200
FENCE, NARROW = 6.0, 0.05
METRICS = ("nonletters", "shouting", "repeats", "dup_lines", "word_length", "word_shortness")


def repeated_words(hashes: Column) -> Column:
    """Words that lie in windows of WINDOW word hashes found twice or more, the first included."""

    def covered(windows: Column) -> Column:
        def of(s: Column) -> Column:
            same = lambda i, j: F.element_at(s, i)["h"] == F.element_at(s, j)["h"]
            twice = F.filter(F.sequence(F.lit(1), F.size(s)), lambda k: F.when(k > 1, same(k, k - 1)).otherwise(False) | F.when(k < F.size(s), same(k, k + 1)).otherwise(False))
            zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
            return F.aggregate(
                F.sort_array(F.transform(twice, lambda k: F.element_at(s, k)["i"])),
                zero,
                lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
                lambda acc: acc["n"],
            )

        placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, of))

    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - WINDOW + 1), lambda i: F.xxhash64(F.slice(h, i, F.lit(WINDOW))))
    return let(hashes, lambda h: F.when(F.size(h) < 2, 0).when(F.size(h) <= WINDOW, 0).otherwise(let(windows(h), covered)))


def counted(docs: DataFrame, *names: str, whole: bool = False) -> DataFrame:
    """The named columns and the counts of each whole text; whole: those columns also as __name, out of the way of the counts' names."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    wide = let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x)).alias("word_chars"),
            repeated_words(F.transform(w, lambda x: F.xxhash64(x))).cast("long").alias("n_repeat_words"),
        ),
    )
    own = [F.col(f"`{n}`").alias(f"__{n}") for n in names] if whole else []
    names = ("lang", "source") if whole else names
    source = docs if whole else only(docs, *names, "text")
    counts = F.struct(
        wide.alias("w"),
        F.when(text.rlike(r"[#*$%&|<>]"), F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]+", ""))).otherwise(0).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))).alias("l"),
        F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", "")).cast("long").alias("nonletters_n"),
        F.when(text.rlike("[A-Z]{2}"), F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))).otherwise(0).cast("long").alias("capitals"),
    )
    # no filter on the counts moves below the explode, which would work them out once for each use
    rows = source.select(*names, *own, F.explode(F.array(counts)).alias("__c"))
    return rows.select(*names, *(f"`__{n}`" for n in (docs.columns if whole else [])), "__c.w.*", "__c.n_symbols", "__c.nonletters_n", F.col("__c.l.dup").cast("long").alias("n_dup_lines"), F.col("__c.l.n").alias("n_lines"), "__c.capitals")


def metrics() -> dict[str, Column]:
    """A column for each of METRICS."""
    over = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    pairs = (("nonletters_n", "word_chars"), ("capitals", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("word_chars", "n_words"), ("n_words", "word_chars"))
    return {name: over(*p) for name, p in zip(METRICS, pairs)}


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def bucket(x: Column) -> Column:
    return F.when(x <= SMALLEST, 0).otherwise(F.ceil(F.log(x / SMALLEST) / STEP)).cast("int")


def value_of(b: Column) -> Column:
    return F.when(b <= 0, 0.0).otherwise(SMALLEST * F.exp(b * STEP))


def sketch(rows: DataFrame, groups: list[str]) -> DataFrame:
    """Mergeable quantile sketches: (groups, metric, bucket, n); every group has a row of metric "" for its documents."""
    values = F.filter(F.array(*(F.struct(F.lit(name).alias("metric"), bucket(F.col(name)).alias("bucket")) for name in METRICS)), lambda p: p["bucket"] > 0)
    every = F.array(F.struct(F.lit("").alias("metric"), F.lit(0).alias("bucket")))
    pairs = F.concat(every, F.when(base_failed(), F.slice(values, 1, 0)).otherwise(values))
    return rows.select(*groups, F.explode(pairs).alias("p")).groupBy(*groups, "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], qs: dict[str, float]) -> DataFrame:
    """(groups, metric, total, one column a quantile) from sketches, merged first."""
    merged = sketches.groupBy(*groups, "metric", "bucket").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*groups, "metric")
    ranked = merged.withColumn("up", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    return ranked.groupBy(*groups, "metric", "total").agg(*(value_of(F.min(F.when(F.col("up") >= q * F.col("total"), F.col("bucket")))).alias(k) for k, q in qs.items()))


def thresholds(sketches: DataFrame) -> DataFrame:
    """(g_lang, g_source, a threshold a metric) for every language and source."""
    own = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), NARROW * F.col("q3"))
    values = sketches.filter("metric <> ''")
    levels = [quantiles(values, g, {"q1": 0.25, "q3": 0.75}).select(*g, "metric", "total", own.alias("t")) for g in (["g_lang", "g_source"], ["g_lang"], [])]
    a, b, c = (x.withColumnsRenamed({"total": f"n{k}", "t": f"t{k}"}) for k, x in enumerate(levels))
    groups = sketches.filter("metric = ''").select("g_lang", "g_source", F.explode(F.array(*map(F.lit, METRICS))).alias("metric"))
    lean = lambda n, t, larger: (F.coalesce(n * t, F.lit(0.0)) + PRIOR * larger) / (F.coalesce(n, F.lit(0)) + PRIOR)
    rows = groups.join(a, ["g_lang", "g_source", "metric"], "left").join(b, ["g_lang", "metric"], "left").join(c, "metric", "left")
    rows = rows.withColumn("t", lean(F.col("n0"), F.col("t0"), lean(F.col("n1"), F.col("t1"), F.col("t2"))))
    return rows.groupBy("g_lang", "g_source").agg(*(F.max(F.when(F.col("metric") == name, F.col("t"))).alias(f"t_{name}") for name in METRICS))


def mark(column: str) -> Column:
    """A group's name, in which null is a value of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def judge(rows: DataFrame) -> DataFrame:
    """base_failed and kept of rows with counts, metrics and thresholds."""
    high = F.lit(False)
    for name in METRICS:
        high = high | F.coalesce(F.col(name) > F.col(f"t_{name}"), F.lit(False))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~base_failed() & ~high)


def with_limits(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """Rows with their group's thresholds, which go to all executors if they are counted to be few."""
    few = limits.limit(100_001).count() <= 100_000
    return rows.join(F.broadcast(limits) if few else limits, ["g_lang", "g_source"], "left")


def judged(rows: DataFrame) -> DataFrame:
    """Counted rows with base_failed and kept."""
    marks = {"g_lang": mark("lang"), "g_source": mark("source")}
    rows = keep(rows, "quality").withColumns(metrics()).withColumns(marks)
    sketches = keep(sketch(rows, ["g_lang", "g_source"]), "sketches")
    return judge(with_limits(rows, keep(thresholds(sketches), "thresholds")))


def verdicts(docs: DataFrame, *names: str) -> DataFrame:
    """Counts, base_failed and kept for every row, with the named columns of the documents."""
    return judged(counted(docs, *dict.fromkeys((*names, "lang", "source"))))


def kept_documents(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with all their columns.

    Documents are written with their counts once; thresholds (a row a language
    and source) come from the counts alone, and the documents are read again to
    be judged where they lie: no text moves unless there are more thresholds
    than go to all executors.
    """
    rows = judged(counted(docs, *docs.columns, whole=True))
    return rows.filter("kept").select(*(F.col(f"`__{n}`").alias(n) for n in docs.columns))


def op8_quality_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(documents(spark, sf_dir), "doc_id").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
