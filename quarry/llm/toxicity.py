"""Operator 7: toxicity by a weighted lexicon.

Texts are folded (case, look-alike letters, digits and signs that stand for
letters) to words of letters. The lexicon holds word beginnings and whole words
with the log-odds of toxic against other training documents that have them; an
Aho-Corasick automaton finds all entries at once, each word counts by its
heaviest entry, and words inside an exception phrase count nothing. The sum of
weights and its share of the text's length give a score by a logistic function.

The lexicon and the function are fitted on at most SAMPLE labelled rows whose
crc32 of doc_id mod 5 isn't 0, taken by a hash of the doc_id; half of the
sample gives the lexicon, the other half the function. Scores see text only.

Defined cases: null and empty texts score as texts without an entry; labels
without a document, or null, are passed over; without toxic labels all scores
are the share of toxic rows in the sample; repeated rows get equal scores; an
empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import dataclasses
import functools
import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from quarry.llm.storage import documents, only
from quarry.llm.workers import tidy, values

#: Labelled rows that fit the model at most; this bounds the lexicon, which goes to executors, by the terms of so many texts.
SAMPLE = 12_000
#: An entry is in at least so many toxic documents of the sample, or this share of them.
LEAST_DOCS, LEAST_SHARE = 3, 0.008
#: Least log-odds of an entry.
LEAST_WEIGHT = 2.0
STEMS = range(3, 10)
#: Terms that a task holds before it passes their counts on; sums are the same.
HELD_TERMS = 40_000
#: In these phrases a lexicon word names a thing.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "idiot proof")
#: Characters written for a letter.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ӏ": "l", "α": "a", "ο": "o", "ε": "e", "ι": "i", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "κ": "k", "ı": "i", "ł": "l"}


class _Fold(dict):
    """Translation of lower-case text, filled as characters come: letters stay or fold, marks go, all else is a blank."""

    def __missing__(self, cp: int) -> str:
        c = LOOKALIKES.get(chr(cp))
        if c is None:
            c = unicodedata.normalize("NFKC", chr(cp)).lower()
            c = "".join(LOOKALIKES.get(x, x) for x in c)
            if unicodedata.category(chr(cp)) in ("Mn", "Cf"):
                c = ""
            elif not c.isalpha():
                c = " "
        self[cp] = c
        return c


_FOLD = _Fold()


def folded(text: str) -> str:
    """A text's folded words, each after one or more blanks, with a blank at both ends."""
    return " " + unicodedata.normalize("NFC", text.lower()).translate(_FOLD) + " "


@dataclasses.dataclass(frozen=True)
class Model:
    lexicon: tuple[tuple[str, float], ...]
    coefficients: tuple[float, float, float]
    exceptions: tuple[str, ...] = EXCEPTIONS


@functools.lru_cache(maxsize=2)
def _automaton(lexicon: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for term, weight in lexicon:
        a.add_word(term, (len(term), weight))
    for phrase in exceptions:
        a.add_word(folded(phrase).rstrip() + " ", (len(phrase) + 2, 0.0))
    a.make_automaton()
    return a


def weigh(text: str, model: Model) -> tuple[float, int]:
    """Sum of the weights of a text's words that the lexicon has, and its number of words."""
    f = folded(text)
    n = len(f.split())
    if not model.lexicon:
        return 0.0, n
    best: dict[int, float] = {}
    excused: list[tuple[int, int]] = []
    for end, (size, weight) in _automaton(model.lexicon, model.exceptions).iter(f):
        start = end - size + 1
        if weight:
            if weight > best.get(start, 0.0):
                best[start] = weight
        else:
            excused.append((start, end))
    if excused:
        starts, ends = (sorted(x) for x in zip(*excused))
        # a place lies in a phrase if more phrases have begun than ended by then
        best = {x: w for x, w in best.items() if bisect.bisect_right(starts, x) == bisect.bisect_left(ends, x + 2)}
    return math.fsum(best.values()), n


def features(total: float, words: int) -> tuple[float, float]:
    """Of the summed weights: their size, and their share of the length."""
    return math.log1p(total), math.log1p(100 * total / (words + 20))


def _terms(text: str) -> set[str]:
    out = set()
    for w in set(folded(text).split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in STEMS if len(w) >= k)
    return out


def _lexicon(counts: list[tuple[str, int, int]], toxic: int, other: int) -> tuple[tuple[str, float], ...]:
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    weights = {}
    for term, p, n in counts:
        if p >= least:
            w = math.log((p + 0.1) / (toxic + 1)) - math.log((n + 0.5) / (other + 1))
            if w >= LEAST_WEIGHT:
                weights[term] = w
    # a longer entry only counts if it is heavier than all its beginnings
    kept = {t: w for t, w in weights.items() if all(weights.get(t[:k], 0.0) < w for k in range(4, len(t)))}
    return tuple(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps: intercept and two coefficients that aren't negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + np.array([0, 1e-2, 1e-2]) * w
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, 1e-2, 1e-2])
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    if (w[1:] < 0).any():  # one of the two alone
        keep = int(np.argmax(w[1:]))
        z = x.copy()
        z[:, 1 - keep] = 0
        return _logistic(z, y) if not (z == x).all() else (float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2])))
    return float(w[0]), float(w[1]), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from documents (doc_id, text) and labels (doc_id, toxic): see the module."""
    usable = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null")
    usable = usable.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 0)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # of labels that disagree the toxic one
    taken = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = only(docs, "doc_id", "text").join(F.broadcast(taken), "doc_id")  # at most `sample` rows of two numbers

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def told() -> pa.RecordBatch:
            terms = list(found[0].keys() | found[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), *(pa.array([found[y][t] for t in terms], pa.int64()) for y in (1, 0))], ["term", "p", "n"])
            for f in found:
                f.clear()
            return out

        for b in batches:
            for i, t, y in zip(*map(values, b.columns)):
                if zlib.crc32(b"half%d" % i) & 1:
                    continue
                found[y != 0].update(_terms(t or ""))
                found[y != 0][""] += 1  # stands for the document itself
                if len(found[0]) + len(found[1]) > HELD_TERMS:
                    yield told()
        yield told()

    counts = texts.select("doc_id", "text", "toxic").mapInArrow(tidy(count), "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    rows = counts.filter(F.col("p") >= LEAST_DOCS).collect()  # terms of at most `sample` texts' toxic part
    sizes = counts.filter("term = ''").first()
    toxic, other = (sizes["p"], sizes["n"]) if sizes else (0, 0)
    lexicon = _lexicon([(r["term"], r["p"], r["n"]) for r in rows if r["term"]], toxic, other)
    model = Model(lexicon, (0.0, 0.0, 0.0))

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(y != 0, *features(*weigh(t or "", model))) for i, t, y in zip(*map(values, b.columns)) if zlib.crc32(b"half%d" % i) & 1]
            yield pa.RecordBatch.from_arrays([pa.array([float(r[k]) for r in rows], pa.float64()) for k in range(3)], ["y", "a", "b"])

    got = np.array([tuple(r) for r in texts.select("doc_id", "text", "toxic").mapInArrow(tidy(weights), "y double, a double, b double").collect()], float).reshape(-1, 3)  # at most `sample` rows
    got = got[np.lexsort(got.T)]
    y = got[:, 0]
    if not len(y) or not y.any() or y.all() or not lexicon:
        share = (toxic + y.sum() + 0.5) / (toxic + other + len(y) + 1)
        return dataclasses.replace(model, lexicon=(), coefficients=(float(np.log(share / (1 - share))), 0.0, 0.0))
    return dataclasses.replace(model, coefficients=_logistic(got[:, 1:], y))


def scored(docs: DataFrame, model: Model, *names: str) -> DataFrame:
    """The named columns of every row with `__score` (0 to 1); only texts go to Python, only scores come back."""

    def score(texts: pa.Array) -> pa.Array:
        c, out = model.coefficients, []
        for t in values(texts):
            f = features(*weigh(t or "", model))
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + c[1] * f[0] + c[2] * f[1])))))
        return pa.array(out, pa.float64())

    udf = F.arrow_udf(score, DoubleType())
    return docs.select(*(F.col(f"`{n}`") for n in names), udf(F.col("text")).alias("__score"))


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that score under 0.5, with all their columns."""
    return scored(docs, model, *docs.columns).filter("__score < 0.5").drop("__score")


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    return scored(docs, model, "doc_id").select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.5).cast("int").alias("predicted"))
