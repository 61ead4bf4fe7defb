"""SQL twins of the operators that SQL can tell, for whole tables of a small size."""

from __future__ import annotations

from quarry.llm import quality

BLANK = r"[\x20\x09-\x0D]"
WORDS = f"list_filter(string_split_regex(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '')"
LOW = f"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{BLANK}+'), lambda x: x <> '')"

#: Counts of words and pairs over all documents, a document's own taken off; the sums as in `lm`.
LM = f"""
WITH d AS (SELECT doc_id, {LOW} AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM d),
q AS (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM p),
own1 AS (SELECT doc_id, w, count(*) AS n FROM q GROUP BY 1, 2), all1 AS (SELECT w, sum(n) AS n FROM own1 GROUP BY 1),
own2 AS (SELECT doc_id, v, w, count(*) AS n FROM q WHERE v IS NOT NULL GROUP BY 1, 2, 3), all2 AS (SELECT v, w, sum(n) AS n FROM own2 GROUP BY 1, 2),
t AS (SELECT greatest(1, count(*))::DOUBLE AS total FROM q),
c AS (SELECT q.doc_id, q.v IS NOT NULL AS inner_word, a.n - o.n AS c1, coalesce(av.n - ov.n, 0) AS cv, coalesce(a2.n - o2.n, 0) AS c2
  FROM q JOIN own1 o ON o.doc_id = q.doc_id AND o.w = q.w JOIN all1 a ON a.w = q.w
  LEFT JOIN own1 ov ON ov.doc_id = q.doc_id AND ov.w = q.v LEFT JOIN all1 av ON av.w = q.v
  LEFT JOIN own2 o2 ON o2.doc_id = q.doc_id AND o2.v = q.v AND o2.w = q.w LEFT JOIN all2 a2 ON a2.v = q.v AND a2.w = q.w),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (inner_word AND c2 < 1) AS n_backoff,
  sum(CASE WHEN c2 >= 1 THEN ln(c2) - ln(greatest(cv, c2)) ELSE ln(greatest(c1, 1)) + CASE WHEN inner_word THEN ln(0.4) ELSE 0 END - ln(total) END) AS score FROM c, t GROUP BY 1)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_backoff, 0) AS n_backoff, round(coalesce(score, 0), 4)::DOUBLE AS score, round(coalesce(score / n_words, 0), 4)::DOUBLE AS mean_score FROM d LEFT JOIN s USING (doc_id)
"""

#: Every pair of documents by their shared word pairs, then all that links reach.
NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOW} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS ks FROM d),
k AS (SELECT doc_id, unnest(ks) AS k FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * c >= 80 * (len(x.ks) + len(y.ks) - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM s UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.c),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY 1)
SELECT doc_id, len(ks)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN m USING (doc_id)
"""

_OVER = {"nonletters": ("nonletters_n", "word_chars"), "shouting": ("capitals", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines"), "word_length": ("word_chars", "n_words"), "word_shortness": ("n_words", "word_chars")}
_METRICS = ", ".join(f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS {m}" for m, (a, b) in _OVER.items())
_VALUES = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, ceil(ln({m} / {quality.SMALLEST}) / {quality.STEP}) AS b FROM f WHERE NOT base_failed AND {m} > {quality.SMALLEST}" for m in quality.METRICS)


def _level(name: str, groups: str) -> str:
    """Own thresholds of groups: quartiles of the bucket values."""
    by = f"{groups}, " if groups else ""
    value = lambda q: f"{quality.SMALLEST} * exp(min(b) FILTER (up >= {q} * n) * {quality.STEP})"
    return (
        f"{name}u AS (SELECT {by}metric, b, sum(count(*)) OVER (PARTITION BY {by}metric ORDER BY b) AS up, sum(count(*)) OVER (PARTITION BY {by}metric) AS n FROM v GROUP BY {by}metric, b), "
        f"{name}q AS (SELECT {by}metric, n, {value(0.25)} AS q1, {value(0.75)} AS q3 FROM {name}u GROUP BY {by}metric, n), "
        f"{name} AS (SELECT {by}metric, n, q3 + {quality.FENCE} * greatest(q3 - q1, {quality.NARROW} * q3) AS t FROM {name}q)"
    )


def _lean(n: str, t: str, larger: str) -> str:
    return f"((coalesce({n} * {t}, 0) + {quality.PRIOR} * {larger}) / (coalesce({n}, 0) + {quality.PRIOR}))"


_PIVOT = ", ".join(f"max(t) FILTER (metric = '{m}') AS t_{m}" for m in quality.METRICS)
_FAILS = " OR ".join(f"coalesce({m} > t_{m}, false)" for m in quality.METRICS)

#: Counts, sketches, thresholds and verdicts of the quality rules.
QUALITY = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS ws, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 6), lambda i: {{'i': i, 'k': array_to_string(ws[i:i + 7], ' ')}})) AS s FROM w WHERE len(ws) > 8),
y AS (SELECT doc_id, s.i AS i FROM x QUALIFY count(*) OVER (PARTITION BY doc_id, s.k) > 1),
z AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS more FROM y),
rep AS (SELECT doc_id, sum(more)::BIGINT AS n FROM z GROUP BY 1),
c AS (SELECT w.doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines, length(regexp_replace(text, '[\\pL\\x20\\x09-\\x0D]+', '', 'g')) AS nonletters_n,
  CASE WHEN regexp_matches(text, '[A-Z]{{2}}') THEN length(text) - length(regexp_replace(text, '[A-Z]+', '', 'g')) ELSE 0 END AS capitals FROM w LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {_METRICS} FROM c),
v AS ({_VALUES}), {_level("a", "lang, source")}, {_level("b", "lang")}, {_level("g", "")},
m AS (SELECT unnest({list(quality.METRICS)}) AS metric),
lim AS (SELECT f.doc_id, m.metric, {_lean("a.n", "a.t", _lean("b.n", "b.t", "g.t"))} AS t FROM f CROSS JOIN m
  LEFT JOIN a ON a.lang IS NOT DISTINCT FROM f.lang AND a.source IS NOT DISTINCT FROM f.source AND a.metric = m.metric LEFT JOIN b ON b.lang IS NOT DISTINCT FROM f.lang AND b.metric = m.metric LEFT JOIN g ON g.metric = m.metric)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({_FAILS}) AS kept
FROM f JOIN (SELECT doc_id, {_PIVOT} FROM lim GROUP BY 1) t ON t.doc_id = f.doc_id
"""
