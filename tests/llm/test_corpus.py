"""Corpus operators against brute force (1, 5)."""

import collections
import math
import random
import re

import numpy as np
import pytest

from quarry.llm import neardup
from quarry.llm.lm import scores
from quarry.llm.neardup import near_duplicates

SCHEMA = "doc_id long, text string, key string, band long, node string, n_words int"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "k", 1, "n", 2) for d, t in rows], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_scores(spark):
    rnd = random.Random(5)
    vocab = "a b c dd É the the the".split()
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 12)))) for i in range(40)]
    rows += [(100, None), (101, " \t"), (None, "a b c"), (7, "the zz"), (7, "the zz"), (102, "word " * 20000)]
    for loo, least in ((True, 1), (False, 2)):
        got = scores(table(spark, rows).repartition(3), least, loo).collect()
        uni, bi = collections.Counter(), collections.Counter()
        for _, t in rows:
            w = words(lower(t))
            uni.update(w)
            bi.update(zip(w, w[1:]))
        total = sum(uni.values())
        want = []
        for d, t in rows:
            w = words(lower(t))
            u, b = (collections.Counter(w), collections.Counter(zip(w, w[1:]))) if loo else ({}, {})
            c1 = lambda x: uni[x] - u.get(x, 0)
            s, back = 0.0, 0
            for i, x in enumerate(w):
                c2 = bi[w[i - 1], x] - b.get((w[i - 1], x), 0) if i else 0
                if c2 >= max(1, least):
                    s += math.log(c2 / max(c1(w[i - 1]), c2))
                else:
                    s += math.log((0.4 if i else 1) * max(c1(x), 1) / total)
                    back += i > 0
            want.append((str(d), len(w), back, round(s, 5)))
        assert sorted((str(r.doc_id), r.n_words, r.n_backoff, round(r.score, 5)) for r in got) == sorted(want)
    assert scores(table(spark, [])).count() == 0


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = words(lower(t))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        comp = min((x for x in ids[root(i)] if x is not None), default=None)
        out.append((str(d), len(sets[i]), str(comp), d == comp))
    return sorted(out)


#: As they are, and so small that every other path is taken: blocks, cells, hot keys, salted joins.
USUAL, SMALL = {}, {"BLOCK": 5, "CELL": 2, "HOT_ROWS": 2, "HOT_KEYS": 1 << 40, "BROADCAST_IDS": 1}


@pytest.mark.parametrize("width,limits", [(2, USUAL), (5, USUAL), (2, SMALL)])
def test_near_duplicates(spark, monkeypatch, width, limits):
    for name, value in limits.items():
        monkeypatch.setattr(neardup, name, value)
    rnd = random.Random(width)
    vocab = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(14):
        base = [rnd.choice(vocab) for _ in range(rnd.choice([3, 8, 30, 120]))]
        for _ in range(rnd.randint(1, 14)):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 12))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append((len(rows) * 2, " ".join(copy)))
            if rnd.random() < 0.2:
                base = copy  # chains
    rows += [(1001, None), (1003, ""), (1005, " \n"), (1007, "One"), (1009, "one"), (1011, "one two"), (None, "one two"), (0, rows[0][1]), (3, "ÉÉ x y z é")]
    rnd.shuffle(rows)
    got = near_duplicates(table(spark, rows).repartition(3), width).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == brute(rows, width, 80)


def test_overlaps():
    rnd = np.random.default_rng(3)
    sets = [np.unique(rnd.integers(0, 60 if k % 2 else 3000, 80).astype(np.uint64)) for k in range(50)] + [np.zeros(0, np.uint64)]
    left, right = sets[:20], sets[20:]
    assert neardup.overlaps(left, right).tolist() == [[len(set(a.tolist()) & set(b.tolist())) for b in right] for a in left]


def test_near_duplicates_of_nothing(spark):
    assert near_duplicates(table(spark, []), 2).count() == 0
    assert [tuple(r) for r in near_duplicates(table(spark, [(5, None)]), 2).collect()] == [(5, 0, 5, True)]
