"""Tokenizer operators against the libraries themselves (3, 9, 10)."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest

from quarry.llm.bpe import codec, decode_table, encode_table, encode_words, fold_merges, load_ranks, round_trips
from quarry.llm.packing import pack, packed, powers_of_two
from quarry.llm.storage import new_path
from quarry.llm.wavelet import WaveletMatrix, read_shards, write_shards

RANKS, JSON = P.path("byte_bpe_multi_50k.tiktoken"), P.path("byte_bpe_50k.json")
ODD = list("aé '  \n\t1²s 　tremdl.,!<|中😀\x1c\x85​\r") + ["'s", "'ll", "'re", " '", "  ", "<|endoftext|>", "\U00031350", "͸"]
SCHEMA = "doc_id long, text string, start string, ids string"


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(ODD) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [None, "", "a" * 5000, "word " * 3000, "x", "a <|endoftext|> b<|endoftext|", "<|endoftext|>", "The same text.", "The same text."]
    out = [(i * 3 + 1, t, "extra", "clash") for i, t in enumerate(texts)]
    return out + [(None, "no id", "e", "c"), (4, "twice the id", "e", "c")]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(RANKS), special_tokens={})


def test_bpe_is_the_librarys(spark, rows, tik):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((str(d), len(i := tik.encode_ordinary(t or "")), hashlib.sha256(np.asarray(i, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t, *_ in rows)
    assert sorted((str(r[0]), *r[1:]) for r in round_trips(df, RANKS).collect()) == want
    back = decode_table(encode_table(df, RANKS), RANKS).collect()
    assert sorted((str(r[0]), bytes(r[1])) for r in back) == sorted((str(d), (t or "").encode()) for d, t, *_ in rows)
    assert round_trips(spark.createDataFrame([], SCHEMA), RANKS).count() == 0


def test_long_folds_agree(tik):
    ranks, rnd = codec(RANKS).ranks, random.Random(3)
    for n in (65, 200, 1500):
        for letters in ("ab", "etaoin", "é中x"):
            p = "".join(rnd.choice(letters) for _ in range(n))
            assert fold_merges(p.encode(), ranks) == tik.encode_ordinary(p)


def test_words_fold_in_column_expressions(spark, tik):
    words = [" the", "tokenization", "ünïcödé", "中文", "a", "", None, " " * 9, "qzxqzxqzx", "don't", "😀", "x" * 40] + [w for w in "Etouonchai que enmentré rementê retitioning theonred".split()]
    df = spark.createDataFrame([(w, "k") for w in words], "word string, ids string")
    got = {r.word: r.ids for r in encode_words(df, RANKS).collect()}
    assert all(got[w] == (fold_merges(w.encode(), codec(RANKS).ranks) if w else []) for w in words) and len(got) == len(words)


def test_wavelet_queries():
    x = np.array([5, 1, 5, 5, 9, 1, 70000, 5] * 300, np.uint32)
    w = WaveletMatrix.from_bytes(WaveletMatrix.build(x).to_bytes())
    assert (w.tokens() == x).all() and w.count(5) == 1200 and w.count(6) == 0
    for i in (0, 511, 512, 513, 1999, 2399):
        assert w.access(i) == x[i] and w.rank(5, i) == (x[:i] == 5).sum()
    assert [w.select(9, k) for k in (0, 7, 299)] == np.flatnonzero(x == 9)[[0, 7, 299]].tolist()
    y = np.random.default_rng(1).zipf(1.3, 150_000).clip(1, 60_000).astype(np.uint32)
    v = WaveletMatrix.from_bytes(WaveletMatrix.build(y).to_bytes())
    assert (v.tokens() == y).all() and all(v.access(i) == y[i] for i in range(0, len(y), 4999))
    for token in (1, 2, 77):
        at = np.flatnonzero(y == token)
        assert v.count(token) == len(at) and [v.select(token, k) for k in range(0, len(at), 997)] == at[::997].tolist()
        assert all(v.rank(token, i) == (y[:i] == token).sum() for i in (0, 511, 512, 65536, 149_999, 150_000))
    with pytest.raises(IndexError):
        w.select(9, 300)
    for y in ([], [3], [3, 3, 3]):
        assert WaveletMatrix.from_bytes(WaveletMatrix.build(np.array(y, np.uint32)).to_bytes()).tokens().tolist() == y


def test_shards(spark, rows, library):
    for part in (rows, rows[:1], []):
        out = new_path(spark, "t")
        write_shards(spark.createDataFrame(part, SCHEMA).repartition(3), JSON, out, shard_tokens=500)
        got = read_shards(spark, out).collect()
        docs = [(d, np.asarray(library(t) + [2], np.uint32)) for d, t, *_ in part]
        docs.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].astype(np.uint16).tobytes()))
        at, want = 0, []
        for d, x in docs:
            want.append((d, at, len(x), zlib.crc32(x)))
            at += len(x)
        assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_packing(spark, rows, library):
    got = packed(spark.createDataFrame(rows, SCHEMA).repartition(2), JSON, pool_tokens=3000).collect()
    seqs, docs = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        docs.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
    for pieces in seqs.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 2048
    padding = sum(0 if (n := sum(x[1] for x in p)) & (n - 1) == 0 else 2048 - n for p in seqs.values())
    assert padding == 0
    for d, t, *_ in rows:
        if d == 4:  # two documents share it
            continue
        ids, at = np.asarray(library(t) + [1], np.uint32), 0
        for start, n, crc, tokens in sorted(docs[d]):
            assert start == at and crc == zlib.crc32(ids[start : start + n]) and tokens == len(ids)
            at += n
        assert at == len(ids)
    assert packed(spark.createDataFrame([], SCHEMA), JSON).count() == 0


def test_pack_balances_cost():
    rnd = random.Random(1)
    sizes = [rnd.randint(1, 900) for _ in range(400)] + [5000]
    seqs, rest = pack(sizes, 2048)
    assert all(sum(p[2] for p in s) == 2048 for s in seqs) and sum(p[2] for p in rest) < 2048
    assert sum(p[2] for s in seqs + [rest] for p in s) == sum(sizes)
    assert sorted(sum(p[2] for p in s) for s in powers_of_two([(0, 0, 700), (1, 0, 323)])) == [1, 2, 4, 8, 16, 32, 64, 128, 256, 512]


def test_pack_takes_the_cheapest_sequence_with_room():
    rnd = random.Random(5)
    for most, sizes in [(2048, [min(2047, int(rnd.lognormvariate(5.2, 1.1)) + 1) for _ in range(1500)]), (64, [rnd.randint(1, 70) for _ in range(200)]), (8, [3, 3, 3, 3, 3, 3])]:
        seqs, rest = pack(sizes, most)
        todo = [(d, n // most * most, n % most) for d, n in enumerate(sizes) if n % most]
        full = sum(sizes) // most
        want = [[(d, k * most, most)] for d, n in enumerate(sizes) for k in range(n // most)]
        open_, left = [[] for _ in range(full - len(want))], []
        cost = lambda s: sum(n + n * n / 2048 for _, _, n in s)
        room = lambda s: most - sum(n for _, _, n in s)
        for d, start, n in sorted(todo, key=lambda p: (-p[2], p[0], p[1])):
            while n:
                fits = [s for s in open_ if room(s) >= n] or [s for s in open_ if room(s) and room(s) == max(map(room, open_))]
                if not fits:
                    left.append((d, start, n))
                    break
                s = min(fits, key=cost)
                take = min(n, room(s))
                s.append((d, start, take))
                start, n = start + take, n - take
        assert seqs == want + open_ and rest == left


def test_pieces_are_remembered_without_objects(library):
    """More pieces than the former memory held are encoded once, in less memory than its strings alone took; ids are the library's, also where memory is full."""
    import pyarrow as pa

    from quarry.llm.pieces import PieceEncoder, library_encoder

    enc, made = library_encoder(JSON, 300_000), []
    counted = PieceEncoder(lambda new: (made.append(len(new)), enc.encode_pieces(new))[1], enc.encode_text, remember=300_000)
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdeé中") for _ in range(rnd.randint(7, 9))) for _ in range(280_000)]
    texts = pa.array([" ".join(words[k : k + 700]) for k in range(0, len(words), 700)])
    first = counted.encode(texts)
    once = sum(made)
    again = counted.encode(texts)
    memory = counted.memory
    long = sum(len((" " + w).encode()) > 15 for w in words)
    assert once > 262_144 and sum(made) - once <= max(0, long - 65_536) * 2
    assert all((a == b).all() for a, b in zip(first, again))
    assert sum(x.nbytes for x in (memory.slots, memory.low, memory.high, memory.begins, memory.sizes)) < 56 * memory.known
    assert first[0][: first[1][1]].tolist() == library(texts[0].as_py())
    tiny = library_encoder(JSON, 5)
    odd = pa.array(["a a\0 a\0\0 \0", "exactly15bytes! exactly15bytes ", "sixteen-bytes-up", None, "é" * 8 + " " + "é" * 7, "x" * 70 + " " + "x" * 70, "one two three four five six seven"] * 3)
    for e in (tiny, enc):
        for _ in range(2):
            ids, at = e.encode(odd)
            assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library(t) for t in odd.to_pylist()]
    assert tiny.memory.known == 5


def test_bytes_without_ids(tmp_path):
    """A vocabulary that lacks bytes drops them; the rest of a piece's ids stay the piece's."""
    import json

    import pyarrow as pa
    from tokenizers import Tokenizer

    from quarry.llm.pieces import library_encoder

    spec = json.load(open(JSON))
    spec["model"]["vocab"] = {k: v for v, k in enumerate(["a", "b", "Ġ"])}
    spec["model"]["merges"], spec["added_tokens"] = [], []
    path = str(tmp_path / "few.json")
    json.dump(spec, open(path, "w"))
    tok, texts = Tokenizer.from_file(path), ["ab zz ba", "zzz", "a", "z b z"]
    ids, at = library_encoder(path).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [tok.encode(t).ids for t in texts]
