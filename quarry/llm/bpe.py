"""Operator 3: byte-level BPE by ranked merges, and its inverse.

A text is cut by the pattern; every distinct piece that a worker meets is encoded
once by folding the merges in order of rank over its bytes: the pair of neighbours
whose union has the least rank joins, until no union has a rank. Decoding
concatenates the ids' binary pieces. The rank map has a fixed size (the vocabulary).

`encode_words` does the same for a table of words in column expressions alone: a
higher-order fold over each word's byte array, with the rank map as one literal (an
array of small maps, chosen by a hash of the key, as a lookup in one map reads all
of it). Whole texts don't go that way: the ids of a text's words must come back to
it, which needs more disk and time than there is (README has the figures).

Defined cases: a null text is empty (no ids, hash of nothing); rows keep their
number and doc_id whatever repeats or is null; a null or empty word has no ids;
extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarry.llm.kernels import spread
from quarry.llm.native import let
from quarry.llm.pieces import PieceEncoder
from quarry.llm.storage import documents, only
from quarry.llm.workers import tidy

#: Pieces of more bytes than this are merged with a heap instead of a scan for the least rank; the ids are the same.
SCAN_BYTES = 64
#: Maps that the literal rank map is made of.
RANK_MAPS = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def fold_merges(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: ranked merges folded over its bytes."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    if len(piece) > SCAN_BYTES:
        return _fold_long(piece, ranks)
    parts = [piece[i : i + 1] for i in range(len(piece))]
    get, none = ranks.get, 1 << 62
    pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i < len(pairs):
            pairs[i] = get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = get(parts[i - 1] + parts[i], none)
    return [ranks[p] for p in parts]


def _fold_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in n log n steps: a heap of (rank, place) over a linked list of parts."""
    import heapq

    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins at i; 0 for none
    before = list(range(-1, n - 1))
    get = ranks.get

    def offer(i: int) -> None:
        j = end[i]
        if j < n and (r := get(piece[i : end[j]])) is not None:
            heapq.heappush(heap, (r, i, end[j]))

    heap: list[tuple[int, int, int]] = []
    for i in range(n - 1):
        offer(i)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # one of the two has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class BytePairCodec:
    """Encoder and decoder of a rank file."""

    def __init__(self, path: str):
        self.ranks = load_ranks(path)
        pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for p, r in self.ranks.items():
            pieces[r] = p
        self.sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(pieces), np.uint8)
        self.encoder = PieceEncoder(self.encode_pieces, self.encode_text)

    def encode_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of distinct pieces, and the number of each."""
        lists = [fold_merges(p.encode(), self.ranks) for p in pieces]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(itertools.chain.from_iterable(lists), np.uint32, int(sizes.sum())), sizes

    def encode_text(self, text: str) -> list[int]:
        """A whole text with the pattern itself, for characters on which Unicode tables may differ."""
        import public_tokenizers
        import tiktoken

        if not hasattr(self, "_exact"):
            self._exact = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.ranks, special_tokens={})
        return self._exact.encode_ordinary(text)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """Bytes of ids: their binary pieces one after the other."""
        return self.flat[spread(ids.astype(np.int64), self.sizes, self.begins)]


_CODECS: dict[str, BytePairCodec] = {}


def codec(path: str) -> BytePairCodec:
    if path not in _CODECS:
        _CODECS[path] = BytePairCodec(path)
    return _CODECS[path]


@functools.lru_cache(maxsize=2)
def rank_json(path: str) -> str:
    """The rank map as JSON: RANK_MAPS maps of hexadecimal byte strings to ranks, each key in the map of its hash."""
    import xxhash

    maps: list[dict[str, int]] = [{} for _ in range(RANK_MAPS)]
    for piece, rank in load_ranks(path).items():
        key = piece.hex().upper()
        signed = xxhash.xxh64_intdigest(key.encode(), 42)
        maps[(signed - (1 << 64) if signed >> 63 else signed) % RANK_MAPS][key] = rank
    return json.dumps(maps, separators=(",", ":"))


def folded_ids(piece: Column, path: str) -> Column:
    """Ids of a piece (array<int>): the fold of ranked merges over its bytes."""
    literal = F.from_json(F.lit(rank_json(path)), "array<map<string,int>>")
    return let(literal, lambda ranks: _fold(F.hex(F.encode(piece, "UTF-8")), ranks))  # the literal stands in the plan once


def _fold(hexed: Column, ranks: Column) -> Column:
    rank_of = lambda key: F.try_element_at(F.element_at(ranks, (F.pmod(F.xxhash64(key), F.lit(RANK_MAPS)) + 1).cast("int")), key)
    pair = lambda parts, i: rank_of(F.concat(F.element_at(parts, i), F.element_at(parts, i + 1)))
    state = lambda parts, pairs: F.struct(parts.alias("parts"), pairs.alias("pairs"))
    none = F.array().cast("array<int>")

    def start(h: Column) -> Column:
        n = (F.length(h) / 2).cast("int")
        parts = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(h, i * 2 - 1, F.lit(2)))
        return let(parts, lambda p: state(p, F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: pair(p, i))).otherwise(none)))

    def join(acc: Column, i: Column) -> Column:
        """The state after parts i and i + 1 have become one."""

        def of(parts: Column) -> Column:
            n = F.size(parts)  # one fewer than before
            left = F.when(i > 1, F.array(pair(parts, F.greatest(i - 1, F.lit(1))))).otherwise(none)
            right = F.when(i < n, F.array(pair(parts, F.least(i, F.greatest(n - 1, F.lit(1)))))).otherwise(none)
            old = acc["pairs"]
            return state(parts, F.concat(F.slice(old, F.lit(1), F.greatest(i - 2, F.lit(0))), left, right, F.slice(old, i + 2, F.greatest(F.size(old) - i - 1, F.lit(0)))))

        was = acc["parts"]
        merged = F.concat(F.slice(was, F.lit(1), i - 1), F.array(F.concat(F.element_at(was, i), F.element_at(was, i + 1))), F.slice(was, i + 2, F.greatest(F.size(was) - i - 1, F.lit(0))))
        return let(merged, of)

    def step(acc: Column, _: Column) -> Column:
        return let(F.array_min(acc["pairs"]), lambda least: F.when(least.isNull(), acc).otherwise(let(F.array_position(acc["pairs"], least).cast("int"), lambda i: join(acc, i))))

    def fold(h: Column) -> Column:
        whole = rank_of(h)
        steps = F.sequence(F.lit(1), F.greatest((F.length(h) / 2).cast("int") - 1, F.lit(1)))
        merged = F.aggregate(steps, start(h), step, lambda acc: F.transform(acc["parts"], rank_of))
        return F.when(whole.isNotNull(), F.array(whole)).otherwise(merged)

    return let(hexed, fold)


def encode_words(words: DataFrame, path: str, column: str = "word") -> DataFrame:
    """The table with ids (array<int>) of each word, which is taken as one piece; no Python runs. Time grows with the square of a word's length."""
    word = F.coalesce(F.col(f"`{column}`"), F.lit(""))
    return words.withColumn("ids", F.when(word == "", F.array().cast("array<int>")).otherwise(folded_ids(word, path)))


def encode_table(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids, first = c.encoder.encode(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, ids array<int>")


def decode_table(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text binary) of rows (doc_id, ids array<int>); null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            out = [c.decode(np.asarray(x or [], np.int64)).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["doc_id", "text"])

    return only(rows, "doc_id", "ids").mapInArrow(tidy(run), "doc_id long, text binary")


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """Per document: number and hash of its ids, and the hash of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids, first = c.encoder.encode(b.column(1))
            cols: tuple[list, ...] = ([], [], [])
            for lo, hi in zip(first[:-1], first[1:]):
                x = ids[lo:hi]
                cols[0].append(int(hi - lo))
                cols[1].append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                cols[2].append(hashlib.sha256(c.decode(x)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trips(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
