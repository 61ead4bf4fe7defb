"""Operator 10: documents packed into training sequences of balanced cost.

Each task packs the documents it reads, a pool of ids at a time. Documents are
taken by descending length; a sequence costs LINEAR * ids + QUADRATIC * (sum of
its pieces' squared lengths), as attention within each piece does. A document
goes to the open sequence of least cost with room for all of it; where none has
room it is cut to fill the sequence with most room, and what is left goes on so. As many sequences are open
as the pool's ids fill, so none is left half empty. The last ids of a task are
cut into sequences whose lengths are powers of two, which need no padding.

Defined cases: a null text is empty (its document is the one end id); repeated
rows and null doc_ids are documents of their own; an empty table gives no row;
extra columns are ignored. No shuffle: memory holds one pool and one batch.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quarry.llm.pieces import MEMO_PIECES, PIECE_CHUNK, library_encoder
from quarry.llm.storage import documents, only
from quarry.llm.workers import tidy

LINEAR, QUADRATIC = 1.0, 1.0 / 2048
#: Ids packed together: the open sequences of a pool are this many / the sequence's length.
POOL_TOKENS = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class OpenSequences:
    """Open sequences by room, each in a heap by cost; a tree over the rooms holds the least cost of each range."""

    NONE = (float("inf"), -1)

    def __init__(self, most: int, bins: int):
        self.size = 1 << most.bit_length()
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(most + 1)]
        self.tree = [self.NONE] * (2 * self.size)
        self.heaps[most] = [(0.0, b) for b in range(bins)]
        self._renew(most)

    def _renew(self, room: int) -> None:
        i, tree = self.size + room, self.tree
        tree[i] = self.heaps[room][0] if self.heaps[room] else self.NONE
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def add(self, room: int, cost: float, b: int) -> None:
        heapq.heappush(self.heaps[room], (cost, b))
        self._renew(room)

    def take(self, room: int) -> None:
        heapq.heappop(self.heaps[room])
        self._renew(room)

    def cheapest(self, n: int) -> int:
        """The sequence of least cost with room for n ids, -1 if there is none."""
        if n >= len(self.heaps):
            return -1
        i = self.size + n
        best = self.tree[i]
        while i > 1:
            if not i & 1:
                best = min(best, self.tree[i + 1])
            i >>= 1
        return best[1]

    def roomiest(self) -> int:
        """The cheapest of the sequences with most room, -1 if none is open."""
        if self.tree[1] == self.NONE:
            return -1
        i = 1
        while i < self.size:
            i = 2 * i + (self.tree[2 * i + 1] != self.NONE)
        return self.tree[i][1]


def pack(sizes: list[int], most: int) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
    """Packs documents of the given sizes into full sequences of `most` ids.

    Returns the sequences, each a list of (document, start, length), and the
    pieces that are left, fewer than `most` ids in all.
    """
    full = sum(sizes) // most
    rest: list[tuple[int, int, int]] = []
    out: list[list[tuple[int, int, int]]] = []
    todo: list[tuple[int, int, int]] = []
    for d, n in enumerate(sizes):  # whole sequences of long documents stand alone
        whole = min(n // most, full - len(out))
        out += [[(d, k * most, most)] for k in range(whole)]
        if n > whole * most:
            todo.append((d, whole * most, n - whole * most))
    todo.sort(key=lambda p: (-p[2], p[0], p[1]))
    bins = full - len(out)
    seqs: list[list[tuple[int, int, int]]] = [[] for _ in range(bins)]
    room, cost = [most] * bins, [0.0] * bins
    opened = OpenSequences(most, bins)

    def put(piece: tuple[int, int, int], b: int) -> None:
        opened.take(room[b])
        seqs[b].append(piece)
        room[b] -= piece[2]
        cost[b] += LINEAR * piece[2] + QUADRATIC * piece[2] ** 2
        if room[b]:
            opened.add(room[b], cost[b], b)

    for d, start, n in todo:
        while n:
            b = opened.cheapest(n)
            if b < 0:  # none has room for all of it
                b = opened.roomiest()
            if b < 0:
                rest.append((d, start, n))
                break
            take = min(n, room[b])
            put((d, start, take), b)
            start, n = start + take, n - take
    return out + seqs, rest


def powers_of_two(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Cuts what is left into sequences whose lengths are powers of two, largest first."""
    left = sum(p[2] for p in pieces)
    out: list[list[tuple[int, int, int]]] = []
    queue = pieces[::-1]
    while left:
        size = 1 << (left.bit_length() - 1)
        left -= size
        seq: list[tuple[int, int, int]] = []
        while size:
            d, start, n = queue.pop()
            take = min(n, size)
            seq.append((d, start, take))
            size -= take
            if n > take:
                queue.append((d, start + take, n - take))
        out.append(seq)
    return out


def packed(docs: DataFrame, path: str, most: int = 2048, end_id: int = 1, pool_tokens: int = POOL_TOKENS, remember: int = MEMO_PIECES) -> DataFrame:
    """Pieces of all documents (doc_id, text): see SCHEMA. A worker remembers the ids of so many words. Sequence ids hold the task's number in their upper half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = library_encoder(path, remember)
        base = TaskContext.get().partitionId() << 32
        # (doc_id, ids, first of them, ids of the whole document)
        held: list[tuple[int | None, np.ndarray, int, int]] = []
        total, used = 0, 0

        def rows(seqs: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal used
            cols: tuple[list, ...] = ([], [], [], [], [], [], [])
            for seq in seqs:
                at = 0
                for d, start, n in seq:
                    doc_id, ids, first, tokens = held[d]
                    for c, v in zip(cols, (doc_id, first + start, n, zlib.crc32(ids[start : start + n]), tokens, base + used, at)):
                        c.append(v)
                    at += n
                used += 1
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], [f.split()[0] for f in SCHEMA.split(", ")])

        def flush() -> pa.RecordBatch:
            nonlocal held, total
            seqs, rest = pack([len(x[1]) for x in held], most)
            out = rows(seqs)
            held = [(held[d][0], held[d][1][start : start + n], held[d][2] + start, held[d][3]) for d, start, n in rest]
            total = sum(len(x[1]) for x in held)
            return out

        for b in batches:
            doc_ids = iter(b.column(0).to_pylist())
            for ids, sizes in enc.encode_parts(b.column(1), PIECE_CHUNK):
                for x in np.split(ids, np.cumsum(sizes)[:-1]):
                    x = np.append(x, np.uint32(end_id))
                    held.append((next(doc_ids), x, 0, len(x)))
                    total += len(x)
                    if total >= pool_tokens:
                        yield flush()
        if total >= most:
            yield flush()
        if held:
            yield rows(powers_of_two([(k, 0, len(x[1])) for k, x in enumerate(held)]))

    return only(docs, "doc_id", "text").mapInArrow(tidy(run), SCHEMA)


def op10_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packed(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
