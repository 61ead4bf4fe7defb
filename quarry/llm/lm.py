"""Operator 1: stupid-backoff scores of documents under their own corpus.

A block of documents counts its word n-grams (64-bit hashes) and sends each
distinct one once to the part of the count tables that its hash belongs to;
there counts of all blocks add up and go back to the blocks that asked; each
block joins them to its documents' n-grams and sums per document. Blocks
pre-aggregate, so an n-gram that is in every document costs one entry a block.

log S(w | v) = ln(c(v w) / c(v)) where c(v w) >= min_count, else
ln(BACKOFF * c(w) / N); a document's first word takes ln(c(w) / N). With
leave_one_out a document's own occurrences are taken off all counts it is scored
by (a word seen nowhere else counts as once), so no text vouches for itself.

A-Z are lower-cased, all else stays as it is.

Defined cases: null, empty and blank texts have no words and a score of 0; rows
that repeat or lack a doc_id are scored as any other; an empty table gives no
row; extra columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.kernels import mix64, pair_hash, string_buffers, word_hashes
from quarry.llm.storage import documents, keep, only, parts_for
from quarry.llm.workers import tidy

U64 = np.uint64
BACKOFF = 0.4
#: Text bytes of a block of documents.
BLOCK_BYTES = 6 << 20
#: Input bytes for each part of the count tables.
PART_BYTES = 4 << 20


def _press(*arrays: np.ndarray) -> bytes:
    """Integer arrays as compressed byte planes."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    out = []
    for a in arrays:
        raw = press(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes())
        out += [struct.pack("<QBQ", len(a), a.itemsize, len(raw)), raw]
    return b"".join(out)


def _open(blob: bytes) -> list[np.ndarray]:
    import zstandard

    at, out = 0, []
    while at < len(blob):
        n, size, length = struct.unpack_from("<QBQ", blob, at)
        raw = zstandard.ZstdDecompressor().decompress(blob[at + 17 : at + 17 + length]) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(f"<u{size}").ravel())
        at += 17 + length
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word of all texts: the document, the hash of the word, of the pair it ends, and whether it has a word before it."""
    words, first = word_hashes(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    inner = np.ones(len(words), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    pair = np.zeros(len(words), U64)
    pair[1:] = pair_hash(words[:-1], words[1:])
    return doc, mix64(words ^ U64(0x2545F4914F6CDD1D)), pair, inner


def _of(h: np.ndarray, parts: int) -> np.ndarray:
    """Part of a hash: its range, so sorted hashes are cut into parts at once."""
    return ((h >> U64(32)) * U64(parts)) >> U64(32)


def scores(docs: DataFrame, min_count: int = 1, leave_one_out: bool = True) -> DataFrame:
    """(doc_id, n_words, n_backoff, score, mean_score) of every row of documents (doc_id, text)."""
    parts = parts_for(docs, PART_BYTES)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24

        def made(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids = pa.concat_arrays([b.column(0) for b in held])
            data, offsets = string_buffers(pa.chunked_array([b.column(1) for b in held]))
            _, word, pair, inner = ngrams(data, offsets)
            h, n = np.unique(np.concatenate([word, pair[inner]]), return_counts=True)
            cuts = np.searchsorted(_of(h, parts), np.arange(parts + 1))
            keys, kinds, blobs = [-1 - block], [-1], [_press(offsets, ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8), ids.fill_null(0).to_numpy()) + b""]
            text = zstandard.ZstdCompressor(level=3).compress(data.tobytes())
            for p in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[p], cuts[p + 1]
                keys.append(int(p))
                kinds.append(int(p))
                blobs.append(_press(np.diff(h[a:b], prepend=U64(0)), n[a:b].astype(np.uint32)))
            keys.append(-1 - block)
            kinds.append(-2)
            blobs.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([block] * len(keys), pa.int64()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["key", "block", "part", "blob"])

        held, size = [], 0
        for b in batches:
            # an Arrow batch may hold more than a block
            step = max(1, int(b.num_rows * BLOCK_BYTES / max(1, b.nbytes)))
            for lo in range(0, b.num_rows, step):
                s = b.slice(lo, step)
                held.append(s)
                size += s.nbytes
                if size >= BLOCK_BYTES:
                    yield from made(held)
                    held, size, block = [], 0, block + 1
        if held:
            yield from made(held)

    def answer(t: pa.Table) -> pa.Table:
        if t.column("key")[0].as_py() < 0:  # the texts of a block, on their way back
            return t.select(["block", "part", "blob"])
        hashes, counts = [], []
        for blob in t.column("blob").to_pylist():
            d, n = _open(blob)
            hashes.append(np.cumsum(d, dtype=U64))
            counts.append(n)
        every, where = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(where, np.concatenate(counts).astype(np.float64), len(every)).astype(U64)
        ends = np.cumsum([len(h) for h in hashes])
        blobs = [_press(total[w]) for w in np.split(where, ends[:-1])]
        return pa.table([t.column("block"), t.column("part"), pa.array(blobs, pa.binary())], ["block", "part", "blob"])

    def score(t: pa.Table) -> pa.Table:
        import zstandard

        rows = sorted(zip(t.column("part").to_pylist(), t.column("blob").to_pylist()), key=lambda r: r[0])
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(rows[0][1]) or b"", np.uint8)
        offsets, null, ids = _open(rows[1][1])
        offsets, docs_n = offsets.astype(np.int64), len(offsets) - 1
        doc, word, pair, inner = ngrams(data, offsets)
        h, where = np.unique(np.concatenate([word, pair[inner]]), return_inverse=True)
        count = np.concatenate([_open(b)[0] for _, b in rows[2:]] + [np.zeros(0, U64)]).astype(np.int64)
        n = len(word)
        doc_of = np.concatenate([doc, doc[inner]])
        c = count[where]
        if leave_one_out:
            _, back, own = np.unique(doc_of.astype(np.int64) * max(1, len(h)) + where, return_inverse=True, return_counts=True)
            c = c - own[back]
        single, double = c[:n], np.zeros(n, np.int64)
        double[inner] = c[n:]
        seen = double >= max(1, min_count)
        before = np.ones(n, np.int64)
        before[1:] = single[:-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            known = np.log(double) - np.log(np.maximum(before, double))
        value = np.where(seen, known, np.log(np.maximum(single, 1)) + np.where(inner, np.log(BACKOFF), 0.0))
        words = np.bincount(doc, minlength=docs_n)
        out = [np.bincount(doc, w, docs_n) for w in (value, ~seen, ~seen & inner)]
        doc_ids = pa.array(ids.astype(np.int64), mask=null.astype(bool))
        return pa.table([doc_ids, pa.array(words.astype(np.int64)), pa.array(out[2].astype(np.int64)), pa.array(out[1].astype(np.int64)), pa.array(out[0])], ["doc_id", "n_words", "n_backoff", "n_single", "raw"])

    asked = only(docs, "doc_id", "text").mapInArrow(tidy(ask), "key long, block long, part int, blob binary")
    told = asked.groupBy("key").applyInArrow(answer, "block long, part int, blob binary")
    raw = keep(told.groupBy("block").applyInArrow(score, "doc_id long, n_words long, n_backoff long, n_single long, raw double"), "lm")
    total = raw.agg(F.sum("n_words")).first()[0] or 1
    s = F.col("raw") - F.col("n_single") * F.log(F.lit(float(total)))
    return raw.select("doc_id", "n_words", "n_backoff", s.alias("score"), F.when(F.col("n_words") > 0, s / F.col("n_words")).otherwise(0.0).alias("mean_score"))


def op1_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(documents(spark, sf_dir))
    return s.withColumns({n: F.round(n, 4) for n in ("score", "mean_score")})
