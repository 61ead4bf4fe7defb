"""Operator 9: token files as wavelet matrices.

Texts become token ids; ids in ascending doc_id order become shards, each one
compressed image of a wavelet matrix: bit-planes in compressed blocks, each with
its rank directory and select samples. Access, rank, select and counting read
those and open only the blocks that they need.

Defined cases: a null text is empty (only the end id); null doc_ids come first;
rows that share a doc_id follow each other ordered by their ids; an empty table
gives no shard and no row; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from quarry.llm.pieces import library_encoder
from quarry.llm.storage import documents, new_path, only, parts_for
from quarry.llm.workers import tidy

MAGIC = b"QWM2"
#: Bits between two entries of a rank directory.
STEP = 512
#: Ones, and zeros, between two select samples.
SAMPLE = 4096
#: Bytes of a plane that are compressed as one block.
BLOCK = 8192
#: Ids of a shard, unless one document alone has more.
SHARD_TOKENS = 1 << 18
#: Input bytes for each range of doc_ids.
RANGE_BYTES = 8 << 20


class Plane:
    """A bit-plane in compressed blocks, with what its file holds to rank and select: ones before every STEP bits, places of every SAMPLE-th one and zero."""

    def __init__(self, n: int, blocks: list[bytes], ranks: np.ndarray, samples: tuple[np.ndarray, np.ndarray]):
        self.n, self.blocks, self.ranks, self.samples = n, blocks, ranks, samples
        self._open: dict[int, np.ndarray] = {}

    @classmethod
    def of(cls, bit: np.ndarray) -> Plane:
        import zstandard

        raw = np.packbits(bit, bitorder="little")
        ones = np.add.reduceat(bit, np.arange(0, len(bit), STEP), dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        press = zstandard.ZstdCompressor(level=1).compress
        blocks = [press(raw[k : k + BLOCK].tobytes()) for k in range(0, len(raw), BLOCK)]
        return cls(len(bit), blocks, ranks, tuple(np.flatnonzero(b)[::SAMPLE].astype(np.uint32) for b in (~bit, bit)))

    def block(self, k: int) -> np.ndarray:
        if k not in self._open:
            import zstandard

            self._open[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.blocks[k], BLOCK), np.uint8)
        return self._open[k]

    def bits(self) -> np.ndarray:
        """All bits, whose blocks aren't kept open."""
        import zstandard

        more = zstandard.ZstdDecompressor()
        raw = np.frombuffer(b"".join(more.decompress(b, BLOCK) for b in self.blocks), np.uint8)
        return np.unpackbits(raw, count=self.n, bitorder="little").view(bool)

    def _step(self, s: int) -> np.ndarray:
        """The bits from s * STEP up to the next entry of the directory."""
        at = s * (STEP // 8)
        return np.unpackbits(self.block(at // BLOCK)[at % BLOCK : at % BLOCK + STEP // 8], count=min(STEP, self.n - s * STEP), bitorder="little")

    def get(self, i: int) -> int:
        return int(self.block((i >> 3) // BLOCK)[(i >> 3) % BLOCK] >> (i & 7) & 1)

    def rank1(self, i: int) -> int:
        """Ones before position i."""
        s = i // STEP
        return int(self.ranks[s]) + (int(self._step(s)[: i % STEP].sum()) if i % STEP else 0)

    def select(self, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one, or zero: from the nearest sample, the directory, and one step's bits."""
        before = (lambda s: int(self.ranks[s])) if bit else (lambda s: min(s * STEP, self.n) - int(self.ranks[s]))
        known = self.samples[bit]
        lo = int(known[k // SAMPLE]) // STEP
        hi = int(known[k // SAMPLE + 1]) // STEP + 1 if k // SAMPLE + 1 < len(known) else len(self.ranks) - 1
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if before(mid) <= k else (lo, mid)
        return lo * STEP + int(np.flatnonzero(self._step(lo) == bit)[k - before(lo)])

    def to_bytes(self) -> bytes:
        body = [struct.pack("<III", len(self.blocks), len(self.samples[0]), len(self.samples[1])), struct.pack(f"<{len(self.blocks)}I", *map(len, self.blocks))]
        return b"".join([*body, np.diff(self.ranks).astype(np.uint16).tobytes(), *(x.tobytes() for x in self.samples), *self.blocks])

    @classmethod
    def from_bytes(cls, raw: memoryview, at: int, n: int) -> tuple[Plane, int]:
        blocks, zeros, ones = struct.unpack_from("<III", raw, at)
        at += 12
        sizes = struct.unpack_from(f"<{blocks}I", raw, at)
        at += 4 * blocks
        steps = -(-n // STEP)
        ranks = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.uint16, steps, at), dtype=np.int64)]).astype(np.uint32)
        at += 2 * steps
        samples = (np.frombuffer(raw, np.uint32, zeros, at), np.frombuffer(raw, np.uint32, ones, at + 4 * zeros))
        at += 4 * (zeros + ones)
        parts = []
        for size in sizes:
            parts.append(bytes(raw[at : at + size]))
            at += size
        return cls(n, parts, ranks, samples), at


class WaveletMatrix:
    """Sequence of ids as bit-planes, most significant first, over the dense codes of its alphabet."""

    def __init__(self, n: int, alphabet: np.ndarray, zeros: list[int], planes: list[Plane]):
        self.n, self.alphabet, self.zeros, self.planes = n, alphabet, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        if not len(ids):
            return cls(0, np.zeros(0, np.uint32), [], [])
        seen = np.bincount(ids)
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        code = np.zeros(len(seen), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        code[alphabet] = np.arange(len(alphabet))
        x, zeros, planes = code[ids], [], []
        for level in reversed(range(max(1, int(len(alphabet) - 1).bit_length()))):
            bit = (x & x.dtype.type(1 << level)) != 0
            planes.append(Plane.of(bit))
            low = x.take(np.flatnonzero(~bit))
            zeros.append(len(low))
            x = np.concatenate([low, x.take(np.flatnonzero(bit))])
        return cls(len(ids), alphabet, zeros, planes)

    def tokens(self) -> np.ndarray:
        """All ids in order: the stable partitions undone from the last plane to the first."""
        x = np.zeros(self.n, np.uint16 if len(self.alphabet) <= 1 << 16 else np.uint32)
        for level, (plane, z) in enumerate(zip(reversed(self.planes), reversed(self.zeros))):
            bit = plane.bits()
            out = np.empty_like(x)
            out[np.flatnonzero(~bit)] = x[:z]
            out[np.flatnonzero(bit)] = x[z:] | x.dtype.type(1 << level)
            x = out
        return self.alphabet[x] if self.n else np.zeros(0, np.uint32)

    def access(self, i: int) -> int:
        code = 0
        for plane, z in zip(self.planes, self.zeros):
            bit, ones = plane.get(i), plane.rank1(i)
            code = code << 1 | bit
            i = z + ones if bit else i - ones
        return int(self.alphabet[code])

    def _bits(self, token: int) -> list[int] | None:
        """The bits of a token's code, None if it isn't in the alphabet."""
        at = int(np.searchsorted(self.alphabet, token))
        if at >= len(self.alphabet) or self.alphabet[at] != token:
            return None
        return [at >> k & 1 for k in reversed(range(len(self.planes)))]

    def _range(self, bits: list[int], i: int) -> tuple[int, int]:
        """Where the token's occurrences before i lie below the last plane."""
        a = 0
        for bit, plane, z in zip(bits, self.planes, self.zeros):
            ra, ri = plane.rank1(a), plane.rank1(i)
            a, i = (z + ra, z + ri) if bit else (a - ra, i - ri)
        return a, i

    def rank(self, token: int, i: int) -> int:
        """Occurrences of a token before position i."""
        bits = self._bits(token)
        if bits is None:
            return 0
        a, b = self._range(bits, i)
        return b - a

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0) of a token, followed up the planes; IndexError if there is none."""
        bits = self._bits(token)
        a, b = self._range(bits, self.n) if bits is not None else (0, 0)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for bit, plane, z in zip(reversed(bits), reversed(self.planes), reversed(self.zeros)):
            i = plane.select(bit, i - z if bit else i)
        return i

    def to_bytes(self) -> bytes:
        head = [MAGIC, struct.pack("<QIB", self.n, len(self.alphabet), len(self.planes)), self.alphabet.tobytes(), struct.pack(f"<{len(self.zeros)}Q", *self.zeros)]
        return b"".join(head + [p.to_bytes() for p in self.planes])

    @classmethod
    def from_bytes(cls, image: bytes) -> WaveletMatrix:
        if image[:4] != MAGIC:
            raise ValueError("not a wavelet matrix")
        raw = memoryview(image)
        n, letters, levels = struct.unpack_from("<QIB", raw, 4)
        at = 17
        alphabet = np.frombuffer(raw, np.uint32, letters, at)
        at += 4 * letters
        zeros = list(struct.unpack_from(f"<{levels}Q", raw, at))
        at += 8 * levels
        planes = []
        for _ in range(levels):
            plane, at = Plane.from_bytes(raw, at, n)
            planes.append(plane)
        return cls(n, alphabet, zeros, planes)


def id_ranges(docs: DataFrame, ranges: int) -> list[int]:
    """Bounds of about equally many doc_ids; as many numbers as ranges, whatever the table's size."""
    found = docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    return sorted(set(found or []))


def encoded(docs: DataFrame, path: str, end_id: int | None, bounds: list[int]) -> DataFrame:
    """(range, doc_id, ids): unsigned little-endian ids of every whole text, two bytes each where all fit, else four."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = library_encoder(path)
        cuts = np.asarray(bounds, np.int64)
        for b in batches:
            ids, first = enc.encode(b.column(1))
            out = []
            for k in range(b.num_rows):
                x = ids[first[k] : first[k + 1]]
                if end_id is not None:
                    x = np.append(x, np.uint32(end_id))
                out.append(x.astype(np.uint16).tobytes() + b"\2" if not len(x) or x.max() < 1 << 16 else x.tobytes() + b"\4")
            at = np.searchsorted(cuts, b.column(0).fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), "right")
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), b.column(0), pa.array(out, pa.binary())], ["range", "doc_id", "ids"])

    return only(docs, "doc_id", "text").mapInArrow(tidy(run), "range int, doc_id long, ids binary")


def unpack_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint16 if raw[-1] == 2 else np.uint32, (len(raw) - 1) // raw[-1])


def write_shards(docs: DataFrame, path: str, out: str, end_id: int | None = 2, shard_tokens: int = SHARD_TOKENS) -> None:
    """Writes the shards of documents (doc_id, text) to folder `out`: in each file one shard a row, in ascending doc_id order.

    Ranges of doc_ids are found first from the ids alone, so texts are encoded
    once and move once. The writer is Spark's: a lost task is written again and
    only committed files are seen.
    """
    ranges = parts_for(docs, RANGE_BYTES)
    rows = encoded(docs, path, end_id, id_ranges(docs, ranges))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []
        docs_in: list[int | None] = []
        held, shard, now = 0, 0, None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(kept)
            row = [[now], [shard], [len(ids)], [docs_in], [[len(x) for x in kept]], [WaveletMatrix.build(ids).to_bytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], ["range", "shard", "n_tokens", "doc_ids", "sizes", "image"])

        for b in batches:
            for r, d, raw in zip(*(b.column(k).to_pylist() for k in range(3))):
                x = unpack_ids(raw)
                if kept and (r != now or held + len(x) > shard_tokens):
                    yield flush()
                    shard = shard + 1 if r == now else 0
                    kept, docs_in, held = [], [], 0
                now = r
                kept.append(x)
                docs_in.append(d)
                held += len(x)
        if kept:
            yield flush()

    placed = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("range", F.asc_nulls_first("doc_id"), "ids")
    placed.mapInArrow(tidy(run), "range int, shard int, n_tokens long, doc_ids array<long>, sizes array<long>, image binary").write.option("compression", "none").parquet(out)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Per document of the shards: doc_id, start (ids before it in all), n_tokens and ids_crc32, all from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r, s, ids, sizes, image in zip(*(b.column(k).to_pylist() for k in range(5))):
                x = WaveletMatrix.from_bytes(image).tokens()
                first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
                crc = [zlib.crc32(x[a:b]) for a, b in zip(first[:-1], first[1:])]
                n = len(ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r] * n, pa.int32()), pa.array([s] * n, pa.int32()), pa.array(ids, pa.int64()), pa.array(first[:-1]), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())],
                    ["range", "shard", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    shards = spark.read.parquet(path)
    docs = shards.select("range", "shard", "doc_ids", "sizes", "image").mapInArrow(tidy(run), "range int, shard int, doc_id long, at long, n_tokens long, ids_crc32 long")
    # one small row a shard: a running sum over ranges, then over the shards of a range
    per = shards.groupBy("range").agg(F.sum("n_tokens").alias("n"))
    before = per.select("range", (F.sum("n").over(W.orderBy("range")) - F.col("n")).alias("range_at"))
    within = shards.select("range", "shard", (F.sum("n_tokens").over(W.partitionBy("range").orderBy("shard")) - F.col("n_tokens")).alias("shard_at"))
    starts = within.join(before, "range").select("range", "shard", (F.col("range_at") + F.col("shard_at")).alias("base"))
    return docs.join(starts, ["range", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def op9_wavelet_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = new_path(spark, "op9")
    write_shards(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), out)
    return read_shards(spark, out)
