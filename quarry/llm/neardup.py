"""Operator 5: near-duplicate classes by one-permutation MinHash.

1. Each text becomes the set of its word shingles (64-bit hashes) and one
   permutation's sketch: the least hash of each of BINS bins, empty bins filled
   by optimal densification (each probes bins in a fixed random order of its own
   until one is filled). Bands of ROWS bins give a document's buckets.
2. Texts with equal sets collapse into one class, so copies are never paired.
3. A star: every class is paired with one centre only, the least class of all
   its buckets, so there is at most one pair a class; each is confirmed on the
   full sets. Components of these links close most buckets.
4. In buckets that hold several components still, all classes are compared, so a
   link that no centre sees is found: cell by cell, each of two blocks of at most
   BLOCK classes and about BLOCK_BYTES of sets. A cell counts all intersections
   exactly and returns only links that join components, never its pairs.

At a Jaccard of exactly 0.8 a pair shares a band with probability above
1 - 3e-6 (42 bands of 6); all links are confirmed exactly.

Defined cases: null or empty texts, or texts without a word, have an empty set
and link with nothing; a text of fewer words than a shingle is one shingle; rows
that repeat are one class; a null doc_id never is a component's id unless it has
no other; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarry.llm.kernels import mix64, pair_hash, string_buffers, word_hashes
from quarry.llm.storage import discard, documents, keep, only
from quarry.llm.workers import tidy

U64 = np.uint64
BINS, ROWS = 252, 6
#: Ids sent to all executors at most (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Copies of a table that is too large for that, in a join on keys that may be hot.
SALTS = 16
#: A key of more rows than this is hot, and of more than total / HOT_KEYS, so hot keys are HOT_KEYS at most.
HOT_ROWS, HOT_KEYS = 256, 100_000
#: Pairs with one centre that are confirmed as one stream.
CELL = 256
#: Classes, and bytes of their sets, of a block of a bucket; items in a matrix at once.
BLOCK, BLOCK_BYTES, SLICE = 1024, 8 << 20, 2048


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the `width`-word shingles of each text."""
    data, offsets = string_buffers(column)
    words, first = word_hashes(data, offsets)
    grams = words
    for k in range(1, width):
        grams = pair_hash(grams[: len(grams) - 1], words[k:])
    out = []
    for a, b in zip(first[:-1], first[1:]):
        n = b - a
        if n >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif n:
            h = words[a : a + 1]
            for k in range(1, n):
                h = pair_hash(h, words[a + k : a + k + 1])
            out.append(mix64(h ^ U64(n)))
        else:
            out.append(np.zeros(0, U64))
    return out


@functools.lru_cache(maxsize=1)
def _probes() -> np.ndarray:
    """For every bin a fixed random sequence of bins; longer than any probing needs in practice."""
    bins, tries = np.arange(BINS, dtype=U64)[:, None], np.arange(4096, dtype=U64)[None, :]
    return (mix64(bins * U64(0x100000001B3) + tries * U64(0x9E3779B97F4A7C15)) % U64(BINS)).astype(np.int16)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One-permutation sketches, densified; a row of BINS hashes for each set that isn't empty."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = mix64(np.concatenate(sets) ^ U64(0x5851F42D4C957F2D)) if len(sets) else np.zeros(0, U64)
    out = np.full((len(sets), BINS), np.iinfo(U64).max, U64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    which = (flat >> U64(32)) * U64(BINS) >> U64(32)
    np.minimum.at(out, (doc, which.astype(np.int64)), flat)
    filled = np.zeros(out.shape, bool)
    filled[doc, which.astype(np.int64)] = True
    rows, cols = np.nonzero(~filled & (sizes > 0)[:, None])
    probes = _probes()
    for t in range(probes.shape[1]):
        if not len(rows):
            break
        source = probes[cols, t]
        hit = filled[rows, source]
        out[rows[hit], cols[hit]] = out[rows[hit], source[hit]]
        rows, cols = rows[~hit], cols[~hit]
    for r, c in zip(rows, cols):  # beyond all probes: the set's least hash
        out[r, c] = out[r][filled[r]].min()
    return out


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each sketch; the band's number is part of it."""
    h = np.zeros((len(sketch), BINS // ROWS), U64) + np.arange(BINS // ROWS, dtype=U64)
    for k in range(ROWS):
        h = pair_hash(h, sketch[:, k::ROWS])
    return h.astype(np.int64)


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, key, bands): key is a 128-bit hash of the whole set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                sets = shingle_sets(b.column(1), width)
                bands = band_keys(sketches(sets))
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                n = bands.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(np.arange(0, n * len(sets) + 1, n), pa.int32()), pa.array(bands.ravel()))],
                    ["doc_id", "n_shingles", "key", "bands"],
                )

    return only(docs, "doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, key binary, bands array<long>")


def bounded_join(left: DataFrame, ids: DataFrame, on: str, how: str) -> DataFrame:
    """Join with a table of ids that goes to all executors only if its counted rows are few."""
    return left.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str) -> DataFrame:
    """Left join with one row a key at most; keys may be hot: few rows go to all executors, many are copied to SALTS places by a hash of column `by`."""
    if right.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        return left.join(F.broadcast(right), on, "left")
    salted = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn("__salt", F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")).join(salted, [on, "__salt"], "left").drop("__salt")


def sized_join(left: DataFrame, right: DataFrame, on: str, size: str, total: int) -> DataFrame:
    """Inner join with `right`, whose column `size` counts the left rows of each key (total in all): keys of many rows go to all executors, at most total / limit of them."""
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = right.filter(F.col(size) > limit)
    if not hot.limit(1).count():
        return left.join(right, on)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.filter(F.col(size) <= limit), on)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def set_table(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, items): the full sets of the given nodes, made again from the texts of their first documents."""
    wanted = classes.join(nodes, "node").select("node", "rep", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                b = batch.slice(lo, 200)
                sets = shingle_sets(b.column(1), width)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "items"])

    texts = bounded_join(only(docs, "doc_id", "text"), wanted.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    if wanted.filter("rep is null").limit(1).count():
        texts = texts.unionByName(only(docs, "doc_id", "text").filter("doc_id is null"))
    return texts.mapInArrow(tidy(run), "key binary, items binary").dropDuplicates(["key"]).join(wanted.select("node", "key"), "key").select("node", "items")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union of two sorted sets."""
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that are similar on the full sets.

    Each a comes with its set once; b's set comes once for every CELL pairs of
    b, which are one cell, read as a stream that begins with b.
    """
    pairs = pairs.join(pairs.groupBy("b").agg(F.ceil(F.count("*") / CELL).cast("int").alias("cells")), "b")
    placed = pairs.select("b", F.pmod(F.xxhash64("a"), F.col("cells")).cast("int").alias("cell"), "a")
    heads = placed.select("b", "cell").distinct().select("b", "cell", F.lit(0).alias("rank"), F.col("b").alias("node"))
    rows = heads.unionByName(placed.select("b", "cell", F.lit(1).alias("rank"), F.col("a").alias("node"))).join(sets, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: tuple[int, np.ndarray] | None = None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            for b, rank, node, items in zip(*(batch.column(k) for k in range(4))):
                items = np.frombuffer(items.as_buffer(), U64)
                if not rank.as_py():
                    head = (b.as_py(), items.copy())
                elif head is not None and similar(head[1], items, percent):
                    out[0].append(node.as_py())
                    out[1].append(head[0])
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["a", "b"])

    dealt = rows.repartition("b", "cell").sortWithinPartitions("b", "cell", "rank").select("b", "rank", "node", "items")
    return dealt.mapInArrow(tidy(run), "a long, b long")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, exact.

    Items in many sets are counted by products of 0/1 matrices, SLICE items at a
    time, items in few by their pairs.
    """
    nl, nr = len(left), len(right)
    sizes = [len(x) for x in (*left, *right)]
    at = np.repeat(np.arange(nl + nr), sizes)
    _, item = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    ln, rn = (np.bincount(item[side], minlength=int(item.max()) + 1 if len(item) else 0) for side in (at < nl, at >= nl))
    out = np.zeros((nl, nr), np.int32)
    pairs = ln * rn
    order = np.argsort(item, kind="stable")
    item, at = item[order], at[order]
    for many in (True, False):
        wanted = (pairs > 16) if many else (pairs > 0) & (pairs <= 16)
        use = wanted[item]
        code = (np.cumsum(wanted) - 1)[item[use]]
        who = at[use]
        if many:
            for lo in range(0, int(wanted.sum()), SLICE):
                a, b = np.searchsorted(code, [lo, lo + SLICE])
                m = np.zeros((nl + nr, SLICE), np.float32)
                m[who[a:b], code[a:b] - lo] = 1
                out += (m[:nl] @ m[nl:].T).astype(np.int32)
        elif len(code):
            # codes are sorted, and within a code the left sets stand before the right ones
            l_at, r_at = np.flatnonzero(who < nl), np.flatnonzero(who >= nl)
            each = rn[wanted][code[l_at]]
            first = np.searchsorted(code[r_at], code[l_at])
            j = np.repeat(first - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            np.add.at(out, (np.repeat(who[l_at], each), who[r_at[j]] - nl), 1)
    return out


def cell_links(nodes: np.ndarray, comps: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links (a, b) between the sets at `left` and `right` that join components apart until then; every set is compared."""
    both = overlaps([sets[i] for i in left], [sets[j] for j in right]).astype(np.int64)
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    close = 100 * both >= percent * (sizes[left][:, None] + sizes[right][None, :] - both)
    close &= comps[left][:, None] != comps[right][None, :]
    comps, out = comps.copy(), []
    for i, j in zip(*np.nonzero(close)):
        i, j = left[i], right[j]
        if comps[i] != comps[j]:
            out.append((int(min(nodes[i], nodes[j])), int(max(nodes[i], nodes[j]))))
            comps[comps == comps[j]] = comps[i]
    return out


def compare_cells(percent: int):
    """Function of batches sorted by (band, lo, hi): the links of each such cell, between its chunks lo and hi or within lo."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> list[tuple[int, int]]:
            nodes, comps, chunk = (np.array([r[k] for r in held], np.int64) for k in range(3))
            if len(held) < 2 or (comps == comps[0]).all():
                return []
            sets = [np.frombuffer(r[3], U64) for r in held]
            return cell_links(nodes, comps, sets, np.flatnonzero(chunk == now[1]), np.flatnonzero(chunk == now[2]), percent)

        for batch in batches:
            out: list[tuple[int, int]] = []
            for cell, row in zip(zip(*(batch.column(k).to_pylist() for k in range(3))), zip(*(batch.column(k).to_pylist() for k in range(3, 7)))):
                if cell != now:
                    if held:
                        out += done()
                    now, held = cell, []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])
        if held:
            out = done()
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node reachable, for every node of the links (a, b).

    Each round takes the least label among neighbours and then the label of that
    label, so chains of length n take about log n rounds. Labels of nodes with
    many links go to all executors: HOT_KEYS of them at most.
    """
    edges = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    degrees = edges.groupBy("b").agg(F.count("*").alias("links"))
    total = edges.count()
    limit = max(HOT_ROWS, total // HOT_KEYS)
    hot = keep(degrees.filter(F.col("links") > limit).select("b"), "hubs")
    some = hot.limit(1).count() > 0
    calm = keep(edges.join(F.broadcast(hot), "b", "left_anti"), "edges") if some else edges
    busy = keep(edges.join(F.broadcast(hot), "b"), "edges") if some else None
    labels = keep(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")), "labels")
    while True:
        of = labels.select(F.col("node").alias("b"), "comp")
        seen = calm.join(of, "b").select("a", "comp")
        if busy is not None:
            seen = seen.union(busy.join(F.broadcast(of.join(F.broadcast(hot), "b")), "b").select("a", "comp"))
        seen = seen.groupBy("a").agg(F.min("comp").alias("near"))
        near = labels.join(seen, labels.node == seen.a).select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.filter("node <> comp").select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        jump = jump.join(labels.select("comp").distinct(), "comp", "left_semi")
        new = keep(spread_join(near, jump, "comp", "node").select("node", "old", F.least("comp", F.coalesce("far", "comp")).alias("comp")), "labels")
        discard(labels)
        if not new.filter("old <> comp").limit(1).count():
            return new.select("node", "comp")
        labels = new.select("node", "comp")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of documents (doc_id, text)."""
    sigs = keep(signatures(docs, width), "signatures")
    firsts = sigs.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("n_shingles").alias("items_n"), F.count("*").alias("copies"))
    classes = keep(firsts.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", "items_n", F.explode("bands").alias("band"))
    total = classes.count() * (BINS // ROWS)
    buckets = keep(banded.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("low"), F.sum("items_n").alias("all_items")).filter("n > 1"), "buckets")
    members = keep(sized_join(banded, buckets, "band", "n", total), "members")
    # a star: every class meets one centre only, the least class of all its buckets
    pairs = keep(members.groupBy(F.col("node").alias("a")).agg(F.min("low").alias("b")).filter("a <> b"), "pairs")
    sets = keep(set_table(docs, classes, members.select("node").distinct(), width), "sets")
    comps = components(keep(confirm(pairs, sets, percent), "links"))
    # buckets that hold several components still
    placed = keep(spread_join(members, comps, "node", "band").withColumn("comp", F.coalesce("comp", "node")), "placed")
    mixed = placed.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).filter("x <> y").select("band", "m")
    open_ = sized_join(placed, mixed, "band", "m", total)
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, 8 * F.col("all_items") / BLOCK_BYTES)).cast("int")
    cells = open_.withColumn("chunk", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    cells = cells.select("band", "node", "comp", "chunk", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    cells = cells.select("band", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "node", "comp", "chunk").join(sets, "node")
    cells = cells.repartition("band", "lo", "hi").sortWithinPartitions("band", "lo", "hi").select("band", "lo", "hi", "node", "comp", "chunk", "items")
    late = keep(cells.mapInArrow(tidy(compare_cells(percent)), "a long, b long").distinct(), "late")
    if late.limit(1).count():  # links between components, of which the first round's are the nodes now
        of = lambda n: comps.select(F.col("node").alias(n), F.col("comp").alias(f"of_{n}"))
        named = spread_join(spread_join(late, of("a"), "a", "b"), of("b"), "b", "a")
        across = keep(named.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")).distinct(), "across")
        last = components(across)
        before = comps.unionByName(last.select("node").join(comps.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp")))
        comps = keep(spread_join(before, last.select(F.col("node").alias("comp"), F.col("comp").alias("last")), "comp", "node").select("node", F.coalesce("last", "comp").alias("comp")), "components")
    reps = comps.join(classes.select("node", "rep"), "node")
    ids = keep(reps.groupBy("comp").agg(F.min("rep").alias("component_id")), "component-ids")
    named = keep(spread_join(comps, ids, "comp", "node").select("node", "component_id"), "component-of")
    of_class = keep(classes.select("node", "key", "rep", "copies").join(named, "node", "left").select("key", "copies", F.coalesce("component_id", "rep").alias("component_id")), "classes-named")
    out = sized_join(sigs.filter("key is not null").drop("bands"), of_class, "key", "copies", total)
    out = out.select("doc_id", "n_shingles", "component_id").unionByName(sigs.filter("key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One document of each class, the one of least doc_id, and every document that links with nothing; all columns.

    Rows that repeat a kept doc_id stay once. Texts move only if the doc_ids to
    drop are too many to go to all executors.
    """
    found = keep(near_duplicates(docs, width, percent).withColumnRenamed("doc_id", "d"), "classes-of")
    gone = found.filter("not kept").select(F.col("d").alias("doc_id")).distinct()
    twice = found.filter("kept and d is not null").groupBy("d").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias("doc_id"))
    out = bounded_join(docs, gone, "doc_id", "left_anti")
    if twice.limit(1).count():
        again = bounded_join(out, twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
        out = bounded_join(out, twice, "doc_id", "left_anti").unionByName(again)
    return out.select(*docs.columns)


def op5_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)
