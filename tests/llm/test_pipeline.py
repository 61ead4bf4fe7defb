"""Toxicity on labels it hasn't seen, and the pipeline's stages against brute force."""

import os
import zlib

import pytest

import corpus_pipeline
from quarry.llm import neardup, quality, toxicity

DATA = "/root/testdata/sf0.01"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_folding_and_exceptions():
    m = toxicity.Model(((" moron ", 4.0), (" trash", 3.0)), (0.0, 1.0, 1.0))
    assert toxicity.weigh("You m0r0n, MОRОN! ｍoron", m) == (12.0, 4)  # the second with Cyrillic letters
    assert toxicity.weigh("the trash can", m) == (0.0, 3) and toxicity.weigh("trashy trash", m) == (6.0, 2)
    assert toxicity.weigh("", m) == (0.0, 0) and toxicity.weigh("oxymoron", m) == (0.0, 1)


def test_fit_without_labels(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "a", "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 1)], "doc_id long, toxic int")
    got = toxicity.scored(docs, toxicity.fit(docs, labels), "doc_id").collect()
    assert len(got) == 3 and len({r["__score"] for r in got}) == 1
    assert toxicity.accepted(docs, toxicity.fit(docs, labels)).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in toxicity.op7_toxicity_lexicon(spark, DATA).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if d in labels and r.held_out]
    right = sum(a == b for a, b in held) / len(held)
    false_alarms = sum(b for a, b in held if not a) / max(1, sum(not a for a, _ in held))
    assert right > 0.93 and false_alarms < 0.03


def rows_of():
    words = [f"word{i}" for i in range(400)]
    text = lambda k: " ".join(words[(k * 37 + j * j) % 400] for j in range(40))
    out = [(i, text(i), "en", "s", 1) for i in range(30)]
    out += [(100, text(3) + " more", "en", "s", 1), (101, text(3), "en", None, 1), (3, text(3), "en", "s", 1), (102, "short", "en", "s", 1), (103, None, None, None, None), (104, "a b " * 60, "en", "s", 1)]
    return out


def test_stages_keep_columns_and_clean_rows(spark):
    docs = spark.createDataFrame([(*r, "extra") for r in rows_of()], COLUMNS + ", kept string")
    good = quality.kept_documents(docs)
    assert good.columns == docs.columns
    ids = sorted(r.doc_id for r in good.collect())
    assert ids == sorted([*range(30), 3, 100, 101])
    one = neardup.deduplicated(good)
    assert one.columns == docs.columns and sorted(r.doc_id for r in one.collect()) == list(range(30))
    empty = docs.filter("false")
    assert quality.kept_documents(empty).count() == 0 and neardup.deduplicated(empty).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_runs(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "near duplicates", "personal data", "packing"]
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert out and all(sum(n for _, n in p) <= 2048 for p in seqs.values())


def saved(spark, at, docs, labels):
    spark.createDataFrame(docs, COLUMNS + ", key string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_pipeline_end_to_end(spark, tmp_path):
    """Every token of every document that stays is in one place of one sequence; nulls, repeats and columns with clashing names pass through."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(*r, "k") for r in rows_of()] + [(None, rows_of()[5][1] + " no id", "en", "s", 1, "k"), (200, "mail bob@x.org " + rows_of()[7][1][50:] + " tail", "en", "s", 1, None)]
    at = saved(spark, tmp_path / "a", rows, [(1, 1, 0), (None, None, None)])
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        docs = corpus_pipeline.keep(out, "test")
    kept = docs.collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted([*map(str, range(30)), "None", "200"]) and any(r.text.startswith("mail [EMAIL] ") for r in kept)
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: tok.encode(r.text or "", add_special_tokens=False).ids + [1] for r in kept}
    packed = corpus_pipeline.run(spark, at).collect()
    assert {r.doc_id: r.doc_tokens for r in packed} == {d: len(x) for d, x in want.items()}
    for d, ids in want.items():
        pieces = sorted((r.start, r.length, r.ids_crc32) for r in packed if r.doc_id == d)
        assert sum(n for _, n, _ in pieces) == len(ids) and all(zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a : a + n])) == c for a, n, c in pieces)
    empty = saved(spark, tmp_path / "b", [], [])
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_stages_send_small_batches(spark):
    """A batch of the default 10,000 rows would be held several times over beside what the stages have left."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame(rows_of(), COLUMNS)
    before = spark.conf.get(name)
    try:
        for rows, want in (("10000", "500"), ("0", "500"), ("100", "100")):
            spark.conf.set(name, rows)
            corpus_pipeline.in_sequences(spark, docs, "")
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, before)
