"""Documents to packed training sequences, a stage at a time.

Each stage takes what its predecessor kept: toxic documents go, documents that
fail the quality rules go, one document of every group of near duplicates stays,
personal data is sanitised, and the rest is packed. All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import neardup, packing, pii, quality, toxicity
from quarry.llm.storage import keep
from quarry.llm.workers import small_batches

SHINGLE, PERCENT = 5, 80
#: Pieces that a packing worker remembers: fewer than alone, as executors hold what all stages have left.
PIECES = 1 << 17


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def without_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept_documents(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.deduplicated(docs, SHINGLE, PERCENT)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised(docs)


def in_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), remember=PIECES)


STAGES = [
    ("toxicity", without_toxic),
    ("quality rules", without_low_quality),
    ("near duplicates", without_near_duplicates),
    ("personal data", without_personal_data),
    ("packing", in_sequences),
]
#: Models, sketches and tokenizers have no form in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
