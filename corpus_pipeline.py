"""A corpus pipeline of the library's own operators: each stage's rows are written as Parquet and read by the next."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm import encode, mixing, simhash, substring, toxicity
from tablelens.session import bound_batches, checkpoint_dir, ship_package


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (trained on the labelled training rows among them) scores below 0.5 (3)."""
    ship_package(spark)
    bound_batches(spark)
    scored, score = toxicity.scored(docs, toxicity.train(docs, _labels(spark, sf_dir)))
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 3-word shingles, 3 bits (8)."""
    ship_package(spark)
    bound_batches(spark)
    marked, (_, _, kept) = simhash.near_duplicates(docs, 3, 3)
    return marked.where(F.col(kept)).select(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that another document has too (10); n_chars follows the text."""
    ship_package(spark)
    bound_batches(spark)
    out = substring.without_repeats(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it (2)."""
    quality = _labels(spark, sf_dir).select("doc_id", "quality")
    mixed, (_, _, _, copies, _) = mixing.mix(docs, quality)
    times = F.explode(F.array_repeat(F.lit(1), F.col(copies).cast("int")))
    return mixed.where(F.col(copies) > 0).select(*docs.columns, times).select(*docs.columns)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their texts (6)."""
    import public_tokenizers
    ship_package(spark)
    bound_batches(spark)
    return encode.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: training, hashing and alignment are not SQL: tested against brute force instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared checkpoint folder and read back."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = os.path.join(checkpoint_dir(spark), f"pipeline-{name}-{uuid.uuid4().hex}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
