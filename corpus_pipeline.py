"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, tokens.

Each stage gets what the one before kept, written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm import bytebpe, decontaminate, neardup, quality, secrets
from verdant.llm.shared import free_name, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.quality(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the least doc_id.

    Near copies have a Jaccard similarity of five-word shingles of 0.8 or more. Of equal rows one stays. A row without an id stays if none of its group has one.
    """
    groups, name, hashed = neardup.near_copies(docs), free_name(docs, "_first"), free_name(docs, "_hash")
    first = groups.where("doc_id <=> component_id").select(F.col("doc_id").alias(name)).distinct()
    kept = docs.join(first, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
    return kept.withColumn(hashed, F.xxhash64("text")).dropDuplicates(["doc_id", hashed]).drop(hashed)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced; n_chars follows."""
    clean = secrets.redacted(docs, secrets.train(docs))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the texts that are left."""
    return bytebpe.digests(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("tokens", tokens),
]

#: Hashes of fingerprints, automata and merges aren't SQL: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
