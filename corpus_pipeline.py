"""The corpus pipeline: quality rules, near-duplicates, secrets, mixture, packing.

Every stage works on all that its predecessor kept; all but the last return the columns they got.
``run`` writes each stage as Parquet in the shared folder and reads it again as the next one's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import minhash, mixing, packing, quality, secrets
from tidemark.llm.common import fresh_path, made, remove, sweep
from tidemark.llm.queries import _vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a risk-controlled cutoff rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of the smallest doc_id."""
    return minhash.deduplicated(docs, shingle=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in brackets."""
    return secrets.redacted(docs)


def source_mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are left out or repeated, at most once, so that sources come near their target words."""
    return mixing.mixed(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 1024 tokens, with digests of their ids."""
    return packing.digests(packing.pack(docs, _vocabulary("byte_bpe_50k.json"), end_id=0, window=1024))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("secret scans", secret_scans),
    ("mixing sources to target weights", source_mixture),
    ("packing", pack_windows),
]

#: SQL can express neither the signatures nor the tokens; tests hold ``run`` against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's result replaces its predecessor's; what a stage staged for itself goes once it is written."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (_, stage) in enumerate(STAGES):
        path, before = fresh_path(spark, f"pipeline-{i}"), len(made())
        stage(spark, docs, sf_dir).write.parquet(path)
        sweep(spark, before)
        remove(spark, last)
        docs, last = spark.read.parquet(path), [path]
    return docs
