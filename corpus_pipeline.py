"""The corpus pipeline: quality rules, near-duplicates, decontamination, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents, in order, whatever further columns docs have."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import decontam, packing, quality, secret_scan, simhash
from terrane.llm.common import removed, shared_dir, table, working


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id."""
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; others stay as they are."""
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and n_chars follows."""
    return secret_scan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each document, with its sequence and its place there."""
    return packing.packed_documents(docs)


STAGES = [("quality_rules", quality_rules), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secret_scans", secret_scans), ("best_fit_packing", best_fit_packing)]

#: Expectation-maximisation, SimHash and the tokenizer have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{k}-{name}"
        with working(spark):
            stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if k:
            removed(spark, f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
    return docs
