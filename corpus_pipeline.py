"""The corpus pipeline: quality rules, near-dedup, benchmark decontamination, secret redaction, packing.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever their names.
Repeated rows are decided alike, very long texts are taken whole, and an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.functions.scratch import fresh
from siltstone.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from siltstone.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule of the cascade rejects; a null text has no words and is rejected."""
    (kept,) = fresh(docs.columns, "kept")
    return quality_rules.quality_cascade(docs, name=kept).where(kept).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of texts with a Jaccard similarity of 0.8 or more over 5-word shingles: that of the smallest
    doc_id, ids before nulls, then the first read."""
    return simhash.keep_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; all of them where it is empty, and those without text."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.without_benchmark(docs, benchmark)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, n_chars brought up to date where the text changed and there is such a
    column; null texts stay null."""
    return secret_scan.redact_secrets(docs, n_chars="n_chars" if "n_chars" in docs.columns else None)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of fixed windows, with their token ids; an empty or null text is a piece of the end id."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("secret_scan", secrets),
    ("packing", packed),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
