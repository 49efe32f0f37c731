"""From raw documents to packed sequences: five stages, each on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from locuspark.llm import decontaminate, packing, quality_rules, secret_scan, simhash
from locuspark.llm.queries import tokenizer_path
from locuspark.storage import release, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule, or whose host does, go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_first(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences of a fixed number of tokens."""
    return packing.pack(docs, tokenizer_path()).drop("source")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("secrets", secrets), ("packing", pack)]

#: SQL has no byte-pair encoder; the pipeline is tested against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written and read again as the next one's input, and then removed.

    Null and repeated ids, null texts and empty tables are taken by every stage; a null text has no words and goes with
    the quality rules.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        kept = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(docs)
        docs = kept
    return STAGES[-1][1](spark, docs, sf_dir)
