"""The queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import decontaminate, fim, html_blocks, licenses, oracle, packing, pii_crf, quality_rules, secret_scan, sharding, simhash, spelling, token_store, warc
from locuspark.storage import new_folder


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as responses, their derivatives written as WARC files, and what the files hold."""
    pages = _table(spark, sf_dir, "pages")
    path = new_folder(spark, "warc")
    warc.write(warc.derive(warc.responses(pages)), path)
    columns = ["warc_type", "record_id", "refers_to", "target_uri", "date", "content_type", "block_digest", "digest_holds"]
    return warc.read(spark, path).select(F.col("source_key").cast("bigint").alias("page_id"), *columns, F.length("block").cast("bigint").alias("content_length"), F.sha2("block", 256).alias("block_sha256"))


def op4_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.digest(pii_crf.find(_table(spark, sf_dir, "documents")))


def op5_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks.extract(_table(spark, sf_dir, "pages"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(_table(spark, sf_dir, "documents")))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_store.read(token_store.write(docs, tokenizer_path()), docs)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path()).drop("source")


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shuffled(_table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_license_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.fill_in_middle(_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_ownership": op1_secret_ownership,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_pii_crf": op4_pii_crf,
    "op5_html_blocks": op5_html_blocks,
    "op6_host_rules": op6_host_rules,
    "op7_token_store": op7_token_store,
    "op8_packing": op8_packing,
    "op9_shards": op9_shards,
    "op10_simhash": op10_simhash,
    "op11_license_rules": op11_license_rules,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_fill_in_middle": op13_fill_in_middle,
}
ORACLE_SQL: dict[str, str] = {
    "op1_secret_ownership": oracle.OP1,
    "op2_decontaminate": oracle.OP2,
    "op6_host_rules": oracle.OP6,
    "op11_license_rules": oracle.op11(),
    "op13_fill_in_middle": oracle.OP13,
}
