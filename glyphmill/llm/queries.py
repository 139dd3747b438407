"""The queries of the training-data operators: each over its whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontaminate, langid, licenses, minhash, oracles, pii, quality, separators, sstable, substring
from glyphmill.llm.common import documents, free_name

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
END_OF_TEXT = 50256


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(documents(spark, sf_dir), bpe.tokenizer_path(BYTE_BPE), END_OF_TEXT)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    d = docs.select("doc_id", "text")
    report = free_name(d, "report")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", "kept")
    return quality.judge(d, rules, out=report).select("doc_id", *(F.col(f"{report}.{c}").alias(c) for c in names))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_all(documents(spark, sf_dir))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links at a Jaccard similarity of 0.85 over three-word shingles."""
    return minhash.classes(documents(spark, sf_dir), n_words=3, percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(documents(spark, sf_dir))


def op7_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.shard_digests(documents(spark, sf_dir), bpe.tokenizer_path(BYTE_BPE), end_id=0)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(documents(spark, sf_dir), bpe.tokenizer_path(WORD_BPE))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removals(documents(spark, sf_dir))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_quality_rules": op3_quality_rules,
        "op4_language_id": op4_language_id,
        "op5_minhash": op5_minhash,
        "op6_license_scan": op6_license_scan,
        "op7_sstable": op7_sstable,
        "op8_bpe": op8_bpe,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_pii": op10_pii,
    }


def oracle_sql() -> dict[str, str]:
    """Models, edit matching, tokenizers, file formats and keyed surrogates have no SQL form: tests hold them against brute force."""
    return {"op5_minhash": oracles.near_duplicates(), "op6_license_scan": oracles.license_scan(), "op9_substring_dedup": oracles.substring_dedup()}
