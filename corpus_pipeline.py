"""The training-data pipeline: quality rules, near-duplicates, decontamination, surrogates for personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared folder and gives
what it reads back to the next stage. All stages but the last return the columns of their input, whatever these are.

Rows without doc_id, rows with the same doc_id and repeated rows are judged each by its own text; of rows with the same text
one stays (near_duplicates), that of the least doc_id. Null and empty texts are rejected by the first stage. Very long
texts are read whole by every stage. Empty tables, also of labels or benchmark items, give empty results or let all pass.
Counted as part of ``glyphmill.llm``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontaminate, minhash, pii, quality
from glyphmill.llm.common import documents, free_name, materialise

#: Words of a shingle and similarity (percent) from which two documents are near-duplicates in the pipeline.
SHINGLE_WORDS, SIMILARITY = 5, 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list rejects."""
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    report = free_name(docs, "report")
    return quality.judge(docs, rules, out=report).where(F.col(f"{report}.kept")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.deduplicate(docs, SHINGLE_WORDS, SIMILARITY)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with surrogates for personal data; ``n_chars``, where there is one, follows the new text."""
    out = pii.replace(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, their number and digest, and the digest of the decoded text."""
    d = docs.select("doc_id", "text")
    return bpe.encode_decode(d, bpe.tokenizer_path("word_bpe_49k.json"), out="bpe", decoded=False).select(
        "doc_id", F.col("bpe.n_tokens").alias("n_tokens"), F.col("bpe.ids").alias("ids"), F.col("bpe.ids_sha256").alias("ids_sha256"), F.col("bpe.decoded_sha256").alias("decoded_sha256")
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("surrogates", surrogates),
    ("token_ids", token_ids),
]

#: Learned rules, edit matching, keyed surrogates and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
