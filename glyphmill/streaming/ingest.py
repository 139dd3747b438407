"""Incremental counting: new text files add their word counts to a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphmill.operators.dictionary import word_counts


def count_words(spark: SparkSession, source: str, target: str, checkpoint: str) -> StreamingQuery:
    """Count the words of Parquet files (doc_id, text) that appear in ``source``.

    Each batch writes its own partial counts under its number, so a repeated batch replaces itself; ``counts`` sums them.
    """
    schema = "doc_id bigint, text string"

    def add(batch: DataFrame, number: int) -> None:
        word_counts(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(spark: SparkSession, target: str) -> DataFrame:
    """(tt, word, cnt) over all batches so far."""
    return spark.read.parquet(target).groupBy("tt", "word").agg(F.sum("cnt").alias("cnt"))
