"""A language's three models as one object: train, save, load, compare, export."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.operators import dictionary as dic
from glyphmill.operators import ngram, vocabulary
from glyphmill.operators.vocabulary import Vocabulary
from glyphmill.sources import formats
from glyphmill.sources.storage import cut


def release_name(lang: str, date: str) -> str:
    return f"language-models-{lang}-{date}"


def fingerprint(df: DataFrame) -> tuple[int, int]:
    """(rows, order-independent hash): equal for equal models."""
    return tuple(df.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64(*df.columns)), F.lit(0))).first())


@dataclass(frozen=True)
class LanguageModels:
    """``words`` (idx, tt, word, length), ``vocab``, ``contexts`` (ctx, first, second)."""

    words: DataFrame
    vocab: Vocabulary
    contexts: DataFrame
    strategy: str = "xor"

    @classmethod
    def train(cls, docs: DataFrame, strategy: str = "xor", id_col: str = "doc_id", text_col: str = "text", least: int = 1) -> LanguageModels:
        """Learn all three from a corpus; the vocabulary and the words are computed at once."""
        vocab = vocabulary.learn(docs, text_col)
        tokens = vocabulary.tokenize_training(docs, vocab, (id_col,), text_col)
        return cls(dic.dictionary(docs, text_col), vocab, ngram.model(tokens, strategy, id_col, least), strategy)

    def save(self, path: str) -> None:
        spark = self.words.sparkSession
        self.words.write.mode("overwrite").parquet(f"{path}/words")
        self.vocab.frame(spark).write.mode("overwrite").parquet(f"{path}/vocabulary")
        self.contexts.write.mode("overwrite").parquet(f"{path}/contexts")

    @classmethod
    def load(cls, spark: SparkSession, path: str, strategy: str = "xor") -> LanguageModels:
        entries = tuple((r["token"], r["seq"]) for r in spark.read.parquet(f"{path}/vocabulary").orderBy("token").collect())
        return cls(spark.read.parquet(f"{path}/words"), Vocabulary(entries), spark.read.parquet(f"{path}/contexts"), strategy)

    def export(self, folder: str) -> list[str]:
        """The three binary files with their text companions."""
        names = [f"{folder}/{n}" for n in ("dictionary.bin", "vocabulary.bin", "ngrams.bin")]
        formats.write_dictionary(self.words, names[0])
        formats.write_vocabulary(self.vocab.entries, names[1])
        formats.write_ngrams(self.contexts, names[2])
        return [*names, names[0] + ".txt", names[1] + ".txt"]

    def same_as(self, other: LanguageModels) -> bool:
        return self.vocab == other.vocab and fingerprint(self.words) == fingerprint(other.words) and fingerprint(self.contexts) == fingerprint(other.contexts)

    def spell_check(self, texts: DataFrame, limit: int, id_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
        return dic.spell_check(texts, self.words, limit, id_cols, text_col)

    def generate(self, prompts: DataFrame, steps: int, key_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
        return ngram.generate(prompts, self.contexts, self.vocab, steps, key_cols, self.strategy, text_col)

    def branches(self, prompts: DataFrame, max_branches: int, max_chars: int, key_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
        return ngram.predict_branches(prompts, self.contexts, self.vocab, max_branches, max_chars, key_cols, self.strategy, text_col)

    def correct_and_generate(self, prompts: DataFrame, steps: int, key_cols: tuple[str, ...], text_col: str = "text") -> DataFrame:
        """(keys, corrected, generated): each word replaced by its closest word, then generation from the corrected prompt."""
        fixed = cut(dic.correct_sentence(prompts, self.words, key_cols, text_col))  # asked twice
        return fixed.join(self.generate(fixed, steps, key_cols, "corrected"), list(key_cols))
