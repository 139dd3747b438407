"""Spark-native text-model engine: normalise, count, tokenise, learn and query language models as DataFrame plans."""
