"""Activity n-gram features in tall form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.functions.sequences import ngram_positions
from tracecast.settings import Settings


def _shown() -> Column:
    return F.array_join("gram", " ")


def first_lengths(rows: DataFrame, key: str = "case_id", settings: Settings = Settings()) -> DataFrame:
    """``(key, gram, ngram, n, first_len)``: occurrences and the shortest cut that already holds the n-gram.

    ``gram`` is the array of labels and the key; ``ngram`` shows it, blank-joined, and need not be unique.

    A cut of length ``l`` holds exactly the n-grams with ``first_len <= l``, so this
    one table stands for the features of every prefix length.
    """
    grams = F.explode(ngram_positions(F.col("acts"), settings.ngram_min, settings.ngram_max))
    return (
        rows.select(key, grams.alias("g"))
        .select(key, F.col("g.ngram").alias("gram"), F.col("g.last").alias("last"))
        .groupBy(key, "gram")
        .agg(F.count(F.lit(1)).alias("n"), F.min("last").alias("first_len"))
        .select(key, "gram", _shown().alias("ngram"), "n", "first_len")
    )


def vocabulary(features: DataFrame, settings: Settings = Settings(), weight: str | None = None) -> DataFrame:
    """``(gram, ngram, n_traces)``: all n-grams, or the ``max_features`` found in most traces, ties by name; a row counts as ``weight`` traces."""
    counted = features.groupBy("gram").agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n_traces")).select("gram", _shown().alias("ngram"), "n_traces")
    if settings.max_features is None:
        return counted
    return counted.orderBy(F.desc("n_traces"), "gram").limit(settings.max_features)


def binary_features(features: DataFrame, vocab: DataFrame, key: str = "case_id") -> DataFrame:
    """``(key, gram, ngram)``: presence of vocabulary n-grams."""
    return features.join(vocab, "gram", "left_semi").select(key, "gram", "ngram")


def prefix_features(features: DataFrame, vocab: DataFrame, max_len: DataFrame, key: str = "case_id") -> DataFrame:
    """``(key, length, gram, ngram)`` for every cut length from 2 to the longest trace; shorter traces stay whole."""
    longest = max_len.select("max_len", F.lit(1).alias("one"))
    return (
        features.join(vocab, "gram", "left_semi")
        .withColumn("one", F.lit(1))
        .join(longest, "one")
        .where("greatest(2, first_len) <= max_len")
        .select(
            key,
            F.explode(F.sequence(F.greatest(F.lit(2), "first_len"), F.col("max_len").cast("int"))).alias("length"),
            "gram",
            "ngram",
        )
    )
