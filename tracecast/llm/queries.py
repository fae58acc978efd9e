"""Registered queries of the operators in this subpackage: whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracecast.llm import classes, codes, fingerprints, langid, licences, mixing, ngram_join, packing, periodic, pii, quality, repeats, toxicity
from tracecast.llm.common import table
from tracecast.ship import ship


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without its repeats of 200 bytes."""
    return repeats.without_repeats(table(spark, folder, "documents"))


def op2_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document, and the terms that reveal it."""
    found = pii.detect(table(spark, folder, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


def op3_licences(spark: SparkSession, folder: str) -> DataFrame:
    """Own or inherited licence of every document."""
    docs = table(spark, folder, "documents")
    return licences.scan(docs.select("doc_id", licences.document_path().alias("path"), "text")).drop("links")


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics and the verdict on every document."""
    judged = quality.judge(table(spark, folder, "documents"), table(spark, folder, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *base, "base_failed", "kept", "score")


def _remainder(divisor: int):
    return F.crc32(F.col("doc_id").cast("string")) % divisor


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class, links and copies of every document at a Jaccard similarity of 0.8 over five-word windows."""
    return ngram_join.join(table(spark, folder, "documents"))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return packing.packed(table(spark, folder, "documents"))


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.fingerprints(table(spark, folder, "documents"))


def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(_remainder(4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels."""
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(_remainder(5) == 0, F.lit(False))
    model = toxicity.fit(docs, table(spark, folder, "labels").where(~held_out))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Every use of every document in the flattest mixture that repeats no source more than four times."""
    mixed = mixing.mixture(table(spark, folder, "documents"))
    return mixed.select(
        "doc_id", "source", F.col("mix_tokens").alias("n_tokens"), F.col("mix_weight").alias("weight"), F.col("mix_repeats").alias("repeats"),
        F.col("mix_epoch").alias("epoch"), F.col("mix_block").alias("block"), F.col("mix_at").alias("at"),
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words of every document, a tenth of which get a repeating tail."""
    docs = table(spark, folder, "documents")
    text = periodic.repeating_tail(F.col("text"), F.crc32(F.col("doc_id").cast("string")))
    found = periodic.runs(docs.select("doc_id", text.alias("text"))).withColumn("best", periodic.longest_exponent(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_class_bigrams(spark: SparkSession, folder: str) -> DataFrame:
    """Class-bigram and unigram scores of every document, learned from nine tenths of them."""
    held_out = F.coalesce(_remainder(10) == 0, F.lit(False))
    model = classes.fit(table(spark, folder, "documents"), ~held_out)
    return classes.score(model).select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", F.lit(int(model.bigrams.sum())).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )


def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """Product code of every usable vector, four parts of 256 entries after four rounds."""
    return codes.encode(table(spark, folder, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_QUERIES = (op1_suffix_dedup, op2_pii, op3_licences, op4_quality_rules, op5_ngram_join, op6_packing, op7_fingerprints, op8_language_id, op9_toxicity, op10_mixing, op11_periodic_runs, op12_class_bigrams, op13_vector_codes)


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(ship(spark), folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {query.__name__: _shipped(query) for query in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_licences": licences.oracle_sql()}
