"""Trace assembly, variants and prefix expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def traces(log: DataFrame) -> DataFrame:
    """``(case_id, acts)``: one row per case, activities in event order."""
    events = F.array_sort(F.collect_list(F.struct("ord", "activity")))
    return (
        log.groupBy("case_id")
        .agg(events.alias("events"))
        .select("case_id", F.col("events.activity").alias("acts"))
    )


def variants(trace_rows: DataFrame, *keys: str) -> DataFrame:
    """Distinct sequences with their trace count; ``variant_id`` is the first case id.

    ``keys`` keeps variants apart per key, e.g. per model.
    """
    return (
        trace_rows.groupBy(*keys, "acts")
        .agg(F.count(F.lit(1)).alias("n_traces"), F.min("case_id").alias("first_case_id"))
        .select(*keys, F.col("first_case_id").alias("variant_id"), "acts", "n_traces", "first_case_id")
    )


def trainable(trace_rows: DataFrame) -> DataFrame:
    """Traces with a second activity."""
    return trace_rows.where(F.size("acts") >= 2)


def prefix_lengths(trace_rows: DataFrame) -> DataFrame:
    """One row per (trace, length) with ``2 <= length < n``; sequences stay whole, to slice late."""
    lengths = F.sequence(F.lit(2), F.size("acts") - 1)
    return trace_rows.where(F.size("acts") >= 3).select("*", F.explode(lengths).alias("length"))


def prefixes(trace_rows: DataFrame) -> DataFrame:
    """``(case_id, length, prefix, suffix)`` for every test prefix."""
    return prefix_lengths(trace_rows).select(
        "case_id",
        "length",
        F.slice("acts", 1, F.col("length")).alias("prefix"),
        suffix_of("acts", "length").alias("suffix"),
    )


def suffix_of(acts: str, length: str):
    return F.slice(F.col(acts), F.col(length) + 1, F.size(acts))


def longest_case(log: DataFrame) -> DataFrame:
    """Length of the longest case, counted without gathering events."""
    return log.groupBy("case_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("max_len"))


def max_trace_length(trace_rows: DataFrame) -> DataFrame:
    return trace_rows.agg(F.max(F.size("acts")).cast("bigint").alias("max_len"))
