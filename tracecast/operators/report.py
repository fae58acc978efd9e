"""Statistics over prediction lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.settings import Settings


def describe(lines: DataFrame, column: str = "damerau_similarity") -> DataFrame:
    """Count, range, mean, sample variance, biased skewness and excess kurtosis.

    Constant values have skewness 0 and kurtosis -3.
    """
    x = F.col(column)
    return lines.agg(
        F.count(x).alias("nobs"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg(x).alias("mean"),
        F.var_samp(x).alias("variance"),
        F.coalesce(F.nanvl(F.skewness(x), F.lit(None)), F.lit(0.0)).alias("skewness"),
        F.coalesce(F.nanvl(F.kurtosis(x), F.lit(None)), F.lit(-3.0)).alias("kurtosis"),
    )


def decision_source_tally(sources: DataFrame) -> DataFrame:
    """Decisions taken from the exact context, any context and the default, one row each."""
    totals = sources.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_pf_plus", "n_pf", "n_first")])
    return totals.select(
        F.expr("stack(3, 'pf+', n_pf_plus, 'pf', n_pf, 'first', n_first) as (source, n_decisions)")
    )


def run_report(lines: DataFrame, n_train: DataFrame, settings: Settings, **extra) -> DataFrame:
    """One row: settings, row counts and similarity statistics.

    ``n_train`` is a one-row frame with ``n_train``, e.g. a count of the training traces.
    """
    columns = {**settings.as_dict(), **extra}
    stats = describe(lines).withColumn("n_test", F.col("nobs")).select("*", F.lit(1).alias("run"))
    return (
        n_train.select("n_train", F.lit(1).alias("run"))
        .join(stats, "run")
        .drop("run")
        .select(*[(F.lit(None).cast("int") if v is None else F.lit(v)).alias(k) for k, v in columns.items()], "*")
    )


def require_test_prefixes(prefix_rows: DataFrame) -> DataFrame:
    if prefix_rows.isEmpty():
        raise ValueError("empty event log: no test prefix")
    return prefix_rows


