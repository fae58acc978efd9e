"""Ordered train/test split and the validation cut, without a global sort in one task."""

from __future__ import annotations

import itertools
import math
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tracecast.settings import Settings

#: Quantiles asked of the sketch, its accuracy, and the distinct values of a bracket that are counted one by one.
_GRID = 1_000
_ACCURACY = 20_000
_SMALL_BRACKET = 200_000


def _ranges(rows: DataFrame, column: str) -> list[Row]:
    """``(n, lo, hi)`` of each range partition of a column, in order; one row per partition reaches the driver."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (
        rows.select(column)
        .where(F.col(column).isNotNull())
        .repartitionByRange(parts, column)
        .groupBy(F.spark_partition_id().alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi"))
        .collect()
    )
    return sorted(found, key=lambda r: r["lo"])


def _ordered(kind: str, offset: int) -> Column:
    """A number that grows with ``value``, though it may be equal for different ones; of text the seven bytes after ``offset``."""
    value = F.col("value")
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(value, "utf-8"), offset + 1, 7)), 14, "0"), 16, 10).cast("bigint")
    if kind == "date":
        return F.unix_date(value).cast("bigint")
    if kind.startswith("timestamp"):
        return F.unix_micros(value.cast("timestamp"))
    return value.cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else value.cast("double")


def _bracket(keyed: DataFrame, low, high) -> tuple[int, list[Row]]:
    """Rows below ``low``, and the values up to ``high`` with their counts, the smallest ones only if they are too many."""
    part = keyed.where(F.col("key") <= high).select(F.when(F.col("key") >= low, F.col("value")).alias("value"))
    counts = part.groupBy("value").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("value").asc_nulls_first()).limit(_SMALL_BRACKET + 1).collect()
    below = counts[0]["n"] if counts and counts[0]["value"] is None else 0
    return below, [r for r in counts if r["value"] is not None]


def value_at_rank(rows: DataFrame, column: str, rank_of: Callable[[int], int]):
    """Exact value of ``column`` at 1-based rank ``rank_of(row count)``; None below rank 1, the largest beyond the last.

    A mergeable quantile sketch brackets the rank; one pass then counts what is below the bracket and every value in it.
    A bracket of too many values is bracketed again; what cannot be narrowed any more is ordered.
    """
    kind, rank, offset = dict(rows.dtypes)[column], None, 0
    values = rows.select(F.col(column).alias("value")).where("value is not null")
    probabilities = [i / _GRID for i in range(_GRID + 1)]
    while True:
        keyed = values.withColumn("key", _ordered(kind, offset))
        found = keyed.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("key", probabilities, _ACCURACY).alias("grid"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
        n, grid = found["n"], found["grid"]
        if rank is None:
            rank = min(rank_of(n), n)
        if rank < 1 or found["lo"] == found["hi"]:
            return found["lo"] if rank >= 1 else None
        at = rank * _GRID / n
        low, high = grid[max(0, math.floor(at) - 1)], grid[min(_GRID, math.ceil(at) + 1)]
        if grid[0] < grid[-1]:
            below, counts = _bracket(keyed, low, high)
            if below >= rank or (below + sum(r["n"] for r in counts) < rank and len(counts) < _SMALL_BRACKET):  # the sketch was off
                low, high = grid[0], grid[-1]
                below, counts = _bracket(keyed, low, high)
            for row in counts:
                below += row["n"]
                if below >= rank:
                    return row["value"]
            below -= sum(r["n"] for r in counts)
            rank, narrower = rank - below, (low, high) != (grid[0], grid[-1])
            values = keyed.where(F.col("key").between(low, high)).select("value")
        else:
            shared = len(os.path.commonprefix([found["lo"], found["hi"]]).encode()) if kind == "string" else 0
            narrower, offset = shared > offset, max(offset, shared)
        if not narrower:
            return values.select("value").orderBy("value").offset(rank - 1).limit(1).first()[0]


def _range_index(column: str, lows: list) -> Column:
    """0-based index of the range a value falls in; two short scans instead of one over all ranges."""
    step = math.isqrt(len(lows) - 1) + 1
    up_to = lambda bounds: F.size(F.filter(bounds, lambda lo: lo <= F.col(column))) - 1
    block = up_to(F.array(*[F.lit(lo) for lo in lows[::step]]))
    blocks = F.array(*[F.array(*[F.lit(lo) for lo in lows[i : i + step]]) for i in range(0, len(lows), step)])
    return block * step + up_to(F.get(blocks, block))


def enumerate_rows(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 0-based rank by a unique column: a window per range plus the rows before the range."""
    ranges = _ranges(rows, column)
    if not ranges:
        return rows.withColumn(name, F.lit(None).cast("bigint"))
    before = [0, *itertools.accumulate(r["n"] for r in ranges[:-1])]
    offset = F.get(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("part"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(column))
    ranked = rows.withColumn("part", _range_index(column, [r["lo"] for r in ranges]))
    return ranked.withColumn(name, offset + within - 1).drop("part")


def train_cutoff(trace_rows: DataFrame):
    """Last case id of the training part: the first ``2 * ceil(n / 3)`` cases by id."""
    return value_at_rank(trace_rows, "case_id", lambda n: min(n, 2 * math.ceil(n / 3)))


def _is_train(trace_rows: DataFrame) -> Column:
    cutoff = train_cutoff(trace_rows)
    return F.lit(False) if cutoff is None else F.col("case_id") <= F.lit(cutoff)


def train_test_split(trace_rows: DataFrame) -> DataFrame:
    """Adds ``is_train`` to every trace."""
    return trace_rows.withColumn("is_train", _is_train(trace_rows))


def validation_cases(train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Case ids of the validation sample: exactly ``round(ratio * n)``, chosen by a seeded hash."""
    seeded = F.concat_ws(":", F.col("case_id").cast("string"), F.lit(str(settings.seed)))
    keyed = train.select("case_id", F.md5(seeded).alias("h"))
    cutoff = value_at_rank(keyed, "h", lambda n: round(settings.ratio_validation * n))
    return keyed.where(F.lit(False) if cutoff is None else F.col("h") <= F.lit(cutoff)).select("case_id")


def cut_validation(train: DataFrame, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``(remaining training traces, validation traces)``."""
    chosen = validation_cases(train, settings)
    return train.join(chosen, "case_id", "left_anti"), train.join(chosen, "case_id", "left_semi")


def split_counts(train: DataFrame, test_prefixes: DataFrame) -> DataFrame:
    """Training traces and test *prefix rows*, as the run report counts them."""
    sides = train.select(F.lit(1).alias("train"), F.lit(0).alias("test")).unionAll(
        test_prefixes.select(F.lit(0), F.lit(1))
    )
    return sides.agg(
        F.coalesce(F.sum("train"), F.lit(0)).alias("n_train"),
        F.coalesce(F.sum("test"), F.lit(0)).alias("n_test"),
    )
