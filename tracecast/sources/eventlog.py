"""Event-log sources: CSV files, and any table with a case, an activity and an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column that orders the events of a file that has it.
TIMESTAMP = "CompleteTimestamp"

#: Label given to an event without an activity.
MISSING_ACTIVITY = "nan"


def _checked(value: Column, kind: str, name: str) -> Column:
    """``value`` in another type; a value that has no place in it is an error, not a null."""
    cast = value.try_cast(kind)
    lost = F.raise_error(F.concat(F.lit(f"{name}: no {kind}: "), value)).cast(kind)
    return F.when(value.isNull() | cast.isNotNull(), cast).otherwise(lost)


def read_csv_log(
    spark: SparkSession,
    path: str,
    case: str = "CaseID",
    activity: str = "ActivityID",
    order: str | None = None,
    case_type: str | None = None,
) -> DataFrame:
    """Event log of CSV files with a header; columns are bound by name and may stand in any order.

    Events are ordered by the ``order`` column (``CompleteTimestamp``, where there is one), then by their place in
    the files, read by path. Case ids keep their text unless all of them are whole numbers in plain notation, or
    ``case_type`` names another type; a value that does not fit it raises.
    """
    files = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    known = {name.strip(): name for name in files.columns}
    if absent := [name for name in (case, activity, order) if name and name not in known]:
        raise ValueError(f"{path}: no column {', '.join(absent)} among {', '.join(known)}")
    if order is None and TIMESTAMP in known:
        order = TIMESTAMP
    column = lambda name: F.col(f"`{known[name]}`")
    at = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    rows = files.select(
        column(case).alias("case_id"), column(activity).alias("activity"),
        *([_checked(column(order), "timestamp", order).alias("time")] if order else []),
        *[c.alias(f"at{i}") for i, c in enumerate(at)],
    )
    if case_type is None:
        number = F.col("case_id").try_cast("bigint")
        other = rows.where(F.col("case_id").isNotNull() & ~number.cast("string").eqNullSafe(F.col("case_id")))
        case_type = "bigint" if other.isEmpty() else "string"
    rows = rows.withColumn("case_id", _checked(F.col("case_id"), case_type, case))
    return event_log(rows, "case_id", "activity", [*(["time"] if order else []), "at0", "at1", "at2"])


def event_log(
    table: DataFrame,
    case: str | Column,
    activity: str | Column,
    order: Sequence[str | Column],
    missing_activity: str | None = MISSING_ACTIVITY,
) -> DataFrame:
    """``(case_id, activity, ord)`` view of a table.

    ``case_id`` keeps its native type because it orders the train/test split. Events
    without a case are dropped; events without an activity get ``missing_activity``,
    or are dropped when that is None. ``order`` must be total within a case.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    log = table.select(
        as_col(case).alias("case_id"),
        as_col(activity).cast("string").alias("activity"),
        F.struct(*[as_col(c).alias(f"k{i}") for i, c in enumerate(order)]).alias("ord"),
    ).where(F.col("case_id").isNotNull())
    if missing_activity is None:
        return log.where(F.col("activity").isNotNull())
    return log.withColumn("activity", F.coalesce("activity", F.lit(missing_activity)))
