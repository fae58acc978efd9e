"""Written tables that cut lineage and survive the loss of executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one partition of :func:`dealt`, about; so many of 60 labels' length take some 100 MB.
ROWS_OF_A_TASK = 200_000

_DIR = "spark.checkpoint.dir"
_written: dict[str, list[str]] = {}


def work_dir(spark: SparkSession) -> str:
    """Shared folder named by ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get(_DIR, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tracecast-")
    spark.conf.set(_DIR, folder)
    return folder


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written or made and collected inside go when its job ends, not when the driver next collects garbage.

    A frame made inside must not be run again outside.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The copy has a short lineage and file statistics, so Catalyst picks the join
    strategy by its real size.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    with passing_shuffles(spark):
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def dealt(df: DataFrame, rows: Column | int, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its size asks for, at least the session's number; ``rows`` counts for each row, and must be cheap to sum twice.

    A number that is given is kept, where adaptive execution merges partitions by their compressed size: a task that sorts holds
    them unpacked, which for sequences is a hundred times as much.
    """
    spark = df.sparkSession
    total = df.agg(F.sum(rows if isinstance(rows, Column) else F.lit(rows))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // ROWS_OF_A_TASK))
    return df.repartition(parts, *keys)


def never_broadcast(df: DataFrame) -> DataFrame:
    """A side of a join that holds sequences or states of every row: both sides are shuffled and merged.

    Catalyst takes a written table for as large as its files. Sequences of a few labels are a hundred times that in memory, and
    the driver would hold them all.
    """
    return df.hint("merge")


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path in the shared folder, remembered for :func:`release`."""
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def release(spark: SparkSession) -> None:
    """Deletes the tables this application has written here; results still built on them end."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written.pop(spark.sparkContext.applicationId, []):
        location = spark._jvm.org.apache.hadoop.fs.Path(path)
        location.getFileSystem(hadoop).delete(location, True)
