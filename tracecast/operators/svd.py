"""Uncentred truncated SVD of the binary n-gram matrix, and projections of whole traces and of all their prefixes.

Randomised subspace iteration: a random basis, one row per n-gram, is multiplied by the matrix and its transpose a few
times and made orthonormal in between by the Cholesky factor of its Gram matrix. The basis stays a table; the driver sees
matrices of ``svd_components`` and a few more rows and columns. With as many components as n-grams the projection is a
rotation: products of projections are counts of common n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.operators.ngrams import first_lengths, vocabulary
from tracecast.settings import Settings
from tracecast.storage import materialize

#: Columns beyond the wanted ones, and multiplications by the matrix and its transpose.
_MORE = 8
_ROUNDS = 4
#: Numbers of running sums made at once, those of one trace at least.
_NUMBERS = 1 << 20


def _summed(rows: DataFrame, key: str | list[str], column: str = "axis") -> DataFrame:
    return rows.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector(column))).alias(column))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def gram_matrix(rows: DataFrame, size: int, column: str = "axis", weight: str | None = None) -> np.ndarray:
    """Sum of the outer products of all rows' vectors, ``weight`` times each: partial sums in the tasks, ``size`` times ``size`` numbers to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = _matrix(batch.column(0))
            y = batch.column(1).to_numpy(zero_copy_only=False)[:, None] * x if weight and len(x) else x
            total += x.T @ y if len(x) else 0
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(list(total))], ["place", "axis"])

    found = _summed(rows.select(column, *([weight] if weight else [])).mapInArrow(run, "place long, axis array<double>"), "place").collect()
    out = np.zeros((size, size))
    for r in found:
        out[r["place"]] = r["axis"]
    return (out + out.T) / 2


def _turned(rows: DataFrame, turn: np.ndarray) -> DataFrame:
    """The basis with each axis row multiplied by a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(_matrix(batch.column(1)) @ turn), pa.list_(pa.float64()))], ["gram", "axis"])

    return rows.select("gram", "axis").mapInArrow(run, "gram array<string>, axis array<double>")


def _orthonormal(basis: DataFrame, size: int) -> tuple[DataFrame, int]:
    """The same span with orthonormal columns; columns that depend on the others go."""
    values, vectors = np.linalg.eigh(gram_matrix(basis, size))
    kept = values > max(values.max(), 0) * 1e-12
    return materialize(_turned(basis, vectors[:, kept] / np.sqrt(values[kept])), "basis"), int(kept.sum())


def svd_basis(features: DataFrame, key: str = "case_id", settings: Settings = Settings(), weight: str | None = None) -> DataFrame:
    """``(gram, axis)``: right singular vectors by falling singular value, as many as ``svd_components`` or as the n-grams allow.

    ``weight`` names a column of ``features`` that says for how many equal rows of the matrix a key stands.
    """
    grams = materialize(vocabulary(features, settings, weight).select("gram"), "vocabulary")
    stands = [F.col(weight).cast("double").alias("weight")] if weight else []
    held = materialize(features.join(grams, "gram", "left_semi").select(key, "gram", *stands), "held-grams")
    weighted = F.transform("axis", lambda x: x * F.col("weight")) if weight else F.col("axis")
    ids = [key, "weight"] if weight else [key]
    n = grams.count()
    size = min(n, settings.svd_components + _MORE)
    if not n:
        return grams.withColumn("axis", F.array().cast("array<double>"))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda j: F.xxhash64("gram", F.lit(settings.seed), j) / F.lit(2.0**63))
    basis, size = _orthonormal(materialize(grams.select("gram", drawn.alias("axis")), "basis"), size)
    for _ in range(0 if size == n else _ROUNDS):
        rows = _summed(held.join(basis, "gram"), ids)
        basis, size = _orthonormal(materialize(_summed(held.join(rows.withColumn("axis", weighted), ids), "gram"), "basis"), size)
    values, vectors = np.linalg.eigh(gram_matrix(_summed(held.join(basis, "gram"), ids), size, weight="weight" if weight else None))
    turn = vectors[:, np.argsort(-values)][:, : settings.svd_components]
    return materialize(_turned(basis, turn), "basis")


def svd_features(features: DataFrame, basis: DataFrame, key: str = "case_id") -> DataFrame:
    """``(key, projection)``: sum of the axes of the n-grams a row holds."""
    return _summed(features.join(basis, "gram"), key).withColumnRenamed("axis", "projection")


def prefix_projections(sequences: DataFrame, basis: DataFrame, key: str = "case_id", settings: Settings = Settings()) -> DataFrame:
    """``(key, length, projection)`` of the prefixes of 2 events up to the whole of each of ``(key, acts)``.

    A prefix has the projection of the one before and the axes of the n-grams that its last event completes, so the
    sums run along a trace; n-grams that the basis does not know count nothing.
    """
    size = (basis.agg(F.max(F.size("axis")).alias("n")).first()["n"]) or 0
    kind = dict(sequences.dtypes)[key]
    known = first_lengths(sequences, key, settings).join(basis, "gram")
    steps = known.groupBy(key).agg(F.collect_list(F.struct(F.col("first_len").cast("int").alias("at"), "axis")).alias("steps"))  # of one trace

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The running sums of some traces, whose events are stacked."""
        n = batch.column("n").to_numpy(zero_copy_only=False)
        steps = batch.column("steps")
        held = np.nan_to_num(steps.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        added = np.zeros((int(n.sum()), size))
        step = steps.flatten()
        if len(step):
            np.add.at(added, np.repeat(starts, held) + step.field("at").to_numpy() - 1, _matrix(step.field("axis")))
        for i in range(len(n)):
            np.cumsum(added[starts[i] : ends[i]], axis=0, out=added[starts[i] : ends[i]])
        row = np.repeat(np.arange(len(n)), n)
        length = np.arange(1, len(row) + 1) - starts[row]
        wanted = length >= 2
        found = added[wanted]
        projections = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * size, found.ravel())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[wanted])), pa.array(length[wanted].astype(np.int32)), projections], [key, "length", "projection"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            events = np.cumsum(batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64) * max(size, 1)) // _NUMBERS
            cuts = [0, *(np.flatnonzero(events[1:] != events[:-1]) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if end > start:
                    yield part(batch.slice(start, end - start))

    rows = sequences.select(key, F.size("acts").alias("n")).join(steps, key, "left")
    return rows.mapInArrow(run, f"{key} {kind}, length int, projection array<double>")
