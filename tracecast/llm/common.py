"""Arrow batches of documents, cut so that the arrays made from them stay small."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes of the documents handled at once; a longer document is handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """The two columns the operators read, a null text as an empty one; further columns are left out."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def set_aside(docs: DataFrame, *used: str) -> DataFrame:
    """``docs`` with the columns not ``used`` named by their place, so that no name an operator gives can be theirs; ``toDF`` with the old names undoes it."""
    return docs.toDF(*(n if n in used else f"aside_{i}" for i, n in enumerate(docs.columns)))


def slices(batches: Iterator[pa.RecordBatch], limit: int = SLICE_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of the batches in which ``column`` holds about ``limit`` bytes."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            if end > start:
                yield batch.slice(start, end - start)


Batches = Iterator[pa.RecordBatch]


def released(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, after which the worker gives the memory it no longer uses back; workers serve many tasks, and allocators keep their largest size."""

    def task(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return task


def raw_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values in one array, and where each value starts (one more for the end); null is empty."""
    column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), starts - starts[0]
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def per_value(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of ``values`` between consecutive ``starts``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[starts[1:]] - total[starts[:-1]]


def batch_of(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


#: Odd multiplier of the polynomial hashes modulo 2**64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTERS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, size: int) -> np.ndarray:
    """``base**i`` for i up to ``size``, kept for the next call."""
    known = _powers.get(base)
    if known is None or len(known) <= size:
        steps = np.full(max(size, SLICE_BYTES) + 1, base, np.uint64)
        steps[0] = 1
        _powers[base] = known = np.cumprod(steps, dtype=np.uint64)
    return known


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the high bits of 64-bit hashes over all bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Wrapping polynomial sums of the bytes before each place; see :func:`span_hashes`."""
    terms = _LETTERS[data] * _power(_BASE, len(data))[: len(data)]
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)])


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span, which depends on its bytes alone."""
    return mixed((prefix[ends] - prefix[starts]) * _power(_INVERSE, len(prefix))[starts])


def hashed_words(data: np.ndarray, starts: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each maximal run of word bytes and the value it stands in; runs end with their value."""
    inside = np.concatenate([[False], is_word[data], [False]])
    opens = inside[1:-1] & ~inside[:-2]
    closes = inside[1:-1] & ~inside[2:]
    edges = starts[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    opens[edges] = inside[1:-1][edges]
    closes[edges - 1] = inside[1:-1][edges - 1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return span_hashes(prefix_hashes(data), begin, end), np.searchsorted(starts, begin, side="right") - 1
