"""Product codes of vectors: Hilbert-sorted flat blocks, entry shortlists by box distances, exact integer kernels.

Components become integers, ``floor(scale * x)``, and vectors are cut into equal consecutive parts with a codebook
each. Vectors are dealt by the Hilbert index of a few coarse coordinates into chunks; in a chunk the parts of each
position are sorted by their own Hilbert index and cut into flat blocks that store the smallest and largest
component (the box) and the component sums. The chunks are written once. In a round, the least and the greatest
distance of every entry to a block's box are found; an entry farther at its nearest than another one is at its
farthest cannot be the nearest of any part in the block. If one entry is left, the block's sums are added whole;
otherwise the parts are compared with the entries on the shortlist alone, in integer arithmetic that is exact (in
doubles while all sums stay below 2**53, in 64-bit integers below 2**62, in Python's integers beyond). Only entry
sums and counts leave the tasks: the state of a round is the codebook, whose size is a parameter.

Rows whose vector is null or holds null or non-finite components are left out. Shorter vectors are padded with
zeros to the longest length, rounded up to a multiple of the number of parts; components are held within
``+-2**52`` after scaling. Repeated ids are vectors of their own; among equal ids the smaller vector comes first,
null ids come last. With fewer rows than entries a codebook is that much shorter; an empty table gives no rows.
Errors beyond 64 bits are given as the largest long. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.storage import materialize

_MOST = 1 << 52
_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class CodeSettings:
    parts: int = 4
    entries: int = 256
    rounds: int = 4
    scale: int = 1024
    #: Parts in a block.
    block_rows: int = 64
    #: Bytes of components in a chunk, the unit that is written and read.
    chunk_bytes: int = 2 << 20


def hilbert_index(points: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int = 63) -> np.ndarray:
    """Place on the Hilbert curve over the box ``low`` to ``high``, with ``bits`` bits for all axes together (the first 63 at most)."""
    n, axes = points.shape
    axes = min(axes, bits)
    if not axes or not n:
        return np.zeros(n, np.int64)
    each = max(1, bits // axes)
    low, high = low[:axes].astype(float), high[:axes].astype(float)
    share = (points[:, :axes] - low) / np.maximum(high - low, 1)
    x = np.minimum((share * (1 << each)).astype(np.int64), (1 << each) - 1).T.copy()
    for level in range(each - 1, 0, -1):  # undo the turns of the curve, axis by axis
        bit, below = 1 << level, (1 << level) - 1
        for i in range(axes):
            turned = (x[i] & bit) != 0
            x[0][turned] ^= below
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= swap
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    last = np.zeros(n, np.int64)
    for level in range(each - 1, 0, -1):
        last ^= np.where(x[-1] & (1 << level), (1 << level) - 1, 0)
    x ^= last
    index = np.zeros(n, np.int64)
    for level in range(each - 1, -1, -1):
        for i in range(axes):
            index = (index << 1) | ((x[i] >> level) & 1)
    return index


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of equal length from a list column, padded with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def squared_distances(points: np.ndarray, entries: np.ndarray, most: int) -> np.ndarray:
    """Exact squared distance of each point to each entry; no component is beyond ``most`` in size."""
    width = points.shape[1]
    if width * (2 * most) ** 2 < 1 << 53:
        p, e = points.astype(float), entries.astype(float)
        return (p * p).sum(1)[:, None] - 2 * (p @ e.T) + (e * e).sum(1)
    kind = np.int64 if width * (2 * most) ** 2 < 1 << 62 else object
    p, e = points.astype(kind), entries.astype(kind)
    return np.stack([((p - row) ** 2).sum(1) for row in e], 1) if width else np.zeros((len(p), len(e)), np.int64)


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray, most: int) -> np.ndarray:
    """Whether an entry can be the nearest of a part in a block, for each block and entry; of equal entries the first only."""
    first = np.zeros(len(entries), bool)
    first[np.unique(entries, axis=0, return_index=True)[1] if entries.shape[1] else 0] = True
    width = entries.shape[1]
    kind = float if width * (2 * most) ** 2 < 1 << 53 else np.int64 if width * (2 * most) ** 2 < 1 << 62 else object
    near, far = [], []
    for a, b in zip(low.astype(kind), high.astype(kind)):
        below, above = a - entries.astype(kind), entries.astype(kind) - b
        near.append((np.maximum(np.maximum(below, above), 0) ** 2).sum(1))
        far.append((np.maximum(-below, -above) ** 2).sum(1))
    near, far = np.array(near).reshape(len(low), -1), np.array(far).reshape(len(low), -1)
    return first & (near <= far.min(1, keepdims=True))


CHUNK = "points binary, places binary, low binary, high binary, sums binary"


def _chunks(parts: int, width: int, settings: CodeSettings):
    """Chunks of one part's blocks after the other: points in block order, their rows in the chunk, boxes and sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = max(settings.block_rows, settings.chunk_bytes // (8 * max(1, parts * width)))
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= rows:
                table = pa.Table.from_batches(held).combine_chunks()
                yield chunk(table.slice(0, rows))
                held = table.slice(rows).to_batches()
        if sum(b.num_rows for b in held):
            yield chunk(pa.Table.from_batches(held).combine_chunks())

    def chunk(table: pa.Table) -> pa.RecordBatch:
        vectors = _matrix(table.column("q").combine_chunks(), parts * width)
        points, places, low, high, sums = [], [], [], [], []
        for part in range(parts):
            own = vectors[:, part * width : (part + 1) * width]
            order = np.argsort(hilbert_index(own, own.min(0), own.max(0)) if width else np.zeros(len(own)), kind="stable")
            own, cuts = own[order], np.arange(0, len(own), settings.block_rows)
            points.append(own)
            places.append(order.astype(np.int32))
            for kept, fold in ((low, np.minimum), (high, np.maximum), (sums, np.add)):
                kept.append(fold.reduceat(own, cuts, axis=0) if width else np.zeros((len(cuts), 0), np.int64))
        packed = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (points, places, low, high, sums)]
        whole = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(n).combine_chunks()) for n in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*whole, *packed], ["ids", "labels", "points", "places", "low", "high", "sums"])

    return run


def _assigned(row: dict, codebooks: np.ndarray, most: int, block_rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each part: rows, points, their nearest entries and squared distances; entries and sums of the blocks that need no comparison."""
    parts, _, width = codebooks.shape
    places = np.frombuffer(row["places"], np.int32).reshape(parts, -1)
    n = places.shape[1]
    cuts = np.arange(0, n, block_rows)
    points = np.frombuffer(row["points"], np.int64).reshape(parts, n, width)
    low, high, sums = (np.frombuffer(row[k], np.int64).reshape(parts, len(cuts), width) for k in ("low", "high", "sums"))
    for part in range(parts):
        entries = codebooks[part]
        nearest = np.zeros(n, np.int64)
        short = shortlists(low[part], high[part], entries, most)
        lone = short.sum(1) == 1
        for block in np.flatnonzero(~lone):
            here, listed = slice(cuts[block], cuts[block] + block_rows), np.flatnonzero(short[block])
            nearest[here] = listed[squared_distances(points[part, here], entries[listed], most).argmin(1)]
        only = short.argmax(1)
        whole = np.repeat(lone, block_rows)[:n]
        nearest[whole] = np.repeat(only, block_rows)[:n][whole]
        yield part, places[part], points[part], nearest, np.where(lone, only, -1), sums[part]


def _round(codebooks: np.ndarray, most: int, block_rows: int):
    """Component sums (``at`` from 0) and counts (``at`` the width) of the parts nearest to each entry, once per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, width = codebooks.shape
        totals = np.zeros((parts, size, width + 1), object)
        for batch in batches:
            for row in batch.to_pylist():
                for part, _, points, nearest, only, sums in _assigned(row, codebooks, most, block_rows):
                    totals[part, :, width] += np.bincount(nearest, minlength=size)
                    lone = only >= 0
                    single = ~np.repeat(lone, block_rows)[: len(points)]
                    for at, to in ((points[single], nearest[single]), (sums[lone], only[lone])):
                        order = np.argsort(to, kind="stable")
                        used, starts = np.unique(to[order], return_index=True)
                        if len(used) and width:
                            totals[part, used, :width] += np.add.reduceat(at[order], starts, axis=0)
        found = np.argwhere(totals != 0)
        values = pa.array([Decimal(int(totals[tuple(k)])) for k in found], pa.decimal128(38, 0))
        columns = [pa.array(found[:, i].astype(np.int32)) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, values], ["part", "entry", "at", "total"])

    return run


def _coded(codebooks: np.ndarray, most: int, block_rows: int):
    digits = max(2, len(f"{codebooks.shape[1] - 1:x}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.to_pylist()):
                ids, labels = (batch.column(n).slice(i, 1).flatten() for n in ("ids", "labels"))
                codes = np.zeros((len(ids), len(codebooks)), np.int64)
                errors = np.zeros(len(ids), object)
                for part, places, points, nearest, _, _ in _assigned(row, codebooks, most, block_rows):
                    codes[places, part] = nearest
                    wide = points.shape[1] * (2 * most) ** 2 >= 1 << 62
                    gaps = points.astype(object if wide else np.int64) - codebooks[part][nearest]
                    errors[places] += (gaps * gaps).sum(1) if points.shape[1] else 0
                text = ["".join(f"{c:0{digits}x}" for c in code) for code in codes.tolist()]
                error = pa.array([min(int(e), _LONG) for e in errors], pa.int64())
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array(text, pa.string()), error], ["vec_id", "label", "code", "error"])

    return run


def integer_components(vector: Column, scale: int) -> Column:
    """Components as integers, rounded down; null where the vector holds null or non-finite ones."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    held = lambda x: F.least(F.greatest(F.floor(x.cast("double") * F.lit(float(scale))).cast("long"), F.lit(-_MOST)), F.lit(_MOST))
    return F.when(usable, F.transform(vector, held))


@dataclass(frozen=True)
class Codebooks:
    #: ``parts x entries x width`` integers.
    entries: np.ndarray
    #: No component is beyond this size.
    most: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _key(parts: int, width: int, low: int, high: int):
    """Hilbert index of the sums of eight consecutive stretches of the vector."""
    axes = min(8, parts * width)
    cuts = np.linspace(0, parts * width, axes + 1).astype(int)[:-1]
    count = np.diff(np.append(cuts, parts * width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("q"), parts * width)
            coarse = np.add.reduceat(vectors.astype(float), cuts, axis=1) if axes else np.zeros((len(vectors), 0))
            yield batch.append_column("place", pa.array(hilbert_index(coarse, low * count, high * count, 56)))

    return run


def fit(vectors: DataFrame, settings: CodeSettings = CodeSettings(), vector: str = "embedding") -> tuple[Codebooks, DataFrame]:
    """Codebooks after all rounds, and the chunks of all usable rows of ``vectors(vec_id, <vector>, label)``."""
    kept = vectors.select("vec_id", "label", integer_components(F.col(vector), settings.scale).alias("q")).where("q is not null")
    found = kept.agg(F.max(F.size("q")).alias("size"), F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high")).first()
    low, high = found["low"] or 0, found["high"] or 0
    width, most = -(-(found["size"] or 0) // settings.parts), max(abs(low), abs(high), 1)
    seeds = kept.orderBy(F.col("vec_id").asc_nulls_last(), "q").limit(settings.entries).select("q").toArrow().column("q").combine_chunks()
    books = _matrix(seeds, settings.parts * width).reshape(len(seeds), settings.parts, width).transpose(1, 0, 2).copy()
    types = dict(kept.dtypes)
    placed = kept.mapInArrow(_key(settings.parts, width, min(low, 0), max(high, 0)), f"vec_id {types['vec_id']}, label {types['label']}, q array<long>, place long")
    dealt = placed.repartitionByRange("place", "vec_id")
    chunks = materialize(dealt.mapInArrow(_chunks(settings.parts, width, settings), f"ids array<{types['vec_id']}>, labels array<{types['label']}>, {CHUNK}"), "chunks")
    for _ in range(settings.rounds if len(seeds) else 0):
        totals = chunks.select("points", "places", "low", "high", "sums").mapInArrow(_round(books, most, settings.block_rows), "part int, entry int, at int, total decimal(38,0)")
        sums = np.zeros((settings.parts, len(seeds), width + 1), object)
        for part, entry, at, total in totals.groupBy("part", "entry", "at").agg(F.sum("total").alias("total")).collect():
            sums[part, entry, at] = int(total)
        used = sums[:, :, width] > 0
        books[used] = (sums[used][:, :width] // sums[used][:, width:]).astype(np.int64)
    return Codebooks(books, most), chunks


def encode(vectors: DataFrame, settings: CodeSettings = CodeSettings(), vector: str = "embedding") -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of every usable row; ``label_error`` sums over equal labels, nulls together."""
    model, chunks = fit(vectors, settings, vector)
    types = dict(vectors.select("vec_id", "label").dtypes)
    coded = chunks.mapInArrow(_coded(model.entries, model.most, settings.block_rows), f"vec_id {types['vec_id']}, label {types['label']}, code string, error long")
    coded = materialize(coded, "codes")
    whole = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(_LONG).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy(F.col("label").alias("of_label")).agg(whole.alias("label_error")), "label-errors")
    return coded.join(sums, F.col("label").eqNullSafe(F.col("of_label"))).drop("of_label").withColumn("codebooks_sha256", F.lit(model.sha256()))
