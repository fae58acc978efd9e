"""Exact repeats of a least length, by an enhanced suffix array over content-chosen places.

Anchors are the places whose hash of the next ``core`` bytes is the smallest in some window; they depend
on content alone, so two equal strings of ``least`` bytes have an anchor at the same place. The sorted
suffixes at equal anchors, with the lengths of their common prefixes, are scanned with a stack into the
tree of common-prefix intervals. In an interval the occurrences are ordered by what stands to their left and
scanned likewise: a run with ``least`` common bytes in all is a maximal repeat group if it can be extended neither
to the left (its left neighbours differ) nor to the right (it spans two children of the interval). All its
occurrences are returned, not neighbours only. Groups are named by their bytes.

All that a string of ``least`` bytes around an anchor can contain is the anchor's surroundings. Anchors with equal
surroundings are one from then on: these places are repeats as a whole. An anchor with more distinct
surroundings than ``bucket_rows`` is not scanned in one task; its strings are split by where they begin, which makes
their common core longer, until the buckets are small or their rows equal.

Texts are UTF-8 bytes, null is empty; texts shorter than ``least`` repeat nothing. Rows with equal texts repeat each
other; so do the rows of one ``doc_id``, which are told apart by their texts. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import SLICE_BYTES, id_and_text, mixed, prefix_hashes, raw_bytes, released, slices, span_hashes
from tracecast.llm.groups import whole_groups
from tracecast.storage import materialize


@dataclass(frozen=True)
class RepeatSettings:
    least: int = 200
    core: int = 64
    #: Distinct surroundings scanned in one suffix array.
    bucket_rows: int = 8_192
    #: Bytes of a text hashed at once; longer ones are taken in overlapping parts.
    part_bytes: int = 1 << 20

    @property
    def window(self) -> int:
        """Places of which one at least is an anchor."""
        return self.least - self.core + 1


def _sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """Minimum or maximum of each ``width`` consecutive values, from running ones to both sides of block bounds."""
    n = len(values) - width + 1
    pad = -len(values) % width
    blocks = np.concatenate([values, np.repeat(values[-1:], pad)]).reshape(-1, width)
    ahead = choose.accumulate(blocks, axis=1).ravel()
    back = choose.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return choose(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, starts: np.ndarray, settings: RepeatSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places of the anchors in ``data``, the value each is in, the hashes of the core and of the surroundings."""
    least, core, window = settings.least, settings.core, settings.window
    if len(data) < least:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    prefix = prefix_hashes(data)
    place = np.arange(len(data) - core + 1)
    h = span_hashes(prefix, place, place + core)
    lowest = _sliding(h, window, np.minimum)  # of the string of `least` bytes at each place
    end = np.repeat(starts[1:], np.diff(starts))
    lowest[end[: len(lowest)] < np.arange(len(lowest)) + least] = 0  # such a string would leave its text
    edge = np.zeros(window - 1, np.uint64)
    chosen = np.flatnonzero((h == _sliding(np.concatenate([edge, lowest, edge]), window, np.maximum)[: len(h)]) & (h > 0))
    owner = np.searchsorted(starts, chosen, side="right") - 1
    left = np.minimum(window - 1, chosen - starts[owner])
    around = span_hashes(prefix, chosen - left, np.minimum(chosen + least, starts[owner + 1]))
    return chosen, owner, h[chosen], mixed(around ^ (left.astype(np.uint64) << np.uint64(20)))


def _name(text: bytes) -> tuple[int, int]:
    digest = hashlib.blake2b(text, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _parts(column: pa.Array, settings: RepeatSettings) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Bytes, starts, the value of each part and its place there, whether the values end here: long ones in parts that overlap by all an anchor sees."""
    data, starts = raw_bytes(column)
    if len(data) <= 2 * settings.part_bytes:
        yield data, starts, np.arange(len(column)), np.zeros(len(column), np.int64), True
        return
    overlap = settings.least + settings.window
    for i in range(len(column)):
        for at in range(0, max(1, int(starts[i + 1] - starts[i]) - 2 * overlap), settings.part_bytes):
            end = min(starts[i + 1], starts[i] + at + settings.part_bytes + 2 * overlap)
            own = data[starts[i] + at : end]
            yield own, np.array([0, len(own)]), np.array([i]), np.array([at]), bool(end == starts[i + 1])


ANCHORS = "text_a long, text_b long, place int, core long, around long"


def _thinned(place: np.ndarray, owner: np.ndarray, around: np.ndarray, step: int) -> np.ndarray:
    """Anchors that are needed: of a stretch with equal surroundings the first, the last, and one in each ``step`` bytes.

    The strings around those left cover the same bytes, and what they can be equal to is the same.
    """
    same = np.zeros(len(place) + 1, bool)
    same[1:-1] = (around[1:] == around[:-1]) & (owner[1:] == owner[:-1])
    near = np.zeros(len(place), bool)
    near[1:] = place[1:] // step == place[:-1] // step
    return ~(same[:-1] & same[1:] & near)


def _named_bytes(part: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Names and bytes of the texts of a batch, packed or plain."""
    if "packed" not in part.schema.names:
        return np.array([_name((t or "").encode()) for t in part.column("text").to_pylist()], np.int64).reshape(-1, 2), part.column("text")
    expand = zstandard.ZstdDecompressor().decompress
    names = np.stack([part.column(n).to_numpy() for n in ("text_a", "text_b")], 1)
    return names, pa.array([expand(p) for p in part.column("packed").to_pylist()], pa.binary())


def _anchored(settings: RepeatSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _small(batches, SLICE_BYTES // 4):
            names, texts = _named_bytes(part)
            for data, starts, value, at, last in _parts(texts, settings):
                chosen, owner, core, around = anchors(data, starts, settings)
                place = chosen - starts[owner] + at[owner]
                owner = value[owner]
                seen = np.ones(len(place), bool)
                if not last:  # an anchor near the end of a part is seen whole in the next one
                    seen &= place - at[0] + 2 * settings.least <= settings.part_bytes + 2 * (settings.least + settings.window)
                if len(value) == 1 and at[0]:
                    seen &= place - at[0] >= settings.window - 1
                place, owner, core, around = (x[seen] for x in (place, owner, core, around))
                if len(place):
                    needed = _thinned(place, owner, around, settings.least // 2)
                    place, owner, core, around = (x[needed] for x in (place, owner, core, around))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (names[owner, 0], names[owner, 1], place.astype(np.int32), core.view(np.int64), around.view(np.int64))],
                    ["text_a", "text_b", "place", "core", "around"],
                )

    return released(run)


def _small(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with about ``limit`` bytes of text, unpacked."""
    for batch in batches:
        if "packed" not in batch.schema.names:
            yield from slices([batch], limit)
            continue
        size = batch.column("n_bytes").to_numpy()
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // limit)) + 1
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for start, end in zip(bounds, bounds[1:]):
            if end > start:
                yield batch.slice(start, end - start)


PACKED = "text_a long, text_b long, n_bytes long, sha256 string, packed binary"


@released
def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by name, compressed for the shuffle."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for part in slices(batches):
        texts = [(t or "").encode() for t in part.column("text").to_pylist()]
        names = np.array([_name(t) for t in texts], np.int64).reshape(-1, 2)
        sizes, digests = pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())
        yield pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(names[:, 0]), pa.array(names[:, 1]), sizes, digests, pa.array([squeeze(t) for t in texts], pa.binary())],
            ["doc_id", "text_a", "text_b", "n_bytes", "sha256", "packed"],
        )


def packed_texts(docs: DataFrame) -> DataFrame:
    """Each row's text with its name, size and hash, compressed."""
    return id_and_text(docs).mapInArrow(_packed_texts, f"doc_id long, {PACKED}")


def named_texts(docs: DataFrame) -> DataFrame:
    """Each distinct text (of documents or of :func:`packed_texts`) with the smallest ``doc_id`` that has it and the number of rows that do."""
    texts = docs if "packed" in docs.columns else packed_texts(docs)
    return texts.groupBy("text_a", "text_b").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))


#: A row of the suffix array: where strings begin is counted from the anchor, ``low`` to ``high``.
SUFFIXES = "bucket long, low int, high int, text_a long, text_b long, place int, done boolean, left binary, right binary"


def _surroundings(settings: RepeatSettings, most: int = 8_192):
    """Bytes to the left of each wanted anchor, and from it on."""
    names = ("bucket", "low", "high", "text_a", "text_b", "place", "done", "left", "right")
    types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        rows: list[tuple] = []

        def batch_of_rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], list(names))
            rows.clear()
            return out

        for batch in batches:
            for i in range(batch.num_rows):
                a, b, packed, wanted = (batch.column(n)[i].as_py() for n in ("text_a", "text_b", "packed", "wanted"))
                text = expand(packed)
                for w in wanted:
                    at = w["place"]
                    rows.append((w["core"], 1 - settings.window, 0, a, b, at, w["done"], text[max(0, at - settings.window + 1) : at], text[at : at + settings.least]))
                    if len(rows) >= most:
                        yield batch_of_rows()
        if rows:
            yield batch_of_rows()

    return released(run)


def _narrowed(settings: RepeatSettings):
    """Each row as two, with half of the places where its strings begin: bucket and surroundings anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bucket, low, high, a, b, place, done, left, right in zip(*(batch.column(n).to_pylist() for n in batch.schema.names[:9])):
                for first, last in ((low, (low + high) // 2), ((low + high) // 2 + 1, high)):
                    # strings that the text's bounds allow, and what they can contain
                    if first > last or -len(left) > last or first + settings.least > len(right):
                        continue
                    text, at = left + right, len(left)
                    core = text[max(0, at + last) : at + first + settings.least]
                    own_left, own_right = left[max(0, at + first) :], right[: max(0, last + settings.least)]
                    key = _name(b"%d,%d,%d:" % (bucket, first, last) + core)[0]
                    around = _name(b"%d:" % len(own_left) + own_left + own_right)[0]
                    rows.append((key, first, last, a, b, place, done, own_left, own_right, around))
            if rows:
                types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], [*batch.schema.names[:9], "around"])

    return released(run)


def _common(rows: list[bytes]) -> np.ndarray:
    """Length of the common prefix of each row with the one before it (0 for the first)."""
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or not width:
        return np.zeros(len(rows), np.int64)
    table = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in rows), np.uint8).reshape(len(rows), width)
    length = np.array([len(r) for r in rows])
    same = table[1:] == table[:-1]
    agree = np.where(same.all(1), width, same.argmin(1))
    return np.concatenate([[0], np.minimum(agree, np.minimum(length[1:], length[:-1]))])


def _intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals ``(length, first, last)`` of two rows or more, inner ones first, by a stack scan."""
    stack: list[tuple[int, int]] = []
    for i, length in enumerate([*common[1:].tolist(), -1], 1):
        first = i - 1
        while stack and stack[-1][0] > length:
            deep, first = stack.pop()
            yield deep, first, i - 1
        if not stack or stack[-1][0] < length:
            stack.append((length, first))


def maximal_repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Bytes to the left of the anchor, bytes from it on, and all rows, of each maximal repeat group of one bucket."""
    order = sorted(range(len(right)), key=lambda i: right[i])
    common = _common([right[i] for i in order])
    back = [left[i][::-1] for i in order]
    for deep, first, last in _intervals(common):
        if not deep:
            continue
        inside = common[first : last + 1]
        by_left = sorted(range(first, last + 1), key=lambda i: back[i])
        shared = _common([back[i] for i in by_left])
        for extent, low, high in _intervals(shared):
            if extent + deep < least:
                continue
            rows = by_left[low : high + 1]
            if inside[min(rows) - first + 1 : max(rows) - first + 1].min() == deep:  # not in one child: no longer to the right
                yield extent, deep, [order[i] for i in rows]


class _LeastBetween:
    """Minimum of any stretch of an array, by a table of dyadic stretches."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while len(self.rows[-1]) > 1 << (len(self.rows) - 1):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of ``start`` to ``end``, the end exclusive; no stretch is empty."""
        level = np.frexp((end - start).astype(float))[1] - 1
        out = np.zeros(len(start), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.rows[k][start[at]], self.rows[k][end[at] - (1 << int(k))])
        return out


def _reach(left: list[bytes], right: list[bytes], bucket: np.ndarray, least: int, most: int = 1 << 20) -> np.ndarray:
    """How far each row is in a maximal repeat group, to the left of its anchor and from it on (0, 0: in none).

    The common-prefix intervals of all buckets come from one stack scan. In each interval the rows stand in the order of
    their left contexts; the longest context a row shares there is that with one of its neighbours, and the row is in a
    group if it is long enough together with the interval's prefix. The intervals are taken many at a time.
    """
    n = len(right)
    numbers = bucket.tolist()
    order = np.array(sorted(range(n), key=lambda i: (numbers[i], right[i])), np.int64)
    common = _common([right[i] for i in order.tolist()])
    common[1:][bucket[order][1:] != bucket[order][:-1]] = 0
    back = [x[::-1] for x in left]
    by_left = np.array(sorted(range(n), key=lambda i: (numbers[i], back[i])), np.int64)
    shared = _common([back[i] for i in by_left.tolist()])
    shared[1:][bucket[by_left][1:] != bucket[by_left][:-1]] = 0
    rank = np.empty(n, np.int64)
    rank[by_left] = np.arange(n)
    rank = rank[order]  # by the order of the suffix array
    between = _LeastBetween(shared)
    reach = np.zeros((2, n), np.int64)
    found = [x for x in _intervals(common) if x[0]]
    deep, first, last = np.array(found, np.int64).reshape(-1, 3).T
    size = last - first + 1
    chunk = (np.cumsum(size) - size) // most
    for part in np.split(np.arange(len(deep)), np.flatnonzero(np.diff(chunk)) + 1) if len(deep) else ():
        of = np.repeat(np.arange(len(part)), size[part])
        row = np.arange(len(of)) - np.repeat(np.cumsum(size[part]) - size[part], size[part]) + first[part][of]
        ordered = np.argsort(of * n + rank[row], kind="stable")
        of, row = of[ordered], row[ordered]
        beside = np.flatnonzero(of[1:] == of[:-1])
        best = np.zeros(len(of), np.int64)
        length = between(rank[row[beside]] + 1, rank[row[beside + 1]] + 1)
        best[beside] = length
        best[beside + 1] = np.maximum(best[beside + 1], length)
        met = best + deep[part][of] >= least
        np.maximum.at(reach[0], order[row[met]], best[met])
        np.maximum.at(reach[1], order[row[met]], deep[part][of[met]])
    return reach


def _distinct(bucket: np.ndarray, occurrence: list[tuple]) -> list[int]:
    """Rows without those given twice."""
    seen: set[tuple] = set()
    return [i for i, o in enumerate(zip(bucket.tolist(), occurrence)) if not (o in seen or seen.add(o))]


SPANS = "text_a long, text_b long, start int, end int"
FOUND = SPANS + ", group_a long, group_b long"
_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())


def _batch(rows: list[tuple], names: str) -> pa.RecordBatch:
    columns = [c.split()[0] for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), _TYPES)], columns)


def _scanned(settings: RepeatSettings, named: bool, most: int = 50_000):
    """Occurrences of the maximal repeat groups of each bucket; unless they are ``named``, one span per suffix for all its groups.

    The spans of a suffix all hold its core, so that together they are one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["bucket", "low", "high"]):
            left, right, place, a, b = (rows.column(n).to_pylist() for n in ("left", "right", "place", "text_a", "text_b"))
            bucket = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            kept = _distinct(bucket, list(zip(a, b, place)))
            left, right, place, a, b = ([values[i] for i in kept] for values in (left, right, place, a, b))
            bucket, out = bucket[kept], []
            if not named:
                reach = _reach(left, right, bucket, settings.least)
                out = [(a[j], b[j], place[j] - int(reach[0][j]), place[j] + int(reach[1][j])) for j in np.flatnonzero(reach[1]).tolist()]
                if out:
                    yield _batch(out, SPANS)
                continue
            bounds = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(kept)]
            for start, end in zip(bounds, bounds[1:]):
                for extent, deep, found in maximal_repeats(left[start:end], right[start:end], settings.least):
                    at = start + np.array(found)
                    group = _name(left[at[0]][len(left[at[0]]) - extent :] + right[at[0]][:deep])
                    out += [(a[j], b[j], place[j] - extent, place[j] + deep, *group) for j in at.tolist()]
                    if len(out) >= most:
                        yield _batch(out, FOUND)
                        out = []
            if out:
                yield _batch(out, FOUND)

    return released(run)


def _whole(rows: DataFrame, settings: RepeatSettings, named: bool) -> DataFrame:
    """Rows whose surroundings occur elsewhere: spans that may go beyond the text, named by bucket and surroundings."""
    start, end = F.col("place") + F.col("low"), F.col("place") + F.col("high") + settings.least
    names = [F.col("bucket").alias("group_a"), F.col("around").alias("group_b")] if named else []
    return rows.select("text_a", "text_b", start.cast("int").alias("start"), end.cast("int").alias("end"), *names)


def _occurrence() -> F.Column:
    return F.struct("text_a", "text_b", "place")


def repeats(docs: DataFrame, names: DataFrame, settings: RepeatSettings = RepeatSettings(), named: bool = False) -> DataFrame:
    """Spans ``start`` to ``end`` (bytes) of the texts ``text_a, text_b`` (see :func:`packed_texts`) that occur elsewhere, too.

    ``names`` is :func:`named_texts` of ``docs``. With ``named``, one row per occurrence and group ``group_a, group_b``. ``end`` may be beyond the text's end, ``start`` before it.
    """
    texts = docs if "packed" in docs.columns else packed_texts(docs)
    found = materialize(texts.select("text_a", "text_b", "n_bytes", "packed").mapInArrow(_anchored(settings), ANCHORS), "places")
    shared = found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    met = materialize(found.join(shared, "core"), "anchors")

    places = met.groupBy("core", "around").agg(F.min(_occurrence()).alias("first"), F.max(_occurrence()).alias("last"))
    places = materialize(places, "surroundings")
    whole = met.join(places.where("first <> last").select("core", "around"), ["core", "around"])
    spans = [_whole(whole.withColumnRenamed("core", "bucket").withColumn("low", F.lit(1 - settings.window)).withColumn("high", F.lit(0)), settings, named)]

    several = places.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    wanted = (
        places.join(several, "core").select("core", "first.*", (F.col("first") != F.col("last")).alias("done"))
        .groupBy("text_a", "text_b").agg(F.collect_list(F.struct("core", "place", "done")).alias("wanted"))  # of one text
    )
    wanted = wanted.join(names.select("text_a", "text_b", "first_id"), ["text_a", "text_b"])
    texts = texts.alias("t").join(wanted.alias("w"), [
        F.col("t.text_a") == F.col("w.text_a"), F.col("t.text_b") == F.col("w.text_b"), F.col("t.doc_id").eqNullSafe(F.col("w.first_id")),
    ])
    rows = materialize(texts.select("t.text_a", "t.text_b", "packed", "wanted").mapInArrow(_surroundings(settings), SUFFIXES), "suffixes")
    while True:
        sizes = rows.groupBy("bucket", "low", "high").agg(F.count("*").alias("n"))
        large = materialize(sizes.where(F.col("n") > settings.bucket_rows).select("bucket", "low", "high"), "large-buckets")
        key = ["bucket", "low", "high"]
        small = rows.join(large, key, "left_anti")
        # by a hash of the key: a shuffle by the key itself could be left out after the join, whose partitions may be split
        spans.append(small.repartition(F.xxhash64(*key)).sortWithinPartitions(*key).mapInArrow(_scanned(settings, named), FOUND if named else SPANS))
        if large.isEmpty():
            break
        halves = materialize(rows.join(large, key).select(*rows.columns).mapInArrow(_narrowed(settings), f"{SUFFIXES}, around long"), "halves")
        places = halves.groupBy(*key, "around").agg(F.min(_occurrence()).alias("first"), F.max(_occurrence()).alias("last"), F.max("done").alias("some_done"))
        places = materialize(places, "surroundings")
        spans.append(_whole(halves.join(places.where("first <> last").select(*key, "around"), [*key, "around"]).where("not done"), settings, named))
        ahead = places.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key)
        kept = places.join(ahead, key).select(*key, "around", "first.*", (F.col("some_done") | (F.col("first") != F.col("last"))).alias("one_done"))
        rows = materialize(
            halves.join(kept, [*key, "around", "text_a", "text_b", "place"]).withColumn("done", F.col("one_done")).select(*rows.columns), "suffixes"
        )
    out = spans[0]
    for more in spans[1:]:
        out = out.unionByName(more)
    return out


RUNS = "text_a long, text_b long, runs array<struct<start: int, end: int>>"
_RUN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


@released
def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal runs of each text, from spans by text and start; only the runs of one text are held."""
    text, runs, out = None, [], []

    def batch_of_texts() -> pa.RecordBatch:
        a, b, spans = zip(*out)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(spans, pa.list_(_RUN))], ["text_a", "text_b", "runs"])

    for batch in batches:
        for a, b, start, end in zip(*(batch.column(n).to_pylist() for n in ("text_a", "text_b", "start", "end"))):
            if (a, b) != text:
                if runs:
                    out.append((*text, [{"start": s, "end": e} for s, e in runs]))
                text, runs = (a, b), []
            if runs and start <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], end)
            else:
                runs.append([max(0, start), end])
        if len(out) >= 1024:
            yield batch_of_texts()
    if runs:
        out.append((*text, [{"start": s, "end": e} for s, e in runs]))
    if out:
        yield batch_of_texts()


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


@released
def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: the bytes that its runs cover, and the hash of the others."""
    expand = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            doc_id, packed, runs = (batch.column(n)[i].as_py() for n in ("doc_id", "packed", "runs"))
            text = expand(packed)
            digest, done, gone = hashlib.sha256(), 0, 0
            for run in runs:
                end = min(len(text), run["end"])
                digest.update(text[done : run["start"]])
                gone += end - run["start"]
                done = end
            digest.update(text[done:])
            rows.append((doc_id, len(text), gone, len(runs), digest.hexdigest()))
        if rows:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, settings: RepeatSettings = RepeatSettings()) -> DataFrame:
    """What is left of each document when every byte of a repeat of ``least`` bytes is removed: counts and a hash.

    A text that several rows have is a repeat as a whole, so its rows need neither their spans nor their bytes, and only
    texts of one row that do have spans are read again.
    """
    key = ["text_a", "text_b"]
    texts = materialize(packed_texts(docs), "packed-texts")
    names = materialize(named_texts(texts), "texts")
    copied = names.where("n > 1").select(*key)
    spans = repeats(texts, names, settings)
    merged = spans.repartition(F.xxhash64(*key)).sortWithinPartitions(*key, "start").mapInArrow(_merged, RUNS)
    runs = materialize(merged.join(copied, key, "left_anti"), "runs")
    known = copied.withColumn("copied", F.lit(True)).unionByName(runs.select(*key, F.lit(False).alias("copied")))
    plain = texts.select("doc_id", *key, "n_bytes", "sha256").join(known, key, "left")
    gone = F.coalesce("copied", F.lit(False)) & (F.col("n_bytes") >= settings.least)
    nothing = hashlib.sha256(b"").hexdigest()
    whole = plain.where("copied is null or copied").select(
        "doc_id", "n_bytes", F.when(gone, F.col("n_bytes")).otherwise(0).alias("n_removed"), gone.cast("long").alias("n_spans"), F.when(gone, nothing).otherwise(F.col("sha256")).alias("kept_sha256")
    )
    return whole.unionByName(texts.select("doc_id", *key, "packed").join(runs, key).select("doc_id", "packed", "runs").mapInArrow(_removed, RESULT))
