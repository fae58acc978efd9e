"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text answers whether any two spans are equal in constant time, and the longest
common extension of two places by binary search. A fingerprint is the hash of the whole text, its
length, and the smallest hashes of its spans of ``WIDTH`` code points (of the whole text, if that is
shorter). The likeness of two fingerprints estimates the Jaccard similarity of their span sets.

Null texts are empty; the fingerprints of two empty texts are equal (likeness 1), that of an empty and
another text 0. Rows are ordered by descending ``doc_id`` (null last), then text; repeated rows
follow one another, and a single document is its own next; no documents give no rows. A text is handled whole, whatever its length. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import batch_of, id_and_text, mixed, slices

WIDTH = 6
KEPT = 64

#: Two primes below 2**31 and their bases: products fit 64 bits, both together tell texts apart.
_FIELDS = ((2_147_483_647, 1_000_003), (2_147_483_629, 918_273_645))
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(field: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``size`` of each."""
    known = _tables.get(field)
    if known is None or len(known[0]) < size:
        prime, base = _FIELDS[field]
        size, tables = max(size, 1 << 16), []
        for step in (base, pow(base, -1, prime)):
            out = np.ones(1, np.uint64)
            while len(out) < size:  # doubling: the second half is the first times base**len
                out = np.concatenate([out, out * np.uint64(pow(step, len(out), prime)) % np.uint64(prime)])
            tables.append(out)
        _tables[field] = known = tuple(tables)
    return known


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class PrefixHashes:
    """Hashes of all prefixes of a text, modulo both primes."""

    def __init__(self, prefixes: list[np.ndarray]):
        self.prefixes = prefixes

    @classmethod
    def of(cls, points: np.ndarray) -> PrefixHashes:
        return cls([np.zeros(1, np.uint64)] * len(_FIELDS)).replaced(0, points)

    def __len__(self) -> int:
        return len(self.prefixes[0]) - 1

    def replaced(self, keep: int, tail: np.ndarray) -> PrefixHashes:
        """Of the first ``keep`` code points followed by ``tail``; only the tail is hashed."""
        out = []
        for field, prefix in enumerate(self.prefixes):
            prime = np.uint64(_FIELDS[field][0])
            powers = _powers(field, keep + len(tail) + 1)[0][keep : keep + len(tail)]
            added = np.cumsum((tail + np.uint64(1)) * powers % prime, dtype=np.uint64)
            out.append(np.concatenate([prefix[: keep + 1], (prefix[keep] + added) % prime]))
        return PrefixHashes(out)

    def spans(self, starts: np.ndarray, ends: np.ndarray, field: int) -> np.ndarray:
        """Hash of each span in one field: equal spans have equal hashes, wherever they stand."""
        prime = np.uint64(_FIELDS[field][0])
        prefix = self.prefixes[field]
        return (prefix[ends] + prime - prefix[starts]) * _powers(field, len(prefix))[1][starts] % prime

    def span(self, start: int, end: int) -> int:
        """Hash of one span in both fields."""
        at = np.array([start]), np.array([end])
        return int(self.spans(*at, 0)[0]) << 31 | int(self.spans(*at, 1)[0])

    def common_extension(self, start: int, other: PrefixHashes, other_start: int) -> int:
        """Code points that agree from both places on, by binary search over span equality."""
        low, high = 0, min(len(self) - start, len(other) - other_start)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(start, start + middle) == other.span(other_start, other_start + middle):
                low = middle
            else:
                high = middle - 1
        return low

    def sketch(self) -> np.ndarray:
        """The smallest hashes of the spans of a fixed width, sorted."""
        n = len(self)
        if not n:
            return np.zeros(0, np.uint32)
        starts = np.arange(max(1, n - WIDTH + 1))
        h = (mixed(self.spans(starts, np.minimum(starts + WIDTH, n), 0)) >> np.uint64(32)).astype(np.uint32)
        take = 4 * KEPT
        while True:
            small = np.unique(np.partition(h, take)[:take] if take < len(h) else h)
            if len(small) >= KEPT or take >= len(h):
                return small[:KEPT]
            take *= 8


def fingerprint(hashes: PrefixHashes) -> str:
    return f"{hashes.span(0, len(hashes)):016x}:{len(hashes):x}:{hashes.sketch().astype('>u4').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated Jaccard similarity of two fingerprints' span sets; 1 for equal ones."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(f.rpartition(":")[2]), ">u4").astype(np.uint32) for f in (a, b))
    both = np.union1d(x, y)[: min(max(len(x), len(y)), KEPT)]
    if not len(both):
        return 0.0
    return float((np.isin(both, x) & np.isin(both, y)).sum() / len(both))


def _in_order(docs: DataFrame) -> DataFrame:
    """Rows in ranges (``part``) of descending ``doc_id``; each range ends with the first row of the next one as a ``guest``.

    One shuffle of the texts. The driver sees a few numbers per range, not per document.
    """
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(key.alias("key"))
    bounds = sorted({int(b) for b in ids.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts)})
    part = F.size(F.filter(F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>"), lambda b: b > F.col("key")))
    heads = {r["part"]: r["head"] for r in ids.groupBy(part.alias("part")).agg(F.max("key").alias("head")).collect()}
    order = sorted(heads)
    host = {heads[after]: before for before, after in zip(order, [*order[1:], *order[:1]])}
    guests = F.create_map(*(F.lit(x) for pair in host.items() for x in pair)) if host else F.lit(None).cast("map<bigint,int>")
    places = F.array(F.struct(part.alias("part"), F.lit(False).alias("guest")), F.struct(F.try_element_at(guests, F.col("key")).alias("part"), F.lit(True).alias("guest")))
    return (
        docs.withColumn("key", key).withColumn("place", F.explode(places)).where("place.part is not null")
        .select("place.part", "place.guest", "key", "doc_id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "guest", F.desc("key"), "text")
    )


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each own row with the row after it: the hashes of a row are made once and serve as its predecessor's next."""
    last = None  # (part, doc_id, text, hashes, fingerprint) of a row that waits for its next
    for batch in slices(batches):
        rows = []
        columns = (batch.column(n).to_pylist() for n in ("part", "guest", "doc_id", "text"))
        for part, guest, doc_id, text in zip(*columns):
            if guest and last is None:
                continue  # a further row of the guest's id
            points = code_points(text)
            hashes = PrefixHashes.of(points)
            mark = fingerprint(hashes)
            if last is not None:
                rows.append(_compared(*last[1:], text, points, mark))
            last = None if guest else (part, doc_id, text, hashes, mark)
        if rows:
            yield batch_of(**{n: [r[i] for r in rows] for i, n in enumerate(RESULT)})


RESULT = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _compared(doc_id, text: str, hashes: PrefixHashes, mark: str, after: str, points: np.ndarray, after_mark: str) -> tuple:
    n = len(hashes)
    edit = n // 3
    edited = fingerprint(hashes.replaced(n - edit, points[:edit])) if edit else mark
    digest = hashlib.sha256((text[: n - edit] + after[:edit]).encode()).hexdigest()
    return doc_id, n, digest, mark, edited, likeness(mark, edited), likeness(mark, after_mark)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document are."""
    return _in_order(id_and_text(docs)).mapInArrow(
        _paired,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
