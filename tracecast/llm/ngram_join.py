"""N-gram Jaccard join: MinHash bands find groups, full n-gram sets verify every pair in them.

A text is the set of its windows of five words (all its words, if it has fewer). Texts with equal sets
are one class, and one of them stands for it from then on. Band and row counts are the ones
that reach the target recall at the threshold with the most selective bands the hash budget allows. Class
representatives that share a band hash are compared by their whole signatures in the task that holds
the bucket, and the ones that agree enough fall into one group. In a group all pairs are
verified on the full sets, in blocks, inside tasks: a task returns the number of links of each
representative and the smallest one it is connected to, never pairs. Buckets and groups
larger than a block are dealt out as pairs of blocks.

Texts without words (null, empty) have no links and are classes of their own. Rows that share a ``doc_id`` are one
document and so one class; rows with a null id are one, too. Texts are read whole. Of ties the smallest ``doc_id`` names the class and stays. No
documents give no rows. Further columns, whatever their names, are ignored, or pass through :func:`one_of_each`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracecast.llm.common import hashed_words, id_and_text, mixed, raw_bytes, released, set_aside, slices
from tracecast.llm.components import components
from tracecast.llm.groups import whole_groups
from tracecast.storage import materialize

_IS_WORD = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


@dataclass(frozen=True)
class JoinSettings:
    words: int = 5
    threshold: float = 0.8
    #: Share of the pairs at the threshold that must meet in a band.
    recall: float = 0.999
    max_hashes: int = 128
    #: Standard errors below the threshold at which signatures still count as agreeing.
    slack: float = 4.5
    #: Rows compared with one another at once: by their signatures, by their full sets.
    bucket_rows: int = 4_096
    block_rows: int = 256
    seed: int = 5

    def bands(self) -> tuple[int, int]:
        """Bands and rows per band: the most rows whose bands reach the recall within the hash budget."""
        best = (self.max_hashes, 1)
        for rows in range(1, self.max_hashes + 1):
            count = math.ceil(math.log(1 - self.recall) / math.log(1 - self.threshold**rows))
            if count * rows <= self.max_hashes:
                best = (count, rows)
        return best

    def agreement(self) -> float:
        count, rows = self.bands()
        return self.threshold - self.slack * math.sqrt(self.threshold * (1 - self.threshold) / (count * rows))


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct window hashes of each text, one after the other, and where each text starts."""
    data, starts = raw_bytes(column)
    words, doc = hashed_words(data, starts, _IS_WORD)
    n = len(column)
    per_doc = np.bincount(doc, minlength=n)
    factors = np.random.default_rng(size).integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    last = max(len(words) - size + 1, 0)
    windows = sum((words[i : last + i] * factors[i] for i in range(size)), np.zeros(last, np.uint64))
    same = doc[:last] == doc[size - 1 :] if last else np.zeros(0, bool)
    windows, owner = windows[same], doc[:last][same]
    short = np.flatnonzero((per_doc > 0) & (per_doc < size))
    if len(short):
        first = np.cumsum(per_doc) - per_doc
        whole = np.array([(words[first[d] : first[d] + per_doc[d]] * factors[: per_doc[d]]).sum() + np.uint64(per_doc[d]) for d in short], np.uint64)
        windows, owner = np.append(windows, whole), np.append(owner, short)
    windows = mixed(windows)
    order = np.lexsort((windows, owner))
    windows, owner = windows[order], owner[order]
    fresh = np.ones(len(windows), bool)
    fresh[1:] = (windows[1:] != windows[:-1]) | (owner[1:] != owner[:-1])
    windows, owner = windows[fresh], owner[fresh]
    return windows, np.searchsorted(owner, np.arange(n + 1))


def set_names(windows: np.ndarray, starts: np.ndarray) -> list[bytes | None]:
    """128-bit name of each set, null for empty ones."""
    total = [np.concatenate([[np.uint64(0)], np.cumsum(h, dtype=np.uint64)]) for h in (mixed(windows + np.uint64(1)), mixed(windows ^ np.uint64(0x5851F42D4C957F2D)))]
    name = np.stack([mixed(t[starts[1:]] - t[starts[:-1]]) for t in total], axis=1).astype(">u8")
    return [row.tobytes() if size else None for row, size in zip(name, np.diff(starts))]


def signatures(windows: np.ndarray, starts: np.ndarray, settings: JoinSettings) -> np.ndarray:
    """Smallest hash of each set under each hash function; the sets must not be empty."""
    count, rows = settings.bands()
    random = np.random.default_rng(settings.seed)
    out = np.empty((len(starts) - 1, count * rows), np.uint32)
    for k in range(count * rows):
        factor, shift = (random.integers(1, 1 << 63, 2, dtype=np.uint64) * np.uint64(2)) + np.uint64(1)
        h = ((windows ^ shift) * factor) >> np.uint64(32)
        out[:, k] = np.minimum.reduceat(h, starts[:-1])
    return out


def _band_hashes(sign: np.ndarray, settings: JoinSettings) -> np.ndarray:
    count, rows = settings.bands()
    parts = sign.reshape(len(sign), count, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64), (len(sign), count))
    for r in range(rows):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return h.view(np.int64)


def _signed(settings: JoinSettings):
    count, _ = settings.bands()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            windows, starts = shingle_sets(part.column("text"), settings.words)
            names, full = set_names(windows, starts), np.flatnonzero(np.diff(starts))
            sign = signatures(windows, np.append(starts[:-1][full], starts[-1]), settings) if len(full) else np.zeros((0, 1), np.uint32)
            bands = _band_hashes(sign, settings) if len(full) else np.zeros((0, count), np.int64)
            place = {int(d): i for i, d in enumerate(full)}
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(names, pa.binary()),
                    pa.array([sign[place[i]].tobytes() if i in place else None for i in range(len(names))], pa.binary()),
                    pa.array([bands[place[i]] if i in place else None for i in range(len(names))], pa.list_(pa.int64())),
                ],
                ["doc_id", "node", "sign", "bands"],
            )

    return released(run)


def _smallest_connected(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index each of n rows is connected to through the links (a, b)."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def _reached(sign: np.ndarray, least: float) -> np.ndarray:
    """First row that each row is connected to by agreeing signatures: every row reached is compared with those not yet reached."""
    label = np.arange(len(sign))
    rest = np.arange(1, len(sign))
    for first in range(len(sign)):
        if label[first] != first:
            continue
        rest = rest[rest != first]
        ahead = [first]
        while ahead and len(rest):
            near = (sign[rest] == sign[ahead.pop()]).mean(1) >= least
            label[rest[near]] = first
            ahead += rest[near].tolist()
            rest = rest[~near]
    return label


def _agreeing(settings: JoinSettings, all_pairs_up_to: int = 16):
    """Edges from each row of a bucket (or pair of blocks of it) to the smallest one it is connected to."""
    least = settings.agreement()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["bucket", "block_a", "block_b"]):
            sign = np.stack([np.frombuffer(s, np.uint32) for s in rows.column("sign").to_pylist()])
            label, sizes = np.arange(len(sign)), np.diff(starts)
            for size in np.unique(sizes[sizes > 1]).tolist():
                firsts = starts[:-1][sizes == size]
                if size > all_pairs_up_to:
                    for first in firsts.tolist():
                        label[first : first + size] = first + _reached(sign[first : first + size], least)
                    continue
                i, j = np.triu_indices(size, 1)
                a, b = ((firsts[:, None] + k).ravel() for k in (i, j))
                near = np.concatenate([(sign[a[c : c + 50_000]] == sign[b[c : c + 50_000]]).mean(1) >= least for c in range(0, len(a), 50_000)])
                small = _smallest_connected(len(sign), a[near], b[near])
                label = np.where(small == np.arange(len(sign)), label, small)
            moved = np.flatnonzero(label != np.arange(len(label)))
            node = rows.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(moved, pa.int64())), node.take(pa.array(label[moved]))], ["a", "b"])

    return released(run)


def _in_blocks(rows: DataFrame, group: str, size: str, block_rows: int) -> DataFrame:
    """Deals each group out as pairs of blocks of bounded size; groups of one block stay whole."""
    blocks = F.ceil(F.col(size) / block_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), blocks - 1),
        lambda o: F.struct(F.least(o, F.col("block")).alias("block_a"), F.greatest(o, F.col("block")).alias("block_b")),
    )
    dealt = rows.withColumn("block", own).withColumn("pair", F.explode(pairs)).select("*", "pair.*").drop("pair", size)
    return dealt.repartition(group, "block_a", "block_b").sortWithinPartitions(group, "block_a", "block_b", "node")


def _with_sets(settings: JoinSettings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            windows, starts = shingle_sets(part.column("text"), settings.words)
            own = np.array(set_names(windows, starts), object) == np.array(part.column("node").to_pylist(), object)
            kept = np.flatnonzero(own)
            sets = [windows[starts[i] : starts[i + 1]].tobytes() for i in kept]
            part = part.take(pa.array(kept, pa.int64()))
            names = ["node", "label", "size"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(sets, pa.binary())], [*names, "windows"])

    return released(run)


def _overlaps(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections, from incidence matrices of the windows that two sets or more have."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    window, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.cumsum(seen > 1) - 1
    use = (seen > 1)[column]
    column, owner = shared[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        low, high = np.searchsorted(column, [start, start + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[owner[low:high], column[low:high] - start] = 1
        out += has @ has.T
    return out


def _verified(settings: JoinSettings):
    """Per row of a pair of blocks: its links there and the smallest row it is connected to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, ["label", "block_a", "block_b"], 2 * settings.block_rows):
            block = rows.column("block").to_numpy()
            cross = rows.column("block_a").to_numpy() != rows.column("block_b").to_numpy()
            raw = rows.column("windows").to_pylist()
            links, label = np.zeros(len(raw), np.int64), np.arange(len(raw))
            for start, end in zip(starts[:-1].tolist(), starts[1:].tolist()):
                if end - start < 2:
                    continue
                sets = [np.frombuffer(raw[i], np.uint64) for i in range(start, end)]
                both, size = _overlaps(sets), np.array([len(s) for s in sets])
                near = both >= settings.threshold * (size[:, None] + size[None, :] - both) - 1e-6
                np.fill_diagonal(near, False)
                if cross[start]:
                    near &= block[start:end, None] != block[None, start:end]
                links[start:end] = near.sum(1)
                label[start:end] = start + _smallest_connected(end - start, *np.nonzero(near))
            node = rows.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node, node.take(pa.array(label)), pa.array(links)], ["a", "b", "links"])

    return released(run)


def join(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """Per document: ``class_id`` (smallest ``doc_id`` of all it is linked with, directly or not), ``n_links`` to
    different n-gram sets, ``n_copies`` with the same set (itself included)."""
    signed = materialize(id_and_text(docs).mapInArrow(_signed(settings), "doc_id long, node binary, sign binary, bands array<long>"), "signatures")
    sets = signed.where("node is not null").groupBy("node").agg(
        F.min(F.struct("doc_id", "sign", "bands")).alias("first"), F.count_distinct("doc_id").alias("n_copies")
    )
    sets = materialize(sets.select("node", "first.*", "n_copies"), "sets")

    banded = sets.select("node", F.explode("bands").alias("bucket"))
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    met = banded.join(buckets, "bucket").join(sets.select("node", "sign"), "node")
    near = materialize(_in_blocks(met, "bucket", "size", settings.bucket_rows).mapInArrow(_agreeing(settings), "a binary, b binary"), "near-sets")

    groups = components(near)
    sizes = groups.groupBy("label").agg(F.count("*").alias("size"))
    members = materialize(groups.join(sizes, "label").join(sets.select("node", F.col("doc_id").alias("of")), "node"), "members")
    grouped = id_and_text(docs).join(members.select("of"), F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
    texts = grouped.join(members, F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "label", "size", "text")
    full = texts.mapInArrow(_with_sets(settings), "node binary, label binary, size long, windows binary").dropDuplicates(["node"])
    checked = _in_blocks(full, "label", "size", settings.block_rows).mapInArrow(_verified(settings), "a binary, b binary, links long")
    checked = materialize(checked, "verified-links")

    links = checked.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("n_links"))
    # a document with several rows connects the sets of these rows
    several = signed.where("node is not null").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    rows_of_one = signed.select("doc_id", F.col("node").alias("b")).join(several.select("doc_id", "a"), "doc_id").select("a", "b")
    classes = components(checked.where("a <> b").select("a", "b").unionByName(rows_of_one.where("b is not null")))
    named = sets.select("node", "doc_id", "n_copies").join(classes, "node", "left").join(links, "node", "left")
    named = named.withColumn("label", F.coalesce("label", "node"))
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    named = named.join(smallest, "label").select("node", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    return signed.select("doc_id", "node").join(named, "node", "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, settings: JoinSettings = JoinSettings()) -> DataFrame:
    """``docs`` without all but the document of smallest ``doc_id`` of each class; repeated rows of it become one."""
    names, docs = docs.columns, set_aside(docs, "doc_id", "text")
    classes = materialize(join(docs, settings), "classes")
    # a row without words has no other class than its own, and goes with its document if that goes
    stays = F.min(F.col("class_id").eqNullSafe(F.col("doc_id")))
    decided = classes.groupBy(F.col("doc_id").alias("class_doc_id")).agg(stays.alias("stays"), F.count("*").alias("rows"))
    # few documents go or have several rows, so these ids are the ones to join with
    special = materialize(decided.where("not stays or rows > 1"), "special-documents")
    same = docs["doc_id"].eqNullSafe(F.col("class_doc_id"))
    once = docs.join(special.select("class_doc_id"), same, "left_anti")
    several = docs.join(special.where("stays").select("class_doc_id"), same, "left_semi")
    first = W.partitionBy("doc_id").orderBy("text")
    one = several.withColumn("class_row", F.row_number().over(first)).where("class_row = 1").drop("class_row")
    return once.unionByName(one).toDF(*names)
