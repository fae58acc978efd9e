"""Blocks of points that are n-gram sets, and what is found inside them.

Points that fit into one block are compared in one task. Beyond that they are dealt by hash into parts of half a block, and
each pair of parts is a block: any two points meet, a task holds one block, and the work grows with the square of the points.

Distances are counts of the n-grams that only one of two sets has: the squared Euclidean distance of binary vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tracecast.storage import materialize

#: What the functions of blocks read; they may ask for more columns.
POINT = ("point", "weight", "items")


#: Most tasks that blocks are dealt to, and parts of a side of the groups that forests are merged in.
_TASKS = 10_000
_SPAN = 8
#: Numbers of the distances to clusters that a task holds.
_NUMBERS = 1 << 23


@dataclass(frozen=True)
class BlockSettings:
    #: Points compared with one another in a task, about.
    points: int = 6144
    #: Not read any more: blocks hold all pairs, so there is one order only.
    orders: int = 1


def _parts(points: DataFrame, settings: BlockSettings) -> int:
    """Parts of half a block; one if all points fit into one block."""
    n = points.count()
    return 1 if n <= settings.points else -(-2 * n // settings.points)


def _part(point: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(point), F.lit(parts)).cast("int")


def in_blocks(points: DataFrame, run: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str, settings: BlockSettings = BlockSettings()) -> DataFrame:
    """What ``run`` returns for each block of ``points``; any two points are in one block at least."""
    parts = _parts(points, settings)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held).combine_chunks())

    if parts == 1:
        return points.coalesce(1).mapInArrow(whole, schema)
    empty = to_arrow_schema(StructType.fromDDL(schema))

    def of_pair(block: pa.Table) -> pa.Table:
        found = list(run(block.combine_chunks()))
        return pa.concat_tables(pa.Table.from_batches([b]) for b in found).cast(empty) if found else empty.empty_table()

    own, other = _part("point", parts), F.col("other_part")
    met = points.withColumn("other_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).where(other != own)
    met = met.withColumns({"low_part": F.least(own, other), "high_part": F.greatest(own, other)}).drop("other_part")
    pair = ["low_part", "high_part"]
    return met.repartition(min(parts * (parts - 1), _TASKS), *pair).groupBy(*pair).applyInArrow(of_pair, schema)


def squared_distances(items: pa.ListArray, rows: slice = slice(None), columns: int = 4096) -> np.ndarray:
    """Distances of the chosen sets to all sets of the block."""
    size = items.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(size)), size)
    names, column = np.unique(items.flatten().to_numpy(zero_copy_only=False), return_inverse=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(size[rows]), len(size)), np.float32)
    for start in range(0, len(names), columns):
        low, high = np.searchsorted(column, [start, start + columns])
        has = np.zeros((len(size), min(columns, len(names) - start)), np.float32)
        has[owner[low:high], column[low:high] - start] = 1
        both += has[rows] @ has.T
    size = size.astype(np.int32)
    return size[rows, None] + size[None, :] - 2 * both.astype(np.int32)


def nearest(most: int, tile: int = 1024):
    """Of each point of a block the nearest others, until they stand for ``most`` traces with its own copies."""

    def run(block: pa.Table) -> Iterator[pa.RecordBatch]:
        point, weight = block.column("point").to_numpy(), block.column("weight").to_numpy()
        items = block.column("items").combine_chunks()
        for start in range(0, len(point), tile):
            rows = slice(start, min(len(point), start + tile))
            apart = squared_distances(items, rows)
            apart[np.arange(len(apart)), np.arange(rows.start, rows.stop)] = np.iinfo(np.int32).max
            k = min(most, len(point) - 1)
            near = np.argpartition(apart, k - 1, axis=1)[:, :k] if k else np.zeros((len(apart), 0), np.int64)
            lists = [
                [{"apart": int(row[q]), "other": int(point[q]), "weight": int(weight[q])} for q in chosen]
                for row, chosen in zip(apart, near.tolist())
            ]
            yield pa.RecordBatch.from_arrays([pa.array(point[rows]), pa.array(lists, pa.list_(_NEAR))], ["point", "near"])

    return run


_NEAR = pa.struct([("apart", pa.int64()), ("other", pa.int64()), ("weight", pa.int64())])
NEAREST = "point long, near array<struct<apart: long, other: long, weight: long>>"


def core_distances(points: DataFrame, sizes: list[int], settings: BlockSettings = BlockSettings()) -> DataFrame:
    """``points`` with ``cores``: for each size, how far the trace is that comes so many places after a point's own; null if there are not so many."""
    found = in_blocks(points.select(*POINT), nearest(max(sizes)), NEAREST, settings)
    lists = found.groupBy("point").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))  # a few per block
    steps = F.transform(
        F.sequence(F.lit(1), F.size("near")),
        lambda i: F.struct(F.element_at("near", i)["apart"].alias("apart"), F.aggregate(F.slice("near", F.lit(1), i), F.col("weight") - 1, lambda s, q: s + q["weight"]).alias("reach")),
    )
    steps = F.when(F.size("near") > 0, steps).otherwise(F.array())

    def core(size: int) -> Column:
        beyond = F.filter(F.col("steps"), lambda s: s["reach"] >= size)
        return F.when(F.col("weight") > size, F.lit(0).cast("long")).otherwise(F.get(beyond, F.lit(0))["apart"])

    listed = points.join(lists, "point", "left").withColumn("near", F.coalesce("near", F.array()))
    return listed.withColumn("steps", steps).select(*points.columns, F.array(*[core(s) for s in sizes]).alias("cores"))


def least_tree(weights: Callable[[int], np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of a minimum spanning tree of ``n`` points, given the weights from a point to all: from, to, weight."""
    far = np.iinfo(np.int32).max
    source, cost, away = np.zeros(n, np.int64), weights(0).copy(), np.ones(n, bool)
    away[0], cost[0] = False, far
    ends = np.zeros((3, n - 1), np.int64)
    for i in range(n - 1):
        new = int(cost.argmin())
        ends[:, i] = source[new], new, cost[new]
        away[new], cost[new] = False, far
        row = weights(new)
        closer = away & (row < cost)
        cost[closer] = row[closer]
        source[closer] = new
    return ends[0], ends[1], ends[2]


def spanning(sizes: list[int]):
    """For each size the least spanning tree of a block by mutual reachability: the distance, or a core distance if that is larger."""

    def run(block: pa.Table) -> Iterator[pa.RecordBatch]:
        point = block.column("point").to_numpy()
        apart = squared_distances(block.column("items").combine_chunks())
        flat = block.column("cores").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(point), -1)
        found: dict[bytes, tuple] = {}
        for place, size in enumerate(sizes):
            core = np.where(np.isnan(flat[:, place].astype(float)), -1, flat[:, place]).astype(np.int32)
            live = np.flatnonzero(core >= 0)
            if len(live) < 2:
                continue
            own, whole = core[live], len(live) == len(core)
            row = lambda i: np.maximum(np.maximum(apart[i] if whole else apart[live[i]][live], own), own[i])  # noqa: B023, E731
            if core.tobytes() not in found:  # sizes with the same core distances have the same tree
                found[core.tobytes()] = least_tree(row, len(live))
            a, b, level = found[core.tobytes()]
            columns = [pa.array(np.full(len(a), size, np.int32)), pa.array(point[live[a]]), pa.array(point[live[b]]), pa.array(level)]
            yield pa.RecordBatch.from_arrays(columns, ["candidate", "a", "b", "level"])

    return run


FOREST = "candidate int, a long, b long, level long"


def _least_edges(edges: pa.Table) -> pa.Table:
    """Edges of a least spanning forest of one candidate's ``edges``."""
    edges = edges.select(["candidate", "a", "b", "level"]).take(np.argsort(edges.column("level").to_numpy(), kind="stable"))
    nodes, ends = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("a", "b")]), return_inverse=True)
    up, kept = list(range(len(nodes))), []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for start in range(0, len(edges), 1 << 16):  # few numbers are Python objects at once
        span = slice(start, min(start + (1 << 16), len(edges)))
        for i, a, b in zip(range(span.start, span.stop), ends[: len(edges)][span].tolist(), ends[len(edges) :][span].tolist()):
            a, b = root(a), root(b)
            if a != b:
                up[b] = a
                kept.append(i)
    return edges.take(np.array(kept, np.int64))


def thinned(edges: DataFrame, parts: int, settings: BlockSettings = BlockSettings(), most_nodes: int = 200_000) -> DataFrame:
    """``edges`` less those that a least spanning forest does without: forests of pairs of parts are merged to those of pairs of wider parts."""
    span = 1
    while span < parts and span * _SPAN * settings.points <= most_nodes:
        span *= _SPAN
        of = lambda end: F.expr(f"{end} div {span}")  # noqa: B023, E731
        sides = edges.withColumns({"part_a": _part("a", parts), "part_b": _part("b", parts)}).withColumns({"low": F.least(of("part_a"), of("part_b")), "high": F.greatest(of("part_a"), of("part_b"))})
        edges = materialize(sides.groupBy("candidate", "low", "high").applyInArrow(_least_edges, FOREST), "forest")
    return edges


def forest(cored: DataFrame, sizes: list[int], settings: BlockSettings = BlockSettings()) -> DataFrame:
    """``candidate, a, b, level``: edges that hold a least spanning forest of all pairs for each size.

    What spans the blocks spans their union: an edge left out is the largest of a circle in its block.
    """
    found = in_blocks(cored.select(*POINT, "cores"), spanning(sizes), FOREST, settings).distinct()
    parts = _parts(cored, settings)
    return thinned(materialize(found, "block-forests"), parts, settings) if parts > _SPAN else found


def _nearest_clusters(apart: np.ndarray, own: tuple[tuple[int, int], ...], most: int | None, tile: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns, clusters and distances of the ``most`` nearest clusters, of all in order if None; ``own`` has the exemplars' clusters, in order, and rows."""
    clusters, places = np.array([c for c, _ in own]), np.array([i for _, i in own])
    starts = np.flatnonzero(np.concatenate([[True], clusters[1:] != clusters[:-1]]))
    k, number, parts = min(most or len(starts), len(starts)), np.arange(len(starts)), []
    for start in range(0, apart.shape[1], tile):
        to = apart[places, start : start + tile]  # distances are the same both ways: rows are read, not columns
        near = np.ascontiguousarray((to if len(starts) == len(places) else np.minimum.reduceat(to, starts, axis=0)).T)
        if most is None:
            parts.append((np.broadcast_to(number, near.shape), near))
            continue
        placed = near.astype(np.int64) * len(starts) + number  # the smaller cluster on ties
        if placed.max() < np.iinfo(np.int32).max:
            placed = placed.astype(np.int32)
        picked = np.argpartition(placed, k - 1, axis=1)[:, :k]
        parts.append((picked, np.take_along_axis(near, picked, axis=1)))
    picked, near = (np.concatenate([p[j] for p in parts]).ravel() for j in (0, 1))
    return np.repeat(np.arange(apart.shape[1]), k), clusters[starts][picked], near.astype(np.int64)


def to_exemplars(sizes: list[int], most: int | None = None, points: int | None = None):
    """Distance of the first ``points`` of a block, or of all, to the ``most`` nearest clusters, or to all, by the nearest exemplar of each that is in the block.

    ``marks`` holds the size and the cluster of which a point is an exemplar.
    """

    def run(block: pa.Table) -> Iterator[pa.RecordBatch]:
        point = block.column("point").to_numpy()[:points]
        first = points or 0  # the exemplars come after the points asked for
        marks = block.column("marks").to_pylist()[first:]
        apart = squared_distances(block.column("items").combine_chunks(), slice(first, None))[:, : len(point)]
        of_size, found = {size: [] for size in sizes}, {}
        for i, of in enumerate(marks):
            for m in of or ():
                of_size[m["candidate"]].append((m["cluster"], i))
        for size in sizes:
            own = tuple(sorted(of_size[size]))
            if not own:
                continue
            if own not in found:  # sizes with the same exemplars have the same distances
                found[own] = _nearest_clusters(apart, own, most)
            rows, clusters, near = found[own]
            columns = [pa.array(np.full(len(rows), size, np.int32)), pa.array(point[rows]), pa.array(clusters), pa.array(near)]
            yield pa.RecordBatch.from_arrays(columns, ["candidate", "point", "cluster", "apart"])

    return run


def _to_all_clusters(sizes: list[int], clusters: dict[int, int]):
    """For each part of points, followed by all exemplars, the distances to all clusters: exemplars pass by, the least distances are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, asked, least = None, [], {}

        def done() -> Iterator[pa.RecordBatch]:
            for size, apart in least.items():
                point = np.concatenate([b.column("point").to_numpy() for b in asked])
                step = max(1, _NUMBERS // 8 // apart.shape[1])
                for start in range(0, len(point), step):
                    rows = apart[start : start + step]
                    lists = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * apart.shape[1], rows.ravel())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size, np.int32)), pa.array(point[start : start + step]), lists], ["candidate", "point", "apart"])

        for batch in batches:
            if not batch.num_rows:
                continue
            of, exemplar = batch.column("part").to_numpy(), batch.column("exemplar").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero((of[1:] != of[:-1]) | (exemplar[1:] != exemplar[:-1])) + 1), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if of[start] != part:
                    yield from done()
                    part, asked, least = of[start], [], {}
                rows = batch.slice(start, end - start)
                if not exemplar[start]:
                    asked.append(rows)
                    continue
                n = sum(b.num_rows for b in asked)
                if not n:  # a part without points
                    continue
                for found in to_exemplars(sizes, None, n)(pa.Table.from_batches([*asked, rows]).combine_chunks()):
                    size = found.column("candidate")[0].as_py()
                    near = found.column("apart").to_numpy().reshape(n, -1)
                    places = found.column("cluster").to_numpy()[: near.shape[1]]
                    if size not in least:
                        least[size] = np.full((n, clusters[size]), np.iinfo(np.int32).max, np.int32)
                    least[size][:, places] = np.minimum(least[size][:, places], near)
        yield from done()

    return run


def exemplar_distances(points: DataFrame, marks: DataFrame, sizes: list[int], settings: BlockSettings = BlockSettings()) -> tuple[DataFrame, DataFrame]:
    """``candidate, clusters`` with all clusters in order, and ``candidate, point, apart`` with the distances to them; ``marks`` has ``candidate, cluster, point`` of the exemplars."""
    order = materialize(marks.groupBy("candidate").agg(F.array_sort(F.collect_set("cluster")).alias("clusters")), "cluster-order")
    clusters = {r["candidate"]: r["n"] for r in order.select("candidate", F.size("clusters").alias("n")).collect()}  # one number per size
    place = F.dense_rank().over(Window.partitionBy("candidate").orderBy("cluster")).cast("long") - 1
    listed = marks.withColumn("cluster", place).groupBy("point").agg(F.collect_list(F.struct("candidate", "cluster")).alias("marks"))  # one per size
    listed = materialize(listed.join(points.select("point", "items"), "point"), "exemplars").withColumn("exemplar", F.lit(True))
    rows = max(1, min(settings.points, _NUMBERS // max(1, sum(clusters.values()))))
    parts = max(1, -(-points.count() // rows))
    asked = points.select(_part("point", parts).alias("part"), F.lit(False).alias("exemplar"), "point", "items", F.lit(None).cast(listed.schema["marks"].dataType).alias("marks"))
    passing = listed.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "exemplar", "point", "items", "marks")
    dealt = asked.unionByName(passing).repartition(min(2 * parts, _TASKS), "part").sortWithinPartitions("part", "exemplar")
    return order, dealt.mapInArrow(_to_all_clusters(sizes, clusters), "candidate int, point long, apart array<int>")
