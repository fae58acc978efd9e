"""Density clustering of traces with soft membership.

A point is a distinct n-gram set that stands for its traces. All pairs of points are compared in blocks, which give the core
distances and, for each minimum cluster size, a spanning forest by mutual reachability (``neighbours.py``). The forest's
merges, at the distances that occur in it, are condensed and the clusters with the largest excess of mass are chosen
(``density.py``). Exemplars of a cluster are the points its leaves were born with. Every point, noise too, belongs to all
clusters by shares of the inverse squared distance to their nearest exemplars.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.functions.sequences import ngram_arrays
from tracecast.operators import density, neighbours
from tracecast.operators.traces import variants
from tracecast.settings import Settings
from tracecast.storage import materialize

#: Clusters a point may belong to, the nearest ones; None: all.
NEAREST_CLUSTERS = None


@dataclass(frozen=True)
class Clustering:
    """``variants``: (variant_id, acts, n_traces, point); ``memberships``: (candidate, cluster_id, variant_id, n_traces, prob)."""

    variants: DataFrame
    memberships: DataFrame


def feature_points(train: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Variants with the n-grams they hold as hashes: ``(variant_id, acts, n_traces, items)``."""
    distinct = variants(train).select("variant_id", "acts", "n_traces")
    grams = F.array_distinct(ngram_arrays(F.col("acts"), settings.ngram_min, settings.ngram_max))
    return distinct.withColumn("items", F.array_sort(F.transform(grams, lambda g: F.xxhash64(g))))


def points_of(by_variant: DataFrame) -> DataFrame:
    """``(point, weight, items, name)``: one row per distinct n-gram set, named by its smallest variant."""
    sets = by_variant.groupBy("items").agg(F.sum("n_traces").alias("weight"), F.min("variant_id").alias("name"))
    return materialize(sets.withColumn("point", F.monotonically_increasing_id()), "points")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` of a node-hub graph; a component is named by its smallest node.

    Each round joins every node to the smallest node it shares a hub with, follows
    those links twice, and contracts the graph to the nodes joined to. Hubs left with
    one node drop out, so at least half of the remaining nodes go in every round.
    """
    links, rounds = edges, []
    while True:
        shared = links.groupBy("hub").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
        lowest = materialize(
            links.join(shared, "hub").groupBy("node").agg(F.min("lo").alias("to")), "components"
        )
        if lowest.isEmpty():
            break
        merged = materialize(_follow(_follow(lowest)), "components")
        rounds.append(merged)
        # A node without a shared hub is finished; the others go on under their new names.
        links = materialize(
            links.join(shared.select("hub"), "hub", "left_semi").join(merged, "node")
            .select(F.col("to").alias("node"), "hub").distinct(),
            "components",
        )
    labels = edges.select("node", F.col("node").alias("component")).distinct()
    for merged in rounds:
        renamed = merged.select(F.col("node").alias("component"), "to")
        labels = labels.join(renamed, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return labels


def _follow(steps: DataFrame) -> DataFrame:
    """Replaces every target by its own target."""
    onward = steps.select(F.col("node").alias("to"), F.col("to").alias("onward"))
    return steps.join(onward, "to").select("node", F.col("onward").alias("to"))


def labels_of(points: DataFrame, sizes: list[int], blocks: neighbours.BlockSettings = neighbours.BlockSettings(), most_nodes: int = 200_000) -> DataFrame:
    """``(candidate, point, label, exemplar)``; a cluster's label is its smallest point, null for noise."""
    cored = materialize(neighbours.core_distances(points, sizes, blocks), "core-distances")
    forest = materialize(neighbours.forest(cored, sizes, blocks), "forest")
    cores = F.posexplode("cores").alias("place", "core")
    listed = cored.select("point", "weight", cores).withColumn("candidate", F.element_at(F.array(*[F.lit(c) for c in sizes]), F.col("place") + 1))
    return materialize(density.choose(listed, forest, connected_components, most_nodes), "labels")


def soft_membership(points: DataFrame, labels: DataFrame, sizes: list[int], blocks: neighbours.BlockSettings = neighbours.BlockSettings()) -> DataFrame:
    """``(candidate, point, cluster, prob)``: shares of all clusters, by the inverse squared distance to their nearest exemplars.

    Exemplars of one cluster only belong to it wholly; at no distance from several, to each alike.
    """
    marks = labels.where("exemplar and label is not null").select("candidate", F.col("label").alias("cluster"), "point")
    order, apart = neighbours.exemplar_distances(points, marks, sizes, blocks)
    shared = apart.mapInArrow(_with_shares, "candidate int, point long, apart array<int>, shares array<double>")
    shared = materialize(shared, "cluster-distances")  # an array per point: as rows they are many times as large
    placed = shared.join(F.broadcast(order), "candidate").select("candidate", "point", "shares", "clusters", F.posexplode("apart").alias("place", "apart"))  # a row per size
    return placed.select("candidate", "point", F.get("clusters", F.col("place")).alias("cluster"), F.get("shares", F.col("apart")).alias("prob")).where("prob > 0")


def _with_shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the share of a cluster at each distance that occurs, of 0 on: there are few, as they are whole numbers.

    Rounded, so that the order of the sums decides neither ties nor thresholds.
    """
    for batch in batches:
        apart, shares = batch.column("apart"), []
        values, ends = apart.flatten().to_numpy(), np.cumsum([0, *apart.value_lengths().to_numpy()])
        for start, end in zip(ends, ends[1:]):
            found = np.bincount(values[start:end])
            if found[0]:
                share = (np.arange(len(found)) == 0).astype(float)
            else:
                share = np.concatenate([[0.0], 1 / np.arange(1, len(found))])
            shares.append(np.round(share / (share * found).sum(), 12))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shares, pa.list_(pa.float64()))], [*batch.schema.names, "shares"])


def cluster_traces(train: DataFrame, settings: Settings = Settings()) -> Clustering:
    """Clusters of the training traces for every candidate minimum size with more than one cluster; a cluster has the name of its smallest variant."""
    by_variant = materialize(feature_points(train, settings), "variants")
    points, sizes = points_of(by_variant), settings.candidates()
    labels = labels_of(points, sizes)
    names = labels.where("label is not null").join(points.select("point", "name"), "point").groupBy("candidate", "label").agg(F.min("name").alias("cluster_id"))
    several = names.groupBy("candidate").count().where("count > 1").select("candidate")
    names = materialize(names.join(several, "candidate").withColumnRenamed("label", "cluster"), "cluster-names")
    soft = soft_membership(points, labels.join(several, "candidate", "left_semi"), sizes).join(names, ["candidate", "cluster"]).drop("cluster")
    slim = materialize(by_variant.join(points.select("items", "point"), "items").select("variant_id", "acts", "n_traces", "point"), "points-of-variants")
    # Sequences stay out: they would repeat for every candidate and cluster. Not written: there is a row for every variant and cluster.
    memberships = slim.drop("acts").join(soft, "point").select("candidate", "cluster_id", "variant_id", "n_traces", "prob")
    return Clustering(slim, memberships)


def representatives(memberships: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``is_build`` and ``is_training``: strong and weak members of each cluster.

    A cluster without any takes its most probable trace, the first case on ties.
    """
    # Only numbers are summed up over all memberships; what is kept is a few rows a variant.
    tops = materialize(memberships.groupBy("candidate", "cluster_id").agg(F.max("prob").alias("top")), "tops")
    least = min(settings.prob_building, settings.prob_training)
    strong = memberships.join(tops, ["candidate", "cluster_id"]).where((F.col("prob") >= least) | (F.col("prob") == F.col("top")))
    strong = materialize(strong, "strong-memberships")
    best = strong.groupBy("candidate", "cluster_id").agg(F.min_by("variant_id", F.struct(-F.col("prob"), "variant_id")).alias("best"))

    def member(threshold: float) -> Column:
        alone = (F.col("top") < threshold) & (F.col("variant_id") == F.col("best"))
        return (F.col("prob") >= threshold) | alone

    return (
        strong.join(best, ["candidate", "cluster_id"])
        .withColumns({"is_build": member(settings.prob_building), "is_training": member(settings.prob_training)})
        .drop("top", "best")
        .where("is_build or is_training")
    )


def hard_labels(memberships: DataFrame) -> DataFrame:
    """Most probable cluster of every variant that has one."""
    tops = materialize(memberships.groupBy("candidate", "variant_id").agg(F.max("prob").alias("top")), "tops")
    first = memberships.join(tops, ["candidate", "variant_id"]).where(F.col("prob") == F.col("top"))
    return first.groupBy("candidate", "variant_id").agg(F.min("cluster_id").alias("cluster_id"))


def coverage(chosen: DataFrame) -> DataFrame:
    """Variants and traces in any build or training set, per candidate."""
    once = chosen.groupBy("candidate", "variant_id").agg(
        F.first("n_traces").alias("n"), F.max("is_build").alias("b"), F.max("is_training").alias("t")
    )
    return once.groupBy("candidate").agg(
        F.count_if("b").alias("build_cases"),
        F.coalesce(F.sum(F.when(F.col("t"), F.col("n"))), F.lit(0)).alias("training_cases"),
    )
