"""Condensed hierarchy of a spanning forest, and its clusters by excess of mass.

At each distance that occurs, the components that edges of that length join are merged. A component of at least
``candidate`` traces is a cluster: it is born when it becomes so large, grows by smaller components, and ends where it
meets another cluster; both are then children of the one that is born there. Its mass is the sum over its traces of
the density at which they joined less the density at its end. A cluster is chosen if it has more mass than the chosen
ones below it together; the one that holds everything is never chosen.

Merging takes as long as there are edges, one after the other, but every component of the forest needs its own edges
only. While a forest has more than ``most_nodes`` components, the next distance is taken for all of them at once
by joins and sums; then the components that are left are merged in one task per candidate, whose input is bounded by that number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.storage import materialize

#: Density of traces at no distance.
DENSEST = 1e10


def density(level: Column) -> Column:
    return F.when(level > 0, 1 / F.sqrt(level.cast("double"))).otherwise(DENSEST)


def _density(level: int) -> float:
    return level**-0.5 if level else DENSEST


@dataclass
class Merging:
    """The merges of one candidate's components, in memory.

    Clusters are numbered in the order of their birth, so children come before their parents.
    """

    least: int
    weight: list[int]
    #: Cluster of each node that is one, else -1.
    first: list[int]
    mass: list[float] = field(default_factory=list)
    below: list[float] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    leaf: list[bool] = field(default_factory=list)
    #: Distance a cluster was born at, and at which each node joined its first one.
    born: list[int] = field(default_factory=list)
    joined: dict[int, int] = field(default_factory=dict)
    chosen: list[bool] = field(default_factory=list)

    def cluster(self, mass: float, below: float, leaf: bool, born: int) -> int:
        for values, value in ((self.mass, mass), (self.below, below), (self.parent, -1), (self.leaf, leaf), (self.born, born), (self.chosen, False)):
            values.append(value)
        return len(self.mass) - 1

    def run(self, edges: list[tuple[int, int, int]]) -> None:
        """``edges`` are ``(level, a, b)`` by level."""
        n = len(self.weight)
        up = list(range(n))
        weight, alive = self.weight[:], self.first[:]
        waiting: list[list[int]] = [[i] if c < 0 else [] for i, c in enumerate(alive)]  # nodes in no cluster yet

        def root(x: int, of: dict | list) -> int:
            while of[x] != x:
                of[x] = of[of[x]]
                x = of[x]
            return x

        at = 0
        while at < len(edges):
            level, joined = edges[at][0], {}
            while at < len(edges) and edges[at][0] == level:
                _, a, b = edges[at]
                a, b = root(a, up), root(b, up)
                joined.setdefault(a, a)
                joined.setdefault(b, b)
                a, b = root(a, joined), root(b, joined)
                joined[max(a, b)] = min(a, b)
                at += 1
            groups: dict[int, list[int]] = {}
            for x in joined:
                groups.setdefault(root(x, joined), []).append(x)
            for top, members in groups.items():
                if len(members) > 1:
                    self._merge(top, members, level, weight, alive, waiting)
                    for x in members:
                        up[x] = top
        roots = {root(x, up) for x in range(n)}
        heads = [alive[x] for x in roots if alive[x] >= 0]
        for c in heads if len(heads) > 1 else ():
            self.chosen[c] = self.mass[c] >= self.below[c]

    def _merge(self, top: int, members: list[int], level: int, weight: list[int], alive: list[int], waiting: list[list[int]]) -> None:
        # what begins here is part of what is born here
        living = [x for x in members if alive[x] >= 0 and self.born[alive[x]] < level]
        total, here = sum(weight[x] for x in members), _density(level)
        new = [i for x in members for i in (waiting[x] if alive[x] < 0 or self.born[alive[x]] < level else [x])]
        if len(living) == 1:
            own = alive[living[0]]
            self.mass[own] += (total - weight[living[0]]) * here
        elif living:
            below = 0.0
            for x in living:
                c = alive[x]
                self.mass[c] -= weight[x] * here
                self.chosen[c] = self.mass[c] >= self.below[c]
                below += max(self.mass[c], self.below[c])
            own = self.cluster(total * here, below, False, level)
            for x in living:
                self.parent[alive[x]] = own
        elif total >= self.least:
            own = self.cluster(total * here, 0.0, True, level)
        else:
            own = -1
        if own >= 0:
            for i in new:
                self.first[i], self.joined[i] = own, level
            new = []
        weight[top], alive[top], waiting[top] = total, own, new

    def labels(self) -> list[int]:
        """Of each cluster the chosen one it is in: the topmost, -1 if there is none."""
        top = [-1] * len(self.mass)
        for c in range(len(self.mass) - 1, -1, -1):
            above = top[self.parent[c]] if self.parent[c] >= 0 else -1
            top[c] = above if above >= 0 else c if self.chosen[c] else -1
        return top


RESULT = "candidate int, node long, label long, exemplar boolean"


def _in_memory(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """Chosen cluster of each node (null: none), named by its smallest node; whether the node is an exemplar."""
    nodes = nodes.sort_values("node", ignore_index=True)
    number = dict(zip(nodes["node"].tolist(), range(len(nodes))))
    least = int(nodes["candidate"].iloc[0])
    merging = Merging(least, nodes["weight"].tolist(), [-1] * len(nodes))
    for i, (cluster, mass, below, since) in enumerate(zip(nodes["cluster"], nodes["mass"], nodes["below"], nodes["since"])):
        if cluster is not None:
            merging.first[i] = merging.cluster(float(mass), float(below), True, int(since))
            merging.joined[i] = int(since)
    merging.run(sorted((level, number[a], number[b]) for level, a, b in zip(edges["level"].tolist(), edges["a"].tolist(), edges["b"].tolist())))
    top, names = merging.labels(), {}
    for i, c in enumerate(merging.first):
        if c >= 0 and top[c] >= 0:
            names.setdefault(top[c], int(nodes["node"].iloc[i]))
    first = merging.first
    return pd.DataFrame({
        "candidate": least, "node": nodes["node"],
        "label": pd.array([names[top[c]] if c >= 0 and top[c] >= 0 else None for c in first], dtype="Int64"),
        "exemplar": [c >= 0 and merging.leaf[c] and merging.joined[i] == merging.born[c] for i, c in enumerate(first)],
    })


@dataclass
class _State:
    """What the steps carry: components, edges between them, and the component and first cluster of each point."""

    nodes: DataFrame
    edges: DataFrame
    members: DataFrame
    #: Clusters that ended in each step, with their parents.
    ended: list[DataFrame]


def _step(state: _State, level: int, components: Callable[[DataFrame], DataFrame]) -> _State:
    """Merges all components that edges of length ``level`` join."""
    here, step = density(F.lit(level)), len(state.ended)
    now = state.edges.where(F.col("level") == level).withColumn("hub", F.struct("candidate", "a", "b"))
    ends = [now.select(F.struct("candidate", F.col(end).alias("id")).alias("node"), "hub") for end in ("a", "b")]
    found = materialize(components(materialize(ends[0].unionByName(ends[1]), "level-edges")), "level-components")
    found = found.select("node.candidate", F.col("node.id").alias("node"), F.col("component.id").alias("to"))
    key = ["candidate", "node"]
    living = F.col("cluster").isNotNull()
    ending = F.when(living, F.col("mass") - F.col("weight") * here)
    moved, fresh = state.nodes.join(found, key), living & (F.col("since") == level)  # what begins here is part of what is born here
    moved = materialize(moved.withColumn("void", F.when(fresh, F.col("cluster"))).withColumns({c: F.when(~F.coalesce(fresh, F.lit(False)), F.col(c)) for c in ("cluster", "mass", "below")}).withColumn("ending", ending), "moved")
    merged = moved.groupBy("candidate", "to").agg(
        F.sum("weight").alias("weight"), F.count("cluster").alias("living"), F.max("cluster").alias("own"), F.max("mass").alias("own_mass"),
        F.max("below").alias("own_below"), F.max(F.when(living, F.col("weight"))).alias("own_weight"), F.sum(F.greatest("ending", "below")).alias("split"),
    )
    total, new = F.col("weight") * here, F.concat(F.col("to").cast("string"), F.lit(f"@{step}"))
    one, several, birth = F.col("living") == 1, F.col("living") > 1, (F.col("living") == 0) & (F.col("weight") >= F.col("candidate"))
    merged = merged.select(
        "candidate", F.col("to").alias("node"), "weight",
        F.when(one, F.col("own")).when(several | birth, new).alias("cluster"),
        F.when(one, F.col("own_mass") + (F.col("weight") - F.col("own_weight")) * here).when(several | birth, total).alias("mass"),
        F.when(one, F.col("own_below")).when(several, F.col("split")).when(birth, F.lit(0.0)).alias("below"), F.lit(level).cast("long").alias("since"),
        birth.alias("birth"), several.alias("several"),
    )
    merged = materialize(merged, "merged")
    parents = merged.where("several").select("candidate", F.col("node").alias("to"), F.col("cluster").alias("parent"))
    ended = moved.where(living).join(parents, ["candidate", "to"]).select("candidate", "cluster", "parent", (F.col("ending") >= F.col("below")).alias("head"))
    nodes = state.nodes.join(found.select(*key), key, "left_anti").unionByName(merged.drop("birth", "several"))
    after = merged.select("candidate", F.col("node").alias("to"), F.col("cluster").alias("joins"), "birth")
    gone = moved.where("void is not null").select("candidate", F.col("void").alias("cluster"), F.lit(True).alias("gone"))
    members = state.members.join(gone, ["candidate", "cluster"], "left").join(found, key, "left").join(after, ["candidate", "to"], "left")
    first = F.when(F.col("gone").isNull(), F.col("cluster"))
    members = members.select(
        "candidate", "point", F.coalesce("to", "node").alias("node"), F.coalesce(first, "joins").alias("cluster"),
        F.when(first.isNull(), F.coalesce("birth", F.lit(False))).otherwise(F.col("exemplar")).alias("exemplar"),
    )
    edges = state.edges.where(F.col("level") > level)
    for end in ("a", "b"):
        names = found.select("candidate", F.col("node").alias(end), "to")
        edges = edges.join(names, ["candidate", end], "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return _State(
        materialize(nodes, "components"), materialize(edges.where("a <> b").distinct(), "forest"), materialize(members, "members"),
        [*state.ended, materialize(ended, "ended-clusters")],
    )


def choose(points: DataFrame, forest: DataFrame, components: Callable[[DataFrame], DataFrame], most_nodes: int = 200_000) -> DataFrame:
    """``candidate, point, label, exemplar``: the chosen cluster of each point (null: none), and whether it was there at the birth of a leaf.

    ``points`` has ``candidate, point, weight, core`` (null: too few traces), ``forest`` is ``candidate, a, b, level``.
    ``components`` finds the connected components of ``(node, hub)``.
    """
    live = points.where("core is not null")
    whole = F.col("weight") >= F.col("candidate")
    start = live.select(
        "candidate", F.col("point").alias("node"), "weight", F.when(whole, F.concat(F.col("point").cast("string"), F.lit("@"))).alias("cluster"),
        F.when(whole, F.col("weight") * density(F.col("core"))).alias("mass"), F.when(whole, F.lit(0.0)).alias("below"), F.col("core").alias("since"),
    )
    nodes = materialize(start, "components")
    members = nodes.select("candidate", F.col("node").alias("point"), "node", "cluster", F.col("cluster").isNotNull().alias("exemplar"))
    state = _State(nodes, forest, members, [])
    while True:
        largest = state.nodes.groupBy("candidate").count().agg(F.max("count")).first()[0] or 0
        level = state.edges.agg(F.min("level")).first()[0] if largest > most_nodes else None
        if level is None:
            break
        state = _step(state, level, components)
    stepped = bool(state.ended)
    found = state.nodes.groupBy("candidate").cogroup(state.edges.groupBy("candidate")).applyInPandas(_in_memory, RESULT)
    found = materialize(found, "chosen-clusters")
    labelled = state.members.join(found.select("candidate", "node", F.col("label").alias("of_node"), F.col("exemplar").alias("of_birth")), ["candidate", "node"])
    if not stepped:
        return labelled.select("candidate", "point", F.col("of_node").alias("label"), F.coalesce("of_birth", F.lit(False)).alias("exemplar"))
    resolved = state.nodes.where("cluster is not null").join(found, ["candidate", "node"]).select("candidate", "cluster", "label")
    for ended in reversed(state.ended):
        above = resolved.select("candidate", F.col("cluster").alias("parent"), F.col("label").alias("above"))
        own = F.when(F.col("head"), F.substring_index("cluster", "@", 1).cast("long"))
        resolved = materialize(resolved.unionByName(ended.join(above, ["candidate", "parent"]).select("candidate", "cluster", F.coalesce("above", own).alias("label"))), "resolved-clusters")
    return labelled.join(resolved, ["candidate", "cluster"], "left").select(
        "candidate", "point", F.when(F.col("cluster").isNull(), F.col("of_node")).otherwise(F.col("label")).alias("label"),
        F.when(F.col("cluster").isNull(), F.col("of_birth")).otherwise(F.col("exemplar")).alias("exemplar"),
    )
