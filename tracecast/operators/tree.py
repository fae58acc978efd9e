"""Process trees as rows, and the lookup tables the footprint needs.

Every node carries its ancestors, so each lookup table is an explode and a filter.

Transitions are numbered ``2 * node_id`` (a task, a silent step, or the first
transition of an operator) and ``2 * node_id + 1`` (the operator's ``end_`` one).
Being numbered by node, two tasks with the same label stay apart.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = (
    "model_id string, node_id int, parent_id int, child_ix int, type string, label string, "
    "shortname string, depth int, path array<int>, entry int, "
    "above array<struct<id: int, type: string, branch: int, redo: int>>"
)


def walk(tree) -> list[dict]:
    """Nodes of a tree in pre-order; ``path`` lists the ancestors and the node itself.

    ``above`` describes the ancestors, outermost first: the child taken below each
    and, for a loop, the first transition of its redo branch.
    """
    nodes: list[dict] = []

    def visit(node, parent: dict | None, child_ix: int) -> dict:
        kind = "tau" if node is None else "task" if isinstance(node, str) else node[0]
        me = {
            "node_id": len(nodes),
            "parent_id": parent["node_id"] if parent else -1,
            "child_ix": child_ix,
            "type": kind,
            "label": node if kind == "task" else None,
            "shortname": node if kind == "task" else f"[{kind}{len(nodes)}]",
            "depth": parent["depth"] + 1 if parent else 0,
            "path": [*(parent["path"] if parent else []), len(nodes)],
        }
        nodes.append(me)
        kids = [visit(kid, me, ix) for ix, kid in enumerate(node[1:])] if isinstance(node, list) else []
        # First transition that fires on entering the node.
        if kind == "Seq":
            me["entry"] = kids[0]["entry"]
        else:
            me["entry"] = 2 * me["node_id"] + (kind == "XorLoop")
        if kind == "XorLoop":
            me["redo"] = kids[1]["entry"]
        return me

    visit(tree, None, 0)
    for node in nodes:
        ancestors = [nodes[i] for i in node["path"]]
        node["above"] = [
            {"id": a["node_id"], "type": a["type"], "branch": below["child_ix"], "redo": a.get("redo")}
            for a, below in zip(ancestors, ancestors[1:])
        ]
    return nodes


def _node_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = NODE_SCHEMA.split(", above")[0].replace(",", " ").split()[::2] + ["above"]
    for batch in batches:
        for model_id, tree in zip(batch["model_id"], batch["tree"]):
            yield pd.DataFrame(walk(json.loads(tree))).assign(model_id=model_id)[columns]


def tree_nodes(models: DataFrame) -> DataFrame:
    """One row per node of every model."""
    return models.select("model_id", "tree").mapInPandas(_node_rows, NODE_SCHEMA)


def alphabet(nodes: DataFrame) -> DataFrame:
    """Activities each model knows."""
    return nodes.where("type = 'task'").select("model_id", F.col("label").alias("activity")).distinct()


def transitions(nodes: DataFrame) -> DataFrame:
    """``(model_id, transition, name, visible)``."""
    opening = nodes.where("type <> 'Seq'").select(
        "model_id",
        (F.col("node_id") * 2).alias("transition"),
        F.col("shortname").alias("name"),
        (F.col("type") == "task").alias("visible"),
    )
    ending = nodes.where("type in ('Xor', 'And', 'XorLoop')").select(
        "model_id",
        (F.col("node_id") * 2 + 1).alias("transition"),
        F.concat(F.lit("end_"), "shortname").alias("name"),
        F.lit(False).alias("visible"),
    )
    return opening.unionByName(ending)


def _leaf() -> Column:
    return F.col("type").isin("task", "tau")


def _exploded(nodes: DataFrame, ancestor_type: str) -> DataFrame:
    """One row per node and ancestor of the given type, with the ancestor's level."""
    return nodes.select("*", F.posexplode("above").alias("level", "up")).where(F.col("up.type") == ancestor_type)


def and_branches(nodes: DataFrame) -> DataFrame:
    """``(model_id, and_id, branch, node_id, type)``: every node below an And, with its branch."""
    return _exploded(nodes, "And").select("model_id", F.col("up.id").alias("and_id"), "up.branch", "node_id", "type")


def branch_sizes(nodes: DataFrame) -> DataFrame:
    """Nodes per And branch, all types, branch root included."""
    return and_branches(nodes).groupBy("model_id", "and_id", "branch").agg(F.count(F.lit(1)).alias("n_nodes"))


def enclosing_loops(nodes: DataFrame) -> DataFrame:
    """``(model_id, node_id, type, loop_id, level)``: loops around a node, itself excluded."""
    return _exploded(nodes, "XorLoop").select("model_id", "node_id", "type", F.col("up.id").alias("loop_id"), "level")


def loop_dependents(nodes: DataFrame) -> DataFrame:
    """And and XorLoop nodes whose counters restart when the loop repeats."""
    return enclosing_loops(nodes).where("type in ('And', 'XorLoop')").select(
        "model_id", "loop_id", F.col("node_id").alias("operator")
    )


def parent_type() -> Column:
    return F.try_element_at("above", F.lit(-1))["type"]


def _child_entries(nodes: DataFrame, which: Column) -> DataFrame:
    return nodes.where((F.size("above") > 0) & which).select(
        "model_id", F.col("entry").alias("transition"), F.col("parent_id").alias("operator")
    )


def xor_children(nodes: DataFrame) -> DataFrame:
    """First transition of each Xor child."""
    return _child_entries(nodes, parent_type() == "Xor")


def loop_redos(nodes: DataFrame) -> DataFrame:
    """First transition of each redo branch."""
    return _child_entries(nodes, (parent_type() == "XorLoop") & (F.col("child_ix") == 1))


def loop_exits(nodes: DataFrame) -> DataFrame:
    """First transition of each exit branch."""
    return _child_entries(nodes, (parent_type() == "XorLoop") & (F.col("child_ix") == 2))


def memberships(nodes: DataFrame) -> DataFrame:
    """All lookup tables stacked: ``(model_id, kind, node, operator, detail)`` by name."""
    names = nodes.select("model_id", F.col("node_id").alias("operator_id"), F.col("shortname").alias("operator"))
    nodes_named = nodes.select("model_id", "node_id", F.col("shortname").alias("node"))
    fired_named = transitions(nodes).select("model_id", "transition", F.col("name").alias("node"))

    def by_node(rows: DataFrame, kind: str, operator: str, detail: Column) -> DataFrame:
        return rows.select(
            "model_id", "node_id", F.col(operator).alias("operator_id"), F.lit(kind).alias("kind"),
            detail.cast("bigint").alias("detail"),
        ).join(nodes_named, ["model_id", "node_id"])

    def by_transition(rows: DataFrame, kind: str) -> DataFrame:
        return rows.select(
            "model_id", "transition", F.col("operator").alias("operator_id"), F.lit(kind).alias("kind"),
            F.lit(None).cast("bigint").alias("detail"),
        ).join(fired_named, ["model_id", "transition"])

    dependents = loop_dependents(nodes).select("model_id", F.col("operator").alias("node_id"), "loop_id")
    parts = [
        by_node(and_branches(nodes), "and_branch", "and_id", F.col("branch")),
        by_node(enclosing_loops(nodes), "loop_around", "loop_id", F.col("level")),
        by_node(dependents, "loop_dependent", "loop_id", F.lit(None)),
        by_transition(xor_children(nodes), "xor_child"),
        by_transition(loop_redos(nodes), "loop_redo"),
        by_transition(loop_exits(nodes), "loop_exit"),
    ]
    stacked = None
    for part in parts:
        rows = part.join(names, ["model_id", "operator_id"]).select("model_id", "kind", "node", "operator", "detail")
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


def lowest_common_ancestors(nodes: DataFrame) -> DataFrame:
    """``(model_id, node_1, node_2, ancestor, level)`` for every pair of leaves of one tree.

    ``level`` is the depth at which the two paths part. Pairs meet through the
    ancestors they share, so only nodes of one model ever meet.
    """
    leaves = nodes.where("type in ('task', 'tau')").select(
        "model_id", "node_id", F.posexplode("path").alias("depth", "ancestor")
    )
    left = leaves.withColumnRenamed("node_id", "node_1")
    right = leaves.select("model_id", F.col("node_id").alias("node_2"), "ancestor")
    return (
        left.join(right, ["model_id", "ancestor"])
        .where("node_1 < node_2")
        .groupBy("model_id", "node_1", "node_2")
        .agg(F.max_by("ancestor", "depth").alias("ancestor"), (F.max("depth") + 1).alias("level"))
    )
