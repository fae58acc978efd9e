"""Process-tree discovery: the inductive miner as one Spark job per tree level.

All open sublogs of all models advance together. Each level sums the log's local
patterns per sublog, picks a cut per sublog from those sums, and splits the log by
the cuts. Only sums bounded by the alphabet reach the cut step; traces never leave
the executors, and identical sub-traces are merged after every split.
"""

from __future__ import annotations

import itertools
import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.operators.cuts import Graph, find_cut
from tracecast.settings import Settings
from tracecast.storage import materialize

_CUT_SCHEMA = (
    "model_id string, node string, rule string, parts array<array<string>>, children array<string>, "
    "starts array<string>, ends array<string>, rows array<struct<node: string, type: string, label: string>>"
)


def _local_patterns(log: DataFrame) -> DataFrame:
    """Per sublog: neighbours of every run of one activity, repeats, presence, traces and empty traces.

    A run with its two neighbours gives the follows relation, and also the relation
    that remains when the run's activity is taken out of the log.
    """
    acts = F.col("acts")
    runs = F.filter(acts, lambda x, i: (i == 0) | (x != F.get(acts, i - 1)))
    repeats = F.filter(acts, lambda x, i: (i > 0) & (x == F.get(acts, i - 1)))

    def pattern(kind: str, a, before=None, after=None) -> Column:
        text = lambda c: (c if isinstance(c, Column) else F.lit(c)).cast("string")
        return F.struct(
            F.lit(kind).alias("kind"), text(a).alias("a"), text(before).alias("before"), text(after).alias("after")
        )

    runs_of = log.withColumn("runs", runs)
    patterns = F.concat(
        F.transform("runs", lambda x, i: pattern("run", x, F.when(i > 0, F.get("runs", i - 1)), F.get("runs", i + 1))),
        F.transform(repeats, lambda x: pattern("repeat", x)),
        F.transform(F.array_distinct(acts), lambda x: pattern("in", x)),
        F.array(F.when(F.size(acts) == 0, pattern("empty", None)).otherwise(pattern("trace", None))),
    )
    return (
        runs_of.select("model_id", "node", "w", F.explode(patterns).alias("p"))
        .groupBy("model_id", "node", "p.kind", "p.a", "p.before", "p.after")
        .agg(F.sum("w").alias("w"))
    )


def _graph(acts: list[str], pairs, starts, ends) -> Graph:
    index = {a: i for i, a in enumerate(acts)}
    follows = np.zeros((len(acts), len(acts)), dtype=bool)
    for a, b in pairs:
        follows[index[a], index[b]] = True
    is_in = lambda group: np.array([a in group for a in acts])
    return Graph(acts, follows, is_in(starts), is_in(ends))


def _without(a: str, acts: list[str], runs: list[tuple], repeats: dict) -> Graph:
    """Graph of the log with activity ``a`` taken out."""
    pairs = {(x, x) for x in repeats if x != a}
    starts, ends = set(), set()
    for before, x, after in runs:
        if x == a:
            pairs |= {(before, after)} if before and after else set()
            starts |= {after} if not before and after else set()
            ends |= {before} if before and not after else set()
            continue
        if after and after != a:
            pairs.add((x, after))
        starts |= set() if before else {x}
        ends |= set() if after else {x}
    return _graph([x for x in acts if x != a], pairs, starts, ends)


def _choose(node: str, sums: pd.DataFrame) -> dict:
    """Cut or fall-through of one sublog, as the instruction that splits it."""
    by_kind = {kind: rows for kind, rows in sums.groupby("kind")}
    none = sums.iloc[:0]
    total = lambda kind: int(by_kind.get(kind, none)["w"].sum())
    n_traces, n_empty = total("trace"), total("empty")
    run_rows = by_kind.get("run", none)
    runs = list(zip(run_rows["before"], run_rows["a"], run_rows["after"]))
    acts = sorted(set(run_rows["a"]))

    def split(rule: str, kind: str, parts: list[list[str]], children=None, rows=(), starts=(), ends=()) -> dict:
        return {
            "rule": rule,
            "parts": parts,
            "children": children or [f"{node}.{i}" for i in range(len(parts))],
            "starts": sorted(starts),
            "ends": sorted(ends),
            "rows": [{"node": node, "type": kind, "label": None}, *rows],
        }

    def leaf(kind: str, label: str | None = None) -> dict:
        return {"rule": "leaf", "parts": [], "children": [], "starts": [], "ends": [],
                "rows": [{"node": node, "type": kind, "label": label}]}

    tau = lambda i: {"node": f"{node}.{i}", "type": "tau", "label": None}
    if not acts:
        return leaf("tau")
    if n_empty:
        return split("Xor", "Xor", [acts], [f"{node}.1"], [tau(0)])
    repeats = dict(zip(by_kind["repeat"]["a"], by_kind["repeat"]["w"])) if "repeat" in by_kind else {}
    occurrences = run_rows.groupby("a")["w"].sum().to_dict()
    occurrences = {a: n + repeats.get(a, 0) for a, n in occurrences.items()}
    if len(acts) == 1 and occurrences[acts[0]] == n_traces:
        return leaf("task", acts[0])

    pairs = {(a, after) for _, a, after in runs if after} | {(a, a) for a in repeats}
    starts, ends = {a for before, a, _ in runs if not before}, {a for _, a, after in runs if not after}
    cut = find_cut(_graph(acts, pairs, starts, ends))
    if cut:
        rule, parts = cut
        if rule != "XorLoop":
            return split(rule, rule, parts)
        rows, children = [tau(2)], [f"{node}.0", f"{node}.1"]
        if len(parts) > 2:
            rows.append({"node": f"{node}.1", "type": "Xor", "label": None})
            children[1:] = [f"{node}.1.{i}" for i in range(len(parts) - 1)]
        return split(rule, rule, parts, children, rows)

    # Fall-throughs. An activity may be taken out by several of them; the last label of those
    # that occur once per trace, and the first label that leaves a cut, make the choice unique.
    present = dict(zip(by_kind["in"]["a"], by_kind["in"]["w"]))
    if len(acts) > 1:
        once = [a for a in acts if occurrences[a] == n_traces and present[a] == n_traces]
        opens = (a for a in acts if find_cut(_without(a, acts, runs, repeats)))
        freed = once[-1:] or list(itertools.islice(opens, 1))  # no further than the first that opens a cut
        if freed:
            return split("And", "And", [freed, [a for a in acts if a != freed[0]]])
    for rule, before_start in (("strict tau loop", ends), ("tau loop", set(acts))):
        if any(a in before_start and b in starts for a, b in pairs):
            return split(rule, "XorLoop", [acts], rows=[tau(1), tau(2)], starts=starts, ends=before_start)
    choices = [{"node": f"{node}.0.{i}", "type": "task", "label": a} for i, a in enumerate(acts)]
    flower = leaf("XorLoop")
    flower["rows"] += [{"node": f"{node}.0", "type": "Xor", "label": None}, *choices, tau(1), tau(2)]
    return flower


def _choose_cuts(patterns: DataFrame) -> DataFrame:
    def decide(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        sums = sums.astype(object).where(sums.notna(), None)
        return pd.DataFrame([{"model_id": key[0], "node": key[1], **_choose(key[1], sums)}])

    return patterns.groupBy("model_id", "node").applyInPandas(decide, _CUT_SCHEMA)


def _split(log: DataFrame, cuts: DataFrame) -> DataFrame:
    """Sub-traces of every open child, merged."""
    acts, parts, children = F.col("acts"), F.col("parts"), F.col("children")
    part_of = lambda x: F.array_position(F.transform(parts, lambda p: F.array_contains(p, x)), True)
    piece = lambda child, seq: F.struct(child.alias("node"), seq.alias("acts"))

    projected = F.transform(
        parts, lambda p, i: piece(F.get(children, i), F.filter(acts, lambda x: F.array_contains(p, x)))
    )
    whole = F.array(piece(F.get(children, part_of(F.get(acts, F.lit(0))).cast("int") - 1), acts))
    breaks = F.filter(
        F.sequence(F.lit(0), F.size(acts) - 1),
        lambda i: (i == 0)
        | F.when(F.col("rule") == "XorLoop", part_of(F.get(acts, i)) != part_of(F.get(acts, i - 1))).otherwise(
            F.array_contains("starts", F.get(acts, i)) & F.array_contains("ends", F.get(acts, i - 1))
        ),
    )
    with_breaks = log.join(cuts.where("rule <> 'leaf'"), ["model_id", "node"]).where(
        # The silent alternative of a log with empty traces takes them all.
        ~((F.col("rule") == "Xor") & (F.size("acts") == 0))
    ).withColumn("breaks", F.when(F.size("acts") > 0, breaks))
    segments = F.transform(
        "breaks",
        lambda s, k: piece(
            F.get(children, part_of(F.get(acts, s)).cast("int") - 1),
            F.slice(acts, s + 1, F.coalesce(F.get("breaks", k + 1), F.size(acts)) - s),
        ),
    )
    pieces = (
        F.when(F.col("rule") == "Xor", whole).when(F.col("rule").isin("Seq", "And"), projected).otherwise(segments)
    )
    return (
        with_breaks.select("model_id", "w", F.explode(pieces).alias("p"))
        .groupBy("model_id", "p.node", "p.acts")
        .agg(F.sum("w").alias("w"))
        .select("model_id", "node", "acts", "w")
    )


def _flat(tree):
    """Merges an operator into a parent of the same kind (not loops)."""
    if not isinstance(tree, list):
        return tree
    kids = []
    for kid in map(_flat, tree[1:]):
        kids += kid[1:] if isinstance(kid, list) and kid[0] == tree[0] != "XorLoop" else [kid]
    return [tree[0], *kids]


def _assemble(rows: pd.DataFrame) -> pd.DataFrame:
    by_parent: dict[str, list] = {}
    nodes = {r.node: r for r in rows.itertuples()}
    for node in nodes:
        by_parent.setdefault(node.rpartition(".")[0], []).append(node)

    def build(node: str):
        row = nodes[node]
        if row.type == "tau":
            return None
        if row.type == "task":
            return row.label
        kids = sorted(by_parent[node], key=lambda n: int(n.rpartition(".")[2]))
        return [row.type, *map(build, kids)]

    return pd.DataFrame({"model_id": [rows["model_id"].iloc[0]], "tree": [json.dumps(_flat(build("r")))]})


def discover(log: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(model_id, tree)`` for every model of ``(model_id, acts, n_traces)``."""
    log = materialize(
        log.groupBy("model_id", "acts").agg(F.sum("n_traces").alias("w")).select("model_id", F.lit("r").alias("node"), "acts", "w"),
        "discover-log",
    )
    levels: list[DataFrame] = []
    while True:
        cuts = materialize(_choose_cuts(_local_patterns(log)), "discover-cuts")
        levels.append(cuts.select("model_id", F.explode("rows").alias("r")).select("model_id", "r.*"))
        if cuts.where("rule <> 'leaf'").isEmpty():
            break
        log = materialize(_split(log, cuts), "discover-log")
    rows = levels[0]
    for level in levels[1:]:
        rows = rows.unionAll(level)
    return rows.groupBy("model_id").applyInPandas(_assemble, "model_id string, tree string")
