"""Footprint: every branching decision of every replayed variant, as tall rows.

Counters are running sums. A loop's redo starts a new epoch for every And and
XorLoop below it, so a counter is the sum of its increments within the epoch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracecast.operators import tree as T
from tracecast.operators.tree import parent_type
from tracecast.storage import dealt, materialize


def _ancestors(kind: str):
    return F.filter("above", lambda a: a["type"] == kind)


def _effect(transition, counter, inc=0, reset=0, operator=None, kind=None, value=None, level=None):
    fields = {
        "transition": (transition, "int"), "counter": (counter, "int"), "inc": (inc, "int"), "reset": (reset, "int"),
        "operator": (operator, "int"), "kind": (kind, "string"), "value": (value, "int"), "level": (level, "int"),
    }
    column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[column(v).cast(t).alias(name) for name, (v, t) in fields.items()])


def _moves():
    """How a node's transitions move the counters."""
    task = F.col("node_id") * 2
    leaf, counted = F.col("type").isin("task", "tau"), F.col("type").isin("And", "XorLoop")
    none = F.filter(F.array(_effect(task, -1)), lambda e: F.lit(False))
    steps = F.transform(_ancestors("And"), lambda a: _effect(task, a["id"], inc=1))
    repeats = F.array(_effect(F.col("entry"), F.col("parent_id"), inc=1))
    restarts = F.transform(_ancestors("XorLoop"), lambda a: _effect(a["redo"], F.col("node_id"), reset=1))
    return F.concat(
        F.when(leaf, steps).otherwise(none),
        F.when((F.size("above") > 0) & (parent_type() == "XorLoop") & (F.col("child_ix") == 1), repeats).otherwise(none),
        F.when(counted, restarts).otherwise(none),
    )


def _reads(transition, operator, kind: str, value, level):
    """A decision, once per counter it reads: its own (``level`` -1: the And step or the
    loop count) and those of the enclosing loops. Xor has none of its own: counter -1."""
    own = _effect(transition, operator if kind != "Xor" else -1, operator=operator, kind=kind, value=value, level=-1)
    around = F.filter("above", lambda a, i: (a["type"] == "XorLoop") & (i < level))
    return F.concat(
        F.array(own),
        F.transform(
            around, lambda a, i: _effect(transition, a["id"], operator=operator, kind=kind, value=value, level=i)
        ),
    )


def _decisions():
    """What firing a node's transitions decides: the branch for And, the child's first
    transition for Xor, and for XorLoop, on leaving, its counter."""
    task, entry, parent, last = F.col("node_id") * 2, F.col("entry"), F.col("parent_id"), F.size("above") - 1
    none = F.filter(_reads(task, parent, "Xor", entry, last), lambda e: F.lit(False))
    indexed = F.transform("above", lambda a, i: F.struct(a["id"].alias("id"), a["type"].alias("type"), a["branch"].alias("branch"), i.alias("i")))
    ands = F.filter(indexed, lambda a: a["type"] == "And")
    branches = F.flatten(F.transform(ands, lambda a: _reads(task, a["id"], "And", a["branch"], a["i"])))
    has_parent = F.size("above") > 0
    return F.concat(
        F.when(F.col("type").isin("task", "tau"), branches).otherwise(none),
        F.when(has_parent & (parent_type() == "Xor"), _reads(entry, parent, "Xor", entry, last)).otherwise(none),
        F.when(
            has_parent & (parent_type() == "XorLoop") & (F.col("child_ix") == 2),
            _reads(entry, parent, "XorLoop", None, last),
        ).otherwise(none),
    )


def transition_effects(nodes: DataFrame) -> DataFrame:
    """Counter moves and decisions of every transition, from one pass over the nodes."""
    return nodes.select("model_id", F.explode(F.concat(_moves(), _decisions())).alias("e")).select("model_id", "e.*")


def _with_counts(touched: DataFrame) -> DataFrame:
    """Adds ``count``, the counter's value after the row; moves come before the decisions of one firing."""
    along = Window.partitionBy("model_id", "variant_id", "counter").orderBy("pos", F.col("operator").isNotNull())
    upto = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = (
        Window.partitionBy("model_id", "variant_id", "counter", "epoch")
        .orderBy("pos", F.col("operator").isNotNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return touched.withColumn("epoch", F.sum("reset").over(upto)).withColumn("count", F.sum("inc").over(within))


def _tall(replayed: DataFrame) -> DataFrame:
    """Fired transitions, laid out so that the windows below need no further shuffle; as many partitions as there are transitions to sort."""
    replayed = materialize(replayed.select("model_id", "variant_id", "n_traces", "fired"), "fired")
    return dealt(replayed, F.size("fired"), "model_id", "variant_id").select(
        "model_id", "variant_id", "n_traces", F.posexplode("fired").alias("pos", "transition")
    )


def counters(replayed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(model_id, variant_id, pos, operator, count)`` after each transition that moves a counter."""
    moves = transition_effects(nodes).where("operator is null")
    touched = _tall(replayed).join(moves, ["model_id", "transition"])
    return _with_counts(touched).select(
        "model_id", "variant_id", "pos", F.col("counter").alias("operator"), F.col("count").cast("bigint").alias("count")
    )


def footprint(replayed: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(model_id, variant_id, n_traces, operator, kind, step, loop_ctx, value)``.

    ``step`` is set for And only. A feature met twice in a variant keeps its last value.
    """
    touched = _tall(replayed).join(transition_effects(nodes), ["model_id", "transition"])
    read = _with_counts(touched).where("operator is not null")
    loops = F.array_sort(F.collect_list(F.when(F.col("level") >= 0, F.struct("level", "counter", "count"))))
    ctx = F.transform(loops, lambda l: F.concat(F.lit("[XorLoop"), l["counter"], F.lit("]{"), l["count"], F.lit("}")))
    own = F.max(F.when(F.col("level") == -1, F.col("count")))
    made = read.groupBy("model_id", "variant_id", "pos", "operator", "kind", "value").agg(
        F.first("n_traces").alias("n_traces"), F.array_join(ctx, "").alias("loop_ctx"), own.alias("own")
    )
    return (
        made.select(
            "*",
            F.when(F.col("kind") == "And", F.col("own")).cast("int").alias("step"),
            F.when(F.col("kind") == "XorLoop", F.col("own")).otherwise(F.col("value")).cast("bigint").alias("seen"),
        )
        .groupBy("model_id", "variant_id", "operator", "kind", "step", "loop_ctx")
        .agg(F.first("n_traces").alias("n_traces"), F.max_by("seen", "pos").alias("value"))
        .select("model_id", "variant_id", "n_traces", "operator", "kind", "step", "loop_ctx", "value")
    )


def named(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """Footprint or decision-count rows with operator names and, for Xor, the chosen transition's name."""
    operators = nodes.select("model_id", F.col("node_id").alias("operator"), F.col("shortname").alias("operator_name"))
    chosen = T.transitions(nodes).select("model_id", F.col("transition").alias("value"), F.col("name").alias("chosen"))
    value = F.when(F.col("kind") == "Xor", F.col("chosen")).otherwise(F.col("value").cast("string"))
    return (
        rows.join(operators, ["model_id", "operator"])
        .join(chosen, ["model_id", "value"], "left")
        .withColumn("value", value)
        .drop("operator", "chosen")
        .withColumnRenamed("operator_name", "operator")
    )


def feature_names(named_rows: DataFrame) -> DataFrame:
    """Adds the display name ``operator(step)|loop{count}...``."""
    step = F.coalesce(F.concat(F.lit("("), F.col("step"), F.lit(")")), F.lit(""))
    return named_rows.withColumn("feature", F.concat("operator", step, F.lit("|"), "loop_ctx"))
