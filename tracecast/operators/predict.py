"""Suffix prediction, once per distinct replay state of each model."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.operators.net import net
from tracecast.settings import Settings
from tracecast.storage import materialize

_GUESS_SCHEMA = (
    "model_id string, state string, suffix_guessed array<string>, n_pf_plus int, n_pf int, n_first int"
)


def _continue_states(states: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    if states.empty:
        return pd.DataFrame(columns=[c.split()[0] for c in _GUESS_SCHEMA.split(", ")])
    game = net(rules["tree"].iloc[0])
    learnt = {
        (operator, step, ctx): json.loads(choice)
        for operator, step, ctx, choice in zip(rules["operator"], rules["step"], rules["loop_ctx"], rules["choice"])
        if choice is not None
    }
    rows = []
    for model_id, state in zip(states["model_id"], states["state"]):
        guessed, source = game.suffix(state, learnt)
        rows.append((model_id, state, guessed, source["pf+"], source["pf"], source["first"]))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _GUESS_SCHEMA.split(", ")])


def continue_states(states: DataFrame, models: DataFrame, table: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Guessed suffix and decision sources per ``(model_id, state)``.

    States meet their model's rules in co-grouped tasks. A model with many states is
    split over as many groups as its count asks for, each with a copy of the rules.
    """
    distinct = states.select("model_id", "state").distinct()
    # One row per model, written so that its size decides how it is joined to the states.
    groups = materialize(
        distinct.groupBy("model_id").agg(
            F.ceil(F.count(F.lit(1)) / settings.states_per_group).cast("int").alias("n_groups")
        ),
        "state-groups",
    )
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salted = distinct.join(groups, "model_id").select(
        "model_id", "state", F.pmod(F.xxhash64("state"), F.col("n_groups")).cast("int").alias("salt")
    )
    # The tree rides on a first row without a rule, so that a model that learnt nothing is still there.
    rules = models.select(
        "model_id", "tree", F.lit(-1).alias("operator"), F.lit(-1).alias("step"), F.lit(None).cast("string").alias("loop_ctx"),
        F.lit(None).cast("string").alias("choice"),
    ).unionByName(
        table.select(
            "model_id", F.lit(None).cast("string").alias("tree"), "operator", F.coalesce("step", F.lit(-1)).alias("step"),
            "loop_ctx", F.to_json("choice").alias("choice"),
        )
    )
    copied = rules.join(groups, "model_id").select(
        *rules.columns, F.explode(F.sequence(F.lit(0), F.col("n_groups") - 1)).alias("salt")
    )
    return (
        salted.repartition(parts, "model_id", "salt")
        .groupBy("model_id", "salt")
        .cogroup(copied.repartition(parts, "model_id", "salt").groupBy("model_id", "salt"))
        .applyInPandas(_with_tree_first, _GUESS_SCHEMA)
    )


def _with_tree_first(states: pd.DataFrame, rules: pd.DataFrame) -> pd.DataFrame:
    rules = rules.sort_values("tree", na_position="last", kind="stable").astype(object)
    return _continue_states(states, rules.where(rules.notna(), None))
