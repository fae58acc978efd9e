"""Replay of sequences on their model: conformance of a log table with a model table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.operators.net import START, net
from tracecast.storage import materialize

_FIRED = "fired array<int>, n_skipped int"


def _fields(columns: str, rows: DataFrame) -> str:
    return ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in columns.split())


def _replay_complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        fired_all, skipped_all = [], []
        for tree, acts in zip(batch["tree"], batch["acts"]):
            game, marking, fired, skipped = net(tree), frozenset([START]), [], 0
            for activity in [*acts, None]:
                moved = game.move(marking, activity)
                if moved is None:
                    skipped += 1
                else:
                    fired += moved[0]
                    marking = moved[1]
            fired_all.append(fired)
            skipped_all.append(skipped)
        yield batch[["model_id", "variant_id", "n_traces"]].assign(fired=fired_all, n_skipped=skipped_all)


def replay(variant_rows: DataFrame, models: DataFrame) -> DataFrame:
    """``(model_id, variant_id, n_traces, fired, n_skipped)``, one row per distinct variant and model.

    ``variant_rows`` has ``model_id, variant_id, acts, n_traces``. ``fired`` holds the
    transitions, silent and unobserved ones included; an activity the model cannot
    play is skipped whole and counted.
    """
    # Written first: a model id that is one literal would make this a join without a key.
    rows = materialize(variant_rows, "variants").join(models.select("model_id", "tree"), "model_id")
    schema = _fields("model_id variant_id n_traces", variant_rows) + ", " + _FIRED
    return rows.select("model_id", "variant_id", "n_traces", "acts", "tree").mapInPandas(_replay_complete, schema)


def fired_transitions(replayed: DataFrame) -> DataFrame:
    """Tall form: ``(model_id, variant_id, n_traces, pos, transition)``."""
    return replayed.select("model_id", "variant_id", "n_traces", F.posexplode("fired").alias("pos", "transition"))


def _replay_prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        states_all = []
        for tree, acts, lengths in zip(batch["tree"], batch["acts"], batch["lengths"]):
            game, marking = net(tree), frozenset([START])
            counters, wanted, states = game.new_counters(), set(lengths), []
            if 0 in wanted:
                states.append({"length": 0, "state": game.write_state(marking, counters)})
            for length, activity in enumerate(acts[: max(wanted, default=0)], start=1):
                moved = game.move(marking, activity)
                if moved is not None:
                    marking = moved[1]
                    for t in moved[0]:
                        game.count(counters, t)
                if length in wanted:
                    states.append({"length": length, "state": game.write_state(marking, counters)})
            states_all.append(states)
        yield batch[["model_id", "variant_id"]].assign(states=states_all)


def prefix_states(sequences: DataFrame, models: DataFrame) -> DataFrame:
    """``(model_id, variant_id, length, state)`` for the wanted prefix lengths of each sequence.

    ``sequences`` has ``model_id, variant_id, acts, lengths``. One replay serves every
    prefix of a sequence, so the cost is linear in its length. ``state`` is the marking
    and the operator counters; equal states have equal continuations.
    """
    rows = materialize(sequences, "sequences").join(models.select("model_id", "tree"), "model_id")
    schema = _fields("model_id variant_id", sequences) + ", states array<struct<length: int, state: string>>"
    return (
        rows.select("model_id", "variant_id", "acts", "lengths", "tree")
        .mapInPandas(_replay_prefixes, schema)
        .select("model_id", "variant_id", F.explode("states").alias("s"))
        .select("model_id", "variant_id", "s.length", "s.state")
    )


def visible_path(replayed: DataFrame, transition_names: DataFrame) -> DataFrame:
    """``(model_id, variant_id, pos, activity)``: fired transitions that are activities."""
    shown = transition_names.where("visible").select("model_id", "transition", F.col("name").alias("activity"))
    return fired_transitions(replayed).join(shown, ["model_id", "transition"]).select(
        "model_id", "variant_id", "pos", "activity"
    )
