"""Training, prediction and evaluation of suffix models."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.functions.sequences import fingerprint, only_value, to_text
from tracecast.functions.similarity import score_pairs
from tracecast.operators.decisions import decision_counts, decision_table
from tracecast.operators.footprint import footprint
from tracecast.operators.predict import continue_states
from tracecast.operators.replay import prefix_states, replay
from tracecast.operators.traces import suffix_of, trainable, variants
from tracecast.operators.tree import tree_nodes
from tracecast.settings import Settings
from tracecast.storage import materialize, never_broadcast

MAIN = "0_0"


@dataclass(frozen=True)
class SuffixModel:
    """Trees and decision rules of one or more models, keyed by ``model_id``."""

    models: DataFrame
    nodes: DataFrame
    rules: DataFrame
    settings: Settings = field(default_factory=Settings)

    def predict(self, sequences: DataFrame) -> DataFrame:
        """Suffixes for ``model_id, variant_id, acts, lengths``.

        Returns ``(model_id, variant_id, length, suffix_guessed, n_pf_plus, n_pf, n_first)``.
        """
        states = materialize(prefix_states(sequences, self.models), "states")
        guesses = continue_states(states, self.models, self.rules, self.settings)
        return states.join(never_broadcast(guesses), ["model_id", "state"]).drop("state")

    def predict_one(self, prefix: Sequence[str], model_id: str = MAIN) -> list[str]:
        spark = self.models.sparkSession
        row = spark.createDataFrame(
            [(model_id, 0, list(prefix), [len(prefix)])],
            "model_id string, variant_id bigint, acts array<string>, lengths array<int>",
        )
        return self.predict(row).first()["suffix_guessed"]


def fit(train: DataFrame, models: DataFrame, settings: Settings = Settings()) -> SuffixModel:
    """Learns decision rules on given trees from ``(model_id, case_id, acts)``, or from
    variants already counted: ``(model_id, variant_id, acts, n_traces)``.

    Replay runs once per distinct variant. What it leaves behind, the decision counts
    and the rules, is small and read often, so it is written out.
    """
    nodes = materialize(tree_nodes(models), "nodes")
    counted = train if "n_traces" in train.columns else variants(train, "model_id")
    counts = materialize(decision_counts(footprint(replay(counted, models), nodes)), "decision-counts")
    return SuffixModel(models, nodes, materialize(decision_table(counts, nodes), "rules"), settings)


def distinct_sequences(test: DataFrame) -> DataFrame:
    """Written table of the sequences that have a prefix to predict from."""
    return materialize(variants(trainable(test)).where(F.size("acts") >= 3), "sequences")


def variant_lines(distinct: DataFrame, model: SuffixModel, model_id: str = MAIN) -> DataFrame:
    """Predictions per distinct sequence and length, both similarities included."""
    sequences = distinct.select(
        F.lit(model_id).alias("model_id"), "variant_id", "acts", F.sequence(F.lit(2), F.size("acts") - 1).alias("lengths")
    )
    guessed = model.predict(sequences).join(never_broadcast(distinct.select("variant_id", "acts")), "variant_id")
    return score_pairs(materialize(guessed.withColumn("suffix", suffix_of("acts", "length")), "guessed"))


def prediction_lines(test: DataFrame, model: SuffixModel, model_id: str = MAIN, candidate: int = 0) -> DataFrame:
    """One line per test prefix of every case."""
    distinct = distinct_sequences(test)
    scored = variant_lines(distinct, model, model_id)
    return case_lines(test, distinct, scored.withColumn("candidate", F.lit(candidate)))


def case_lines(test: DataFrame, distinct: DataFrame, scored: DataFrame) -> DataFrame:
    """Gives every case the lines of its sequence."""
    ids = distinct.groupBy(fingerprint("acts").alias("sequence")).agg(only_value("variant_id").alias("variant_id"))
    cases = test.select("case_id", fingerprint("acts").alias("sequence")).join(never_broadcast(ids), "sequence").select("case_id", "variant_id")
    prefix = F.slice("acts", 1, F.col("length"))
    return cases.join(never_broadcast(scored), "variant_id").select(
        "case_id",
        "length",
        prefix.alias("prefix"),
        to_text(prefix).alias("prefix_text"),
        "suffix_guessed",
        "suffix",
        "damerau_similarity",
        "levenshtein_similarity",
        "candidate",
        "n_pf_plus",
        "n_pf",
        "n_first",
    )
