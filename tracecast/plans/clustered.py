"""Clustered run: one suffix model per group of similar traces, granularity chosen on a validation set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.functions.similarity import score_pairs
from tracecast.operators import cluster as C
from tracecast.operators.discover import discover
from tracecast.operators.router import Router, route, train_router
from tracecast.operators.traces import suffix_of, variants
from tracecast.plans.suffix_model import MAIN, SuffixModel, case_lines, distinct_sequences, fit, variant_lines
from tracecast.settings import Settings
from tracecast.storage import materialize


@dataclass(frozen=True)
class ClusteredModel:
    clustering: C.Clustering
    chosen: DataFrame
    model: SuffixModel
    router: Router | None
    settings: Settings


def model_name(candidate, cluster_id):
    return F.concat_ws("_", F.col(candidate).cast("string"), F.col(cluster_id).cast("string"))


def fit_clustered(train: DataFrame, settings: Settings = Settings()) -> ClusteredModel:
    """Clusters, trees from the strong members, rules from the weak ones, and the router.

    All candidates and clusters are trained together, keyed by ``<candidate>_<cluster>``.
    If no candidate has two clusters, one model of all training traces takes their place.
    """
    clustering = C.cluster_traces(train, settings)
    chosen = C.representatives(clustering.memberships, settings).join(clustering.variants.select("variant_id", "acts"), "variant_id")
    chosen = materialize(chosen.withColumn("model_id", model_name("candidate", "cluster_id")), "representatives")
    if chosen.isEmpty():
        whole = variants(train).withColumn("model_id", F.lit(MAIN))
        models = materialize(discover(whole.select("model_id", "acts", "n_traces"), settings), "models")
        model = fit(train.withColumn("model_id", F.lit(MAIN)), models, settings)
        return ClusteredModel(clustering, chosen, model, None, settings)
    build = chosen.where("is_build").select("model_id", "acts", F.lit(1).cast("bigint").alias("n_traces"))
    models = materialize(discover(build, settings), "models")
    model = fit(chosen.where("is_training").select("model_id", "variant_id", "acts", "n_traces"), models, settings)
    longest = train.agg(F.max(F.size("acts"))).first()[0]
    labelled = C.hard_labels(clustering.memberships).join(clustering.variants, "variant_id")
    router = train_router(labelled.select("candidate", "cluster_id", "variant_id", "acts"), longest, settings)
    return ClusteredModel(clustering, chosen, model, router, settings)


def routed_lines(distinct: DataFrame, fitted: ClusteredModel, candidate: int | None = None) -> DataFrame:
    """Scored predictions per candidate, distinct sequence and length; one candidate only when given."""
    distinct = distinct.select("variant_id", "acts", "n_traces")
    routed = route(distinct.select("variant_id", "acts"), fitted.router, fitted.settings)
    if candidate is not None:
        routed = routed.where(F.col("candidate") == candidate)
    routed = materialize(routed.withColumn("model_id", model_name("candidate", "cluster_id")), "routed")
    sequences = (
        routed.groupBy("model_id", "variant_id")
        .agg(F.array_sort(F.collect_set("length")).alias("lengths"))
        .join(distinct.select("variant_id", "acts"), "variant_id")
    )
    guessed = (
        fitted.model.predict(sequences)
        .join(routed, ["model_id", "variant_id", "length"])
        .join(distinct, "variant_id")
    )
    return score_pairs(materialize(guessed.withColumn("suffix", suffix_of("acts", "length")), "guessed"))


def candidate_scores(validation: DataFrame, fitted: ClusteredModel) -> DataFrame:
    """Mean similarity per candidate over the validation prefixes."""
    lines = routed_lines(distinct_sequences(validation), fitted)
    weighted = F.sum(F.col("damerau_similarity") * F.col("n_traces")) / F.sum("n_traces")
    return lines.groupBy("candidate").agg(F.round(weighted, 12).alias("score"), F.sum("n_traces").alias("n_prefixes"))


def best_candidate(scores: DataFrame) -> DataFrame:
    """Candidate with the best score, the smallest on ties."""
    return scores.agg(F.max_by("candidate", F.struct("score", -F.col("candidate"))).alias("candidate"), F.max("score").alias("score"))


def clustered_lines(test: DataFrame, validation: DataFrame, fitted: ClusteredModel) -> DataFrame:
    """Prediction lines of the test cases on the chosen candidate's models."""
    distinct = distinct_sequences(test)
    if fitted.router is None:
        lines = variant_lines(distinct, fitted.model).withColumn("candidate", F.lit(0))
    else:
        best = best_candidate(candidate_scores(validation, fitted)).first()["candidate"]
        if best is None:  # no validation prefix: the finest granularity that has clusters
            best = fitted.chosen.agg(F.min("candidate")).first()[0]
        lines = routed_lines(distinct, fitted, best)
    return case_lines(test, distinct, lines)
