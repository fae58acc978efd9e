"""Routing of prefixes to clusters: one linear classifier per candidate and prefix length, on projected prefixes.

A classifier has one hinge-loss weight vector per cluster (one against the rest), fitted by stochastic gradients over
small batches. Each classifier sees a prefix of every labelled variant, unless ``router_rows`` asks for fewer; all
classifiers are fitted side by side, one group each. Scoring deals prefixes out in blocks, and multiplies
a block by the weights of all clusters of a classifier at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracecast.operators.ngrams import first_lengths
from tracecast.operators.svd import prefix_projections, svd_basis
from tracecast.settings import Settings
from tracecast.storage import materialize

#: Passes over the rows, rows of a batch, weight of the penalty.
_PASSES = 30
_BATCH = 16
_PENALTY = 1e-4
#: Prefixes multiplied at once.
_BLOCK = 1_000
#: Blocks that share a copy of their classifiers' weights.
_SHARING = 16


@dataclass(frozen=True)
class Router:
    """``models``: (candidate, length, clusters, weights), a row of weights and a bias per cluster; ``basis``: (gram, axis)."""

    models: DataFrame
    basis: DataFrame
    max_len: int


def fit_linear(x: np.ndarray, label: np.ndarray, classes: int, seed: int) -> np.ndarray:
    """``classes`` rows of weights with the bias last: averaged hinge-loss gradients, one class against the rest."""
    random = np.random.default_rng(seed)
    x = np.column_stack([x, np.ones(len(x))])
    # Weights are ``least * held``, and their sum ``passed * held - before``: a step touches only the classes that it misses.
    held, before, least, passed, steps = np.zeros((classes, x.shape[1])), np.zeros((classes, x.shape[1])), 1.0, 0.0, 0
    scale = max(float((x * x).sum(1).mean()), 1.0)
    for _ in range(_PASSES):
        order = random.permutation(len(x))
        for start in range(0, len(x), _BATCH):
            rows = order[start : start + _BATCH]
            at = np.arange(len(rows)), label[rows]
            scores = least * (x[rows] @ held.T)
            missed = scores > -1
            missed[at] = scores[at] < 1
            touched = np.flatnonzero(missed.any(0))
            sign = np.zeros((len(rows), classes))
            sign[at] = 2.0
            sign = np.where(missed[:, touched], sign[:, touched] - 1, 0.0)
            steps += 1
            rate = 1 / (scale * (1 + 0.01 * steps))
            least *= 1 - rate * _PENALTY
            step = rate / least * (sign.T @ x[rows]) / len(rows)
            held[touched] += step
            before[touched] += passed * step
            passed += least
    return (passed * held - before) / max(steps, 1)


MODEL = "candidate int, length int, clusters array<{kind}>, weights array<array<double>>"


def _fitted(seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "variant_id"])
        clusters = sorted(set(rows["cluster_id"]))
        number = {c: i for i, c in enumerate(clusters)}
        label = np.array([number[c] for c in rows["cluster_id"]])
        weights = fit_linear(np.stack(rows["projection"].tolist()), label, len(clusters), seed)
        first = rows.iloc[0]
        return pd.DataFrame({"candidate": [int(first["candidate"])], "length": [int(first["length"])], "clusters": [clusters], "weights": [[w.tolist() for w in weights]]})

    return run


def train_router(labelled: DataFrame, max_len: int, settings: Settings = Settings()) -> Router:
    """``labelled``: ``(candidate, cluster_id, variant_id, acts)``, noise left out.

    A trace shorter than a classifier's length is in it as a whole.
    """
    longest = max(2, max_len)
    sequences = materialize(labelled.select("variant_id", "acts").dropDuplicates(["variant_id"]), "router-traces")
    basis = svd_basis(first_lengths(sequences, "variant_id", settings), "variant_id", settings)
    cut = materialize(prefix_projections(sequences, basis, "variant_id", settings), "router-prefixes")
    last = Window.partitionBy("variant_id").orderBy(F.desc("length"))
    whole = cut.withColumn("place", F.row_number().over(last)).where("place = 1").where(F.col("length") < longest)
    longer = whole.select("variant_id", F.explode(F.sequence(F.col("length") + 1, F.lit(longest))).alias("length"), "projection")
    every = cut.unionByName(longer).where(F.col("length") <= longest)
    members = labelled.select("candidate", "cluster_id", "variant_id")
    draw = F.xxhash64(F.col("variant_id"), F.lit(settings.seed))
    drawn = members.withColumn("draw", draw)
    if settings.router_rows is not None:
        place = F.row_number().over(Window.partitionBy("candidate").orderBy("draw", "variant_id"))
        drawn = drawn.withColumn("place", place).where(F.col("place") <= settings.router_rows).drop("place")
    kind = dict(labelled.dtypes)["cluster_id"]
    models = drawn.join(every, "variant_id").groupBy("candidate", "length").applyInPandas(_fitted(settings.seed), MODEL.format(kind=kind))
    return Router(materialize(models, "router-models"), basis, longest)


def route(sequences: DataFrame, router: Router, settings: Settings = Settings()) -> DataFrame:
    """``(candidate, variant_id, length, cluster_id)`` for every prefix of ``(variant_id, acts)`` from 2 events on.

    Lengths beyond the longest trained one use its classifier; the smaller cluster wins ties.
    """
    longer = sequences.where(F.size("acts") >= 3)
    own = prefix_projections(longer, router.basis, "variant_id", settings).join(longer.select("variant_id", F.size("acts").alias("n")), "variant_id").where("length < n")
    classifier = F.least("length", F.lit(router.max_len)).alias("classifier")
    own = materialize(own.select("variant_id", "length", classifier, "projection"), "prefix-projections")
    counts = own.groupBy("classifier").agg(F.count("*").alias("rows"))
    dealt = own.join(counts, "classifier").withColumn("block", F.pmod(F.xxhash64("variant_id", "length"), F.ceil(F.col("rows") / _BLOCK)))
    blocks = dealt.groupBy("classifier", "block").agg(F.collect_list(F.struct("variant_id", "length", "projection")).alias("prefixes"))  # about _BLOCK
    blocks = blocks.withColumn("copy", F.expr(f"block div {_SHARING}"))
    models = router.models.withColumnRenamed("length", "classifier")
    # A short length holds many of the prefixes: its blocks are dealt over copies of its weights.
    copies = counts.select("classifier", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(ceil(rows / {_BLOCK}) - 1) div {_SHARING}"))).alias("copy"))
    types = dict(models.dtypes), dict(own.dtypes)
    schema = f"candidate int, variant_id {types[1]['variant_id']}, length int, cluster_id {types[0]['clusters'][len('array<'):-1]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                prefixes = batch.column("prefixes")[i].values
                clusters = batch.column("clusters")[i].values
                weights = batch.column("weights")[i].values.flatten().to_numpy(zero_copy_only=False).reshape(len(clusters), -1)
                x = prefixes.field("projection").flatten().to_numpy(zero_copy_only=False).reshape(len(prefixes), -1)
                scores = np.round(x @ weights[:, :-1].T + weights[:, -1], 9)
                best = clusters.take(pa.array(scores.argmax(1)))
                candidate = pa.array(np.full(len(prefixes), batch.column("candidate")[i].as_py(), np.int32))
                yield pa.RecordBatch.from_arrays([candidate, prefixes.field("variant_id"), prefixes.field("length"), best], ["candidate", "variant_id", "length", "cluster_id"])

    return blocks.join(models.join(copies, "classifier"), ["classifier", "copy"]).select("candidate", "prefixes", "clusters", "weights").mapInArrow(run, schema)
