"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are lower-cased runs of letters, digits and non-ASCII characters. A text is the set of its hashed
words, word pairs and pairs with one word between. Per-coordinate learning rates and the L1 term leave
few non-zero weights, which every task holds as two sorted arrays. Weights are learned from a
bounded sample of labelled rows of either class, in shards whose weights are averaged; the
intercept is then set back to the class shares of all labelled rows.

Null and empty texts score by the intercept alone. Without labelled rows of both classes there is no
model and every score is the share of toxic labels (0 if there are none). Of several labels of a
document the toxic one counts. Repeated rows are scored alike, each on its own, ids may be null; texts are read whole, no documents give no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import batch_of, hashed_words, id_and_text, mixed, raw_bytes, slices
from tracecast.storage import materialize

_IS_WORD = np.array([chr(b).isalnum() or b >= 0x80 for b in range(256)])


@dataclass(frozen=True)
class ToxicitySettings:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 3.0
    l2: float = 0.5
    epochs: int = 5
    min_rows: int = 3
    #: Labelled rows of each class that are learned from at most.
    class_rows: int = 20_000
    shard_rows: int = 20_000
    seed: int = 3


def word_features(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 31-bit features of each (lower-cased) text."""
    data, starts = raw_bytes(column)
    words, doc = hashed_words(data, starts, _IS_WORD)
    kinds, owners = [words], [doc]
    for gap, factor in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        same = doc[gap:] == doc[:-gap]
        kinds.append(mixed(words[:-gap] * np.uint64(factor) + words[gap:])[same])
        owners.append(doc[gap:][same])
    owner = np.concatenate(owners)
    keys = np.unique((owner.astype(np.uint64) << np.uint64(31)) | (np.concatenate(kinds) >> np.uint64(33)))
    cuts = np.searchsorted(keys, np.arange(1, len(column), dtype=np.uint64) << np.uint64(31))
    return np.split((keys & np.uint64(0x7FFFFFFF)).astype(np.int32), cuts)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield batch_of(
            toxic=part.column("toxic"),
            draw=part.column("draw"),
            features=pa.array([f.tobytes() for f in word_features(part.column("text"))], pa.binary()),
        )


def _places(names: np.ndarray, features: np.ndarray) -> np.ndarray:
    """Where those of the features that are among the sorted names stand."""
    at = np.minimum(np.searchsorted(names, features), max(len(names) - 1, 0))
    return at[names[at] == features] if len(names) else at[:0]


def ftrl(labels: np.ndarray, rows: list[np.ndarray], settings: ToxicitySettings) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a non-zero weight, the weights, the intercept."""
    names, seen = np.unique(np.concatenate(rows), return_counts=True)
    names = names[seen >= settings.min_rows]  # what one or two texts have tells nothing of others
    bias = len(names)
    rows = [np.append(_places(names, r), bias) for r in rows]
    z, n = np.zeros(bias + 1), np.zeros(bias + 1)
    l1 = np.append(np.full(bias, settings.l1), 0.0)

    def weights(at):
        return np.where(
            np.abs(z[at]) > l1[at],
            (np.sign(z[at]) * l1[at] - z[at]) / ((settings.beta + np.sqrt(n[at])) / settings.alpha + settings.l2),
            0.0,
        )

    random = np.random.default_rng(settings.seed)
    for _ in range(settings.epochs):
        for i in random.permutation(len(rows)):
            at = rows[i]
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[i]
            z[at] += slope - (np.sqrt(n[at] + slope**2) - np.sqrt(n[at])) / settings.alpha * w
            n[at] += slope**2
    w = weights(np.arange(bias + 1))
    kept = np.flatnonzero(w[:bias])
    return names[kept], w[kept], float(w[bias])


def _learn(settings: ToxicitySettings):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["draw", "features"])  # the order of learning must not depend on that of arrival
        names, w, bias = ftrl(rows["toxic"].to_numpy(float), [np.frombuffer(f, np.int32) for f in rows["features"]], settings)
        return pd.DataFrame({"feature": np.append(names, -1).astype(np.int64), "weight": np.append(w, bias)})

    return run


@dataclass(frozen=True)
class ToxicityModel:
    names: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        rows = word_features(column)
        sums = np.full(len(rows), self.bias)
        if len(self.names):
            every = np.concatenate(rows)
            at = np.minimum(np.searchsorted(self.names, every), len(self.names) - 1)
            hit = np.flatnonzero(self.names[at] == every)
            owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            sums += np.bincount(owner[hit], self.weights[at[hit]], len(rows))
        return 1 / (1 + np.exp(-np.clip(sums, -35, 35)))


def fit(docs: DataFrame, labels: DataFrame, settings: ToxicitySettings = ToxicitySettings()) -> ToxicityModel:
    """Learns from the documents that ``labels`` (``doc_id``, ``toxic``) marks 0 or 1."""
    known = materialize(
        labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")),
        "toxic-labels",
    )
    total = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    if len(total) < 2:
        share = total.get(1, 0) / max(1, sum(total.values()))
        return ToxicityModel(np.zeros(0, np.int32), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    draw = F.xxhash64("doc_id", F.lit(settings.seed))
    classes = [known.where(F.col("toxic") == c).withColumn("draw", draw).orderBy("draw", "doc_id").limit(settings.class_rows) for c in (0, 1)]
    sample = F.broadcast(classes[0].unionByName(classes[1]))  # 2 * class_rows rows of 20 bytes at most
    featured = materialize(
        id_and_text(docs).join(sample, "doc_id").select("toxic", "draw", F.lower("text").alias("text"))
        .mapInArrow(_featured, "toxic int, draw long, features binary"),
        "toxic-features",
    )
    taken = {r["toxic"]: r["count"] for r in featured.groupBy("toxic").count().collect()}
    shards = max(1, round(sum(taken.values()) / settings.shard_rows))
    learned = (
        featured.groupBy(F.pmod(F.xxhash64("draw"), F.lit(shards)).alias("shard"))
        .applyInPandas(_learn(settings), "feature long, weight double")
        .groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))
        .orderBy("feature").toPandas()  # non-zero weights of a bounded sample
    )
    names, w = learned["feature"].to_numpy(), learned["weight"].to_numpy()
    shift = np.log(total[1] * taken.get(0, 1) / (total[0] * taken.get(1, 1)))
    bias = float(w[names < 0].sum() + shift)
    return ToxicityModel(names[names >= 0].astype(np.int32), w[names >= 0], bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score`` from the whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield batch_of(doc_id=part.column("doc_id"), score=model.scores(part.column("text")))

    lowered = id_and_text(docs).withColumn("text", F.lower("text"))
    return lowered.mapInArrow(run, "doc_id long, score double")
