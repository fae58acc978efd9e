"""Language identification by the nearest of several centroids per language.

Texts become normalised TF-IDF vectors of hashed byte n-grams of their lower-cased whole text, in which
each run of other characters than letters counts as one blank.
Document frequencies come from all training documents; the centroids of a language come from
spherical k-means over a bounded sample of its training documents. A text gets the language of
the centroid with the greatest cosine; one that is farther from it than nearly all training
samples are is marked ``rejected``.

Null texts and texts without a letter get ``und`` and score 0, as do all texts when nothing could be
learned. Such texts and rows with a null language are not learned from. Repeated rows are predicted alike, each
on its own, ids may be null; further columns are ignored. Of equally near centroids the first language by name wins. Texts are
read whole; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import batch_of, mixed, raw_bytes, released, slices
from tracecast.storage import materialize

UNKNOWN = "und"
_BLOCK = 256  # documents per count matrix


@dataclass(frozen=True)
class LanguageSettings:
    sizes: tuple[int, ...] = (2, 3, 4)
    bits: int = 13
    #: Training documents of a language that its centroids are fitted on.
    sample_rows: int = 1_000
    clusters: int = 3
    rounds: int = 10
    #: Share of a language's training sample that is farther off than its rejection distance.
    reject_share: float = 0.005


_IS_LETTER = np.array([chr(b).isalpha() or b >= 0x80 for b in range(256)])


def _letters(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with one blank for each run of bytes that are no letters: marks tell styles apart, not languages."""
    letter = _IS_LETTER[data]
    after = np.concatenate([[False], letter[:-1]])
    after[starts[:-1][starts[:-1] < len(data)]] = False
    kept = letter | after
    places = np.concatenate([[0], np.cumsum(kept)])
    return np.where(letter, data, np.uint8(0x20))[kept], places[starts]


def ngram_counts(column: pa.Array, settings: LanguageSettings) -> np.ndarray:
    """Documents x buckets; n-grams do not cross documents."""
    data, starts = raw_bytes(column)
    if len(data):
        data, starts = _letters(data, starts)
    n, dims = len(column), 1 << settings.bits
    doc = np.repeat(np.arange(n) * dims, np.diff(starts))
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(data))
    counts = np.zeros(n * dims, np.int64)
    for size in settings.sizes:
        if len(data) < size:
            continue
        last = len(data) - size + 1
        gram = np.full(last, size, np.uint64)
        for i in range(size):
            gram = (gram << np.uint64(8)) | data[i : last + i]
        bucket = (mixed(gram) >> np.uint64(64 - settings.bits)).astype(np.int64) + doc[:last]
        counts += np.bincount(bucket[left[:last] >= size], minlength=n * dims)
    return counts.reshape(n, dims)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        for start in range(0, part.num_rows, _BLOCK):
            yield part.slice(start, _BLOCK)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts).astype(np.float32) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _corpus(settings: LanguageSettings):
    """Document frequencies of a task's training texts (bucket -1: documents), and counts of the sampled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency, total = np.zeros(1 << settings.bits, np.int64), 0
        for part in _blocks(batches):
            counts = ngram_counts(part.column("text"), settings)
            frequency += (counts > 0).sum(0)
            total += part.num_rows
            chosen = np.flatnonzero(part.column("sampled").to_numpy(zero_copy_only=False))
            if len(chosen):
                yield batch_of(
                    bucket=pa.nulls(len(chosen), pa.int32()),
                    n=pa.nulls(len(chosen), pa.int64()),
                    lang=part.column("lang").take(pa.array(chosen)),
                    counts=pa.array([counts[i].astype(np.uint32).tobytes() for i in chosen], pa.binary()),
                )
        used = np.flatnonzero(frequency)
        yield batch_of(
            bucket=pa.array([-1, *used], pa.int32()),
            n=pa.array([total, *frequency[used]], pa.int64()),
            lang=pa.nulls(len(used) + 1, pa.string()),
            counts=pa.nulls(len(used) + 1, pa.binary()),
        )

    return released(run)


def _cluster(idf: np.ndarray, settings: LanguageSettings):
    """Spherical k-means over the sample of one language, and the distance it rejects beyond."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("counts")  # the start must not depend on the order of arrival
        x = vectors(np.stack([np.frombuffer(c, np.uint32) for c in rows["counts"]]), idf)
        centre = x.mean(0)
        chosen = [int(np.argmax(x @ centre))]
        while len(chosen) < min(settings.clusters, len(x)):  # farthest first
            chosen.append(int(np.argmin((x @ x[chosen].T).max(1))))
        centroids = x[chosen]
        for _ in range(settings.rounds):
            nearest = np.argmax(x @ centroids.T, axis=1)
            sums = [x[nearest == k].sum(0) if (nearest == k).any() else centroids[k] for k in range(len(centroids))]
            centroids = np.stack([s / max(np.linalg.norm(s), 1e-9) for s in sums])
        floor = float(np.quantile((x @ centroids.T).max(1), settings.reject_share))
        return pd.DataFrame({
            "lang": rows["lang"].iloc[0],
            "floor": floor,
            "centroid": [c.astype(np.float32).tobytes() for c in centroids],
        })

    return run


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    langs: list[str]
    floors: np.ndarray
    centroids: np.ndarray
    settings: LanguageSettings

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine and whether it was rejected, by text."""
        if not self.langs:
            return [UNKNOWN] * len(column), np.zeros(len(column)), np.ones(len(column), bool)
        near = vectors(ngram_counts(column, self.settings), self.idf) @ self.centroids.T
        best = near.argmax(1)
        score = np.clip(near[np.arange(len(near)), best], 0, 1).astype(float)
        lettered = [any(map(str.isalpha, text or "")) for text in column.to_pylist()]
        langs = [self.langs[b] if some else UNKNOWN for b, some in zip(best, lettered)]
        return langs, np.where(lettered, score, 0.0), (score < self.floors[best]) | ~np.array(lettered, bool)


def fit(docs: DataFrame, settings: LanguageSettings = LanguageSettings()) -> LanguageModel:
    """Learns from ``text`` and ``lang`` of all given rows; ``doc_id`` only draws the sample."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}  # one row per language
    share = F.lit(0.0)
    for lang, size in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, settings.sample_rows / size))).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "n_bytes"), F.lit(1 << 30)) / (1 << 30)
    corpus = materialize(
        docs.withColumn("n_bytes", F.octet_length("text"))
        .select("lang", F.lower("text").alias("text"), (draw < share).alias("sampled"))
        .mapInArrow(_corpus(settings), "bucket int, n long, lang string, counts binary"),
        "ngram-counts",
    )
    found = {r["bucket"]: r["n"] for r in corpus.where("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    frequency = np.array([found.get(i, 0) for i in range(1 << settings.bits)], float)
    idf = np.log((1 + found.get(-1, 0)) / (1 + frequency)).astype(np.float32)
    clusters = corpus.where("counts is not null").groupBy("lang").applyInPandas(
        _cluster(idf, settings), "lang string, floor double, centroid binary"
    )
    rows = sorted(clusters.collect(), key=lambda r: (r["lang"], r["centroid"]))  # `clusters` rows per language
    centroids = np.stack([np.frombuffer(r["centroid"], np.float32) for r in rows]) if rows else np.zeros((0, 1), np.float32)
    return LanguageModel(idf, [r["lang"] for r in rows], np.array([r["floor"] for r in rows]), centroids, settings)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, rejected``, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _blocks(batches):
            langs, score, rejected = model.predict(part.column("text"))
            yield batch_of(doc_id=part.column("doc_id"), lang_pred=pa.array(langs, pa.string()), score=score, rejected=rejected)

    lowered = docs.select("doc_id", F.lower("text").alias("text"))
    return lowered.mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
