"""Quality rules: rule statistics of a text, and an isolation forest that tells unusual documents by them.

A document is first judged by fixed rules (too few words, too many repeated words). The others
get an anomaly score from the mean path length over random splits; the score above which they
are rejected is calibrated on labelled rows, so that at most a stated share of the good ones goes.
The forest is grown on good rows and splits the space around them, too, or the unusual documents, which
resemble each other, would count as a cluster of usual ones. The statistics reach it whole, scaled by the good rows.

Null and empty texts have no words and fail the rules. Without good labelled rows there is no
forest, every score is null and the rules alone decide. Repeated rows are judged alike, each on
its own, ids may be null; further columns are ignored or, in :func:`filtered`, kept. A label given twice counts as the worse one; a score at the
limit is kept. Texts are read whole, every word of them; no documents give no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracecast.llm.common import batch_of, id_and_text, per_value, raw_bytes, released, slices
from tracecast.storage import materialize

WORD = re.compile(r"[^ \t-\r]+")
SEPARATORS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"

#: Bytes counted over the whole text: capitals, digits, marks that end or part sentences.
CLASSES = {"n_upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "n_digits": b"0123456789", "n_marks": b"!?.,;:"}

COUNTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct")
#: Words in equal windows and the distinct ones of each, summed: a share that does not depend on the length of the text.
WINDOWED = ("n_window_words", "n_window_distinct")
STATISTICS = (*COUNTED, *CLASSES, *WINDOWED)
SCHEMA = "doc_id long, " + ", ".join(f"{name} long" for name in STATISTICS)


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 10
    #: Repeated words in a hundred beyond which a text fails.
    max_repeat_percent: int = 20
    trees: int = 200
    #: Rows each tree is grown on. The forest sees at most ``trees * tree_rows`` labelled rows.
    tree_rows: int = 64
    #: Levels of a tree beyond those that would part its rows: many splits meet none.
    more_depth: int = 2
    #: Splits are drawn up to so many units (see :class:`Scale`) to both sides of the median; beyond, all is as far.
    reach: float = 4.0
    #: Share of the good labelled rows that the calibrated threshold may reject.
    good_loss: float = 0.003
    seed: int = 7


def repeated_words(words: list[str], window: int = 5) -> int:
    """Words inside windows that occur twice or more."""
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    counts, total, reach = Counter(grams), 0, 0
    for i, gram in enumerate(grams):
        if counts[gram] > 1:
            total += i + window - max(i, reach)
            reach = i + window
    return total


def count_rules(text: str) -> tuple[int, ...]:
    """The statistics of ``COUNTED``."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if line.strip(SEPARATORS)]
    return (
        len(words),
        len(text) - sum(map(text.count, SEPARATORS)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(set(words)),
    )


def windowed(words: list[str], window: int = 50) -> tuple[int, int]:
    """The statistics of ``WINDOWED``: every word is in a window; the last one is of the last words, and a shorter text is one window."""
    if len(words) < window:
        return len(words), len(set(words))
    starts = [*range(0, len(words) - window, window), len(words) - window]
    return len(starts) * window, sum(len(set(words[i : i + window])) for i in starts)


def _columns(texts: pa.Array) -> dict[str, np.ndarray]:
    """All statistics of each text."""
    values = [text or "" for text in texts.to_pylist()]
    counts = np.array([count_rules(text) for text in values], np.int64).reshape(-1, len(COUNTED))
    windows = np.array([windowed(WORD.findall(text)) for text in values], np.int64).reshape(-1, len(WINDOWED))
    data, starts = raw_bytes(texts)
    classes = {name: per_value(np.isin(np.arange(256), list(marks))[data], starts) for name, marks in CLASSES.items()}
    return dict(zip(COUNTED, counts.T)) | classes | dict(zip(WINDOWED, windows.T))


@released
def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        yield batch_of(doc_id=part.column("doc_id"), **_columns(part.column("text")))


def statistics(docs: DataFrame) -> DataFrame:
    """One row of rule statistics per document."""
    return id_and_text(docs).mapInArrow(_statistics, SCHEMA)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """Shares that do not depend on the length of a text, one row per document."""
    s = {name: np.asarray(stats[name], float) for name in STATISTICS}
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["word_chars"], 1)
    return np.column_stack([
        s["word_chars"] / words,
        s["n_symbols"] / words,
        s["n_dup_lines"] / np.maximum(s["n_lines"], 1),
        s["n_repeat_words"] / words,
        s["n_window_distinct"] / np.maximum(s["n_window_words"], 1),
        s["n_upper"] / chars,
        s["n_digits"] / chars,
        s["n_marks"] / words,
    ])


@dataclass(frozen=True)
class Scale:
    """Median and spread of each share of the good rows; in units of the spread, shares are log-scaled to both sides."""

    centre: np.ndarray
    spread: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Scale:
        low, centre, high = np.quantile(x, [0.01, 0.5, 0.99], axis=0)
        return cls(centre, np.maximum(high - low, 0.01))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        units = (x - self.centre) / self.spread
        return np.sign(units) * np.log1p(np.abs(units))


def _average_path(rows: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary tree of so many rows."""
    n = np.maximum(np.asarray(rows, float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, n - 1)


@dataclass
class Forest:
    """All trees in arrays, one row per tree; the children of node i are 2i+1 and 2i+2."""

    feature: np.ndarray
    split: np.ndarray
    #: Path length at which a walk that ends in this node counts.
    length: np.ndarray
    depth: int
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score from 0 to 1: higher for shorter paths."""
        total = np.zeros(len(x))
        for feature, split, length in zip(self.feature, self.split, self.length):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                f = feature[node]
                value = x[np.arange(len(x)), np.maximum(f, 0)]
                node = np.where(f < 0, node, 2 * node + 1 + (value >= split[node]))
            total += length[node]
        return 2 ** (-total / len(self.feature) / max(self.norm, 1e-9))


def grow(x: np.ndarray, rules: QualityRules) -> Forest:
    """Isolation trees, each on ``tree_rows`` rows of ``x``, split at random values of random features within a node's bounds."""
    random = np.random.default_rng(rules.seed)
    rows = min(rules.tree_rows, len(x))
    depth = max(1, int(np.ceil(np.log2(max(rows, 2)))) + rules.more_depth)
    n = x.shape[1]
    shape = (rules.trees, 2 ** (depth + 1) - 1)
    forest = Forest(np.full(shape, -1), np.zeros(shape), np.zeros(shape), depth, float(_average_path(rows)))
    for tree in range(rules.trees):
        open_nodes = [(0, 0, x[random.choice(len(x), rows, replace=False)], np.full(n, -rules.reach), np.full(n, rules.reach))]
        while open_nodes:
            node, level, own, low, high = open_nodes.pop()
            if level == depth or len(own) <= 1:
                forest.length[tree, node] = level + _average_path(len(own))
                continue
            f = random.integers(n)
            at = random.uniform(low[f], high[f])
            forest.feature[tree, node], forest.split[tree, node] = f, at
            right, bound = own[:, f] >= at, np.arange(n) == f
            open_nodes += [
                (2 * node + 1, level + 1, own[~right], low, np.where(bound, at, high)),
                (2 * node + 2, level + 1, own[right], np.where(bound, at, low), high),
            ]
    return forest


def _scored(forest: Forest | None, scale: Scale | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            if forest is None:
                columns["score"] = pa.nulls(batch.num_rows, pa.float64())
            else:
                columns["score"] = forest.scores(scale(features({n: columns[n].to_numpy(zero_copy_only=False) for n in STATISTICS})))
            yield batch_of(**columns)

    return run


def _threshold(scored_labels: DataFrame, rules: QualityRules, bins: int = 10_000) -> float:
    """Smallest score that at most ``good_loss`` of the good labelled rows exceed, from their histogram."""
    counts = (
        scored_labels.where("quality = 1").groupBy(F.ceil(F.col("score") * bins).cast("int").alias("bin")).count()
    ).collect()  # at most `bins` rows
    left = sum(r["count"] for r in counts) * rules.good_loss
    for row in sorted(counts, key=lambda r: -r["bin"]):
        left -= row["count"]
        if left < 0:
            return row["bin"] / bins
    return 0.0


@dataclass(frozen=True)
class Verdict:
    """A fitted forest (none without good labelled rows), the scale of its input and the score above which it rejects."""

    forest: Forest | None
    scale: Scale | None
    limit: float
    rules: QualityRules

    def kept(self, stats: dict[str, np.ndarray]) -> np.ndarray:
        words, repeated = (np.asarray(stats[n], np.int64) for n in ("n_words", "n_repeat_words"))
        passed = (words >= self.rules.min_words) & (100 * repeated <= self.rules.max_repeat_percent * words)
        return passed if self.forest is None else passed & (self.forest.scores(self.scale(features(stats))) <= self.limit)


def base_failed(rules: QualityRules) -> Column:
    return (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * rules.max_repeat_percent)


def fit(stats: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> Verdict:
    """Grows the forest on a bounded sample of the good labelled rows and calibrates it on all of them.

    ``labels`` has ``doc_id`` and ``quality`` (1 good, 0 bad, null unknown).
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    labelled = stats.where(~base_failed(rules)).join(known, "doc_id").select("doc_id", *STATISTICS, "quality")
    sample = (
        labelled.where("quality = 1").orderBy(F.xxhash64("doc_id", F.lit(rules.seed)), "doc_id", *STATISTICS)
        .limit(rules.trees * rules.tree_rows)
        .select(*STATISTICS)
        .toPandas()  # bounded by the two parameters above
    )
    if not len(sample):
        return Verdict(None, None, 1.0, rules)
    shares = features({n: sample[n].to_numpy() for n in STATISTICS})
    scale = Scale.of(shares)
    forest = grow(scale(shares), rules)
    scored = labelled.mapInArrow(_scored(forest, scale), f"{SCHEMA}, quality long, score double")
    return Verdict(forest, scale, _threshold(scored, rules), rules)


def judge(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Statistics, anomaly ``score``, ``base_failed`` and ``kept`` of every document."""
    stats = materialize(statistics(docs), "rule-statistics")
    verdict = fit(stats, labels, rules)
    scored = stats.mapInArrow(_scored(verdict.forest, verdict.scale), f"{SCHEMA}, score double").withColumn("base_failed", base_failed(rules))
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("score").isNull() | (F.col("score") <= verdict.limit)))


def filtered(docs: DataFrame, labels: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``docs`` without those that are rejected. The statistics are taken once more rather than the texts shuffled."""
    verdict = fit(materialize(statistics(docs), "rule-statistics"), labels, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(verdict.kept(_columns(part.column("text"))), pa.bool_()))

    return docs.mapInArrow(released(run), docs.schema)
