"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent and normalised. Bisection finds the smallest
exponent (the flattest mixture) that meets a limit on how often a source is repeated, or the one that
meets a target entropy. The mixture is realised in epochs: each is an own permutation of the source,
in blocks drawn by hash and by hash within a block; the last epoch stops at the budget. Which rows
that keeps is one pair of numbers per source, so the documents themselves are not shuffled.

Tokens are words. A null source is a source of its own. Null and empty texts have no tokens; they are in
every epoch they are reached in, as is a source without tokens, once. Rows equal in id and tokens
tie and are kept or left together. Further columns, whatever their names, pass through. Without documents nothing is mixed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tracecast.llm.common import set_aside
from tracecast.storage import materialize


@dataclass(frozen=True)
class MixSettings:
    #: No source is used more often than this ...
    max_repeats: float = 4.0
    #: ... unless a target entropy is given, as a share of that of equal weights.
    entropy: float | None = None
    #: Tokens to draw; by default as few as use every document of every source once at least.
    budget: float | None = None
    seed: int = 11


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    top = max(shares.values())
    raised = {k: (v / top) ** exponent for k, v in shares.items()}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def repeats(tokens: dict[str, float], weights: dict[str, float], budget: float | None) -> dict[str, float]:
    """How often each source is used."""
    need = {k: weights[k] / tokens[k] for k in tokens}
    total = budget if budget is not None else 1 / min(need.values())
    return {k: total * v for k, v in need.items()}


def solve(tokens: dict[str, float], settings: MixSettings) -> tuple[float, dict[str, float], dict[str, float]]:
    """Exponent, weights and repeats of the sources with tokens."""

    def fits(exponent: float) -> bool:
        weights = tempered(tokens, exponent)
        if settings.entropy is not None:
            return entropy(weights) <= settings.entropy * math.log(max(len(tokens), 2))
        return max(repeats(tokens, weights, settings.budget).values()) <= settings.max_repeats

    low, high = 0.0, 1.0
    if fits(low):
        high = low
    for _ in range(60):  # the entropy and the largest repeat both fall as the exponent rises
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    weights = tempered(tokens, high)
    return high, weights, repeats(tokens, weights, settings.budget)


def _local(spark: SparkSession, rows: list[tuple], names: tuple[str, ...]) -> DataFrame:
    """A relation of known size, one row per source."""
    return spark.createDataFrame(pa.table(dict(zip(names, map(list, zip(*rows))))))


def source_key(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(column)), F.lit(""))


def _draw(epoch: Column, settings: MixSettings) -> Column:
    """Place of a row in an epoch's permutation: the high bits are its block."""
    return F.xxhash64(F.col("doc_id"), F.col("mix_tokens"), F.lit(settings.seed), epoch.cast("int")).bitwiseAND(F.lit((1 << 62) - 1))


@dataclass(frozen=True)
class Plan:
    """Per source: weight, repeats, tokens, and the last draw kept in the last, partial epoch."""

    exponent: float
    weights: dict[str, float]
    repeats: dict[str, float]
    blocks: dict[str, int]
    last_draw: dict[str, int]
    settings: MixSettings


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` with the source key and the words of each text."""
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^ \t-\r]+")), F.lit(0)).cast("long")
    return docs.withColumn("mix_source", source_key()).withColumn("mix_tokens", words)


def _block(draw: Column, blocks: Column) -> Column:
    return F.shiftright(draw, 31) * blocks / F.lit(1 << 31)


def plan(narrow: DataFrame, settings: MixSettings = MixSettings()) -> Plan:
    """From ``doc_id, mix_source, mix_tokens`` of all documents."""
    sums = narrow.groupBy("mix_source").agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("docs")).collect()  # one row per source
    tokens = {r["mix_source"]: float(r["tokens"]) for r in sums if r["tokens"]}
    exponent, weights, often = solve(tokens, settings) if tokens else (1.0, {}, {})
    often |= {r["mix_source"]: 1.0 for r in sums if not r["tokens"]}
    blocks = {r["mix_source"]: math.isqrt(r["docs"]) + 1 for r in sums}
    parts = {k: (math.floor(v + 1e-9), v - math.floor(v + 1e-9)) for k, v in often.items()}
    last: dict[str, int] = {}
    partial = {k: f for k, (_, f) in parts.items() if f > 1e-9 and k in tokens}
    if partial:
        spark = narrow.sparkSession
        goals = _local(spark, [(k, parts[k][0], int(f * tokens[k]), blocks[k]) for k, f in partial.items()], ("mix_source", "epoch", "goal", "blocks"))
        drawn = narrow.join(goals, "mix_source").withColumn("draw", _draw(F.col("epoch"), settings))
        drawn = drawn.withColumn("block", _block(F.col("draw"), F.col("blocks")).cast("long"))
        sums = drawn.groupBy("mix_source", "block", "goal").agg(F.sum("mix_tokens").alias("tokens"))  # sqrt(docs) rows per source
        before = W.partitionBy("mix_source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        sums = sums.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
        cut = materialize(sums.where("before <= goal and before + tokens > goal"), "mix-cuts")  # one block per source
        inside = W.partitionBy("mix_source").orderBy("draw")
        kept = (
            drawn.join(cut.select("mix_source", "block", "before"), ["mix_source", "block"])
            .withColumn("upto", F.col("before") + F.sum("mix_tokens").over(inside))
            .where("upto <= goal").groupBy("mix_source").agg(F.max("draw").alias("last"))
        )
        edge = {r["mix_source"]: r["block"] for r in cut.collect()}
        last = {k: (-(-(b << 31) // blocks[k]) << 31) - 1 for k, b in edge.items()}  # all earlier blocks
        last |= {r["mix_source"]: r["last"] for r in kept.collect()}
    return Plan(exponent, weights, often, blocks, last, settings)


def realise(counted_docs: DataFrame, mix: Plan) -> DataFrame:
    """The rows of all epochs: adds ``mix_epoch``, ``mix_block``, ``mix_weight`` and ``mix_at``, a row's place from 0 to 1.

    Sorting by ``mix_at`` interleaves the sources at their weights.
    """
    spark = counted_docs.sparkSession
    rows = [
        (k, mix.weights.get(k, 0.0), v, math.ceil(v - 1e-9), mix.blocks[k], mix.last_draw.get(k, (1 << 62) if v - math.floor(v + 1e-9) <= 1e-9 else -1))
        for k, v in mix.repeats.items()
    ]
    if not rows:
        rows = [("", 0.0, 1.0, 1, 1, -1)]  # no documents
    names = ("mix_source", "mix_weight", "mix_repeats", "mix_epochs", "mix_blocks", "mix_last")
    every = counted_docs.join(_local(spark, rows, names), "mix_source").withColumn("mix_epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.col("mix_epochs"), F.lit(1)) - 1).cast("array<int>")))
    every = every.withColumn("mix_draw", _draw(F.col("mix_epoch"), mix.settings))
    full = F.col("mix_epoch") < F.floor(F.col("mix_repeats") + 1e-9)
    partial = F.when(F.col("mix_last") < F.lit(1 << 62), F.greatest(F.col("mix_last"), F.lit(0)) / F.lit(float(1 << 62))).otherwise(0.0)
    drawn = F.floor(F.col("mix_repeats") + 1e-9) + partial  # epochs, the last one as far as it goes
    kept = every.where(full | (F.col("mix_draw") <= F.col("mix_last")))
    return (
        kept.withColumn("mix_block", _block(F.col("mix_draw"), F.col("mix_blocks")).cast("long"))
        .withColumn("mix_at", (F.col("mix_epoch") + F.col("mix_draw") / F.lit(float(1 << 62))) / drawn)
        .drop("mix_draw", "mix_last", "mix_blocks", "mix_epochs")
    )


def mixture(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """The mixture without texts: one row per use of a document."""
    narrow = materialize(counted(docs).select("doc_id", "source", "mix_source", "mix_tokens"), "mix-tokens")
    return realise(narrow, plan(narrow, settings))


def mixed_documents(docs: DataFrame, settings: MixSettings = MixSettings()) -> DataFrame:
    """``docs`` with each row as often as the mixture uses it; the columns stay as they are."""
    names, docs = docs.columns, set_aside(docs, "doc_id", "source", "text")
    columns = docs.columns
    full = counted(docs)
    narrow = materialize(full.select("doc_id", "mix_source", "mix_tokens"), "mix-tokens")
    return realise(full, plan(narrow, settings)).select(*columns).toDF(*names)
