"""Activity labels of a log, and the models that follow from the labels alone."""

from __future__ import annotations

from pyspark.sql import DataFrame


def labels(log: DataFrame) -> list[str]:
    """Sorted distinct activities."""
    return sorted(r["activity"] for r in log.select("activity").distinct().collect())


def flower(acts: list[str]) -> list:
    """Any activity, any number of times."""
    return ["XorLoop", ["Xor", *acts], None, None]


def sequence(acts: list[str]) -> list:
    return ["Seq", *acts]


def bag(acts: list[str]) -> list:
    """Every activity once, in any order but for the first two, which keep theirs."""
    return ["And", ["Seq", *acts[:2]], *acts[2:]]
