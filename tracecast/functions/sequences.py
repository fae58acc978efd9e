"""Column functions on activity sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "-"


def to_text(acts: Column | str, separator: str = SEPARATOR) -> Column:
    return F.array_join(acts, separator)


def from_text(text: Column | str, separator: str = SEPARATOR) -> Column:
    """Inverse of :func:`to_text` for labels that do not contain the separator."""
    return F.split(text, "\\Q" + separator + "\\E")


def cut(acts: Column | str, n: Column | int) -> Column:
    """First ``n`` activities; shorter sequences stay whole."""
    return F.slice(acts, 1, n)


def ngram_positions(acts: Column, low: int = 1, high: int = 2) -> Column:
    """``array<struct<ngram: array<string>, last: int>>``: every n-gram with its last position (1-based)."""

    def of_length(n: int) -> Column:
        starts = F.when(F.size(acts) >= n, F.sequence(F.lit(1), F.size(acts) - (n - 1))).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(
            starts,
            lambda i: F.struct(F.slice(acts, i, n).alias("ngram"), (i + (n - 1)).alias("last")),
        )

    return F.concat(*[of_length(n) for n in range(low, high + 1)])


def ngrams(acts: Column, low: int = 1, high: int = 2) -> Column:
    """Every n-gram of the sequence, with repeats, as space-joined text: for display, as labels may hold blanks."""
    return F.transform(ngram_positions(acts, low, high), lambda g: F.array_join(g["ngram"], " "))


def ngram_arrays(acts: Column, low: int = 1, high: int = 2) -> Column:
    """Every n-gram of the sequence, with repeats, as an array of labels."""
    return F.transform(ngram_positions(acts, low, high), lambda g: g["ngram"])


def fingerprint(acts: Column | str) -> Column:
    """128 bits that stand for a sequence in joins and groups; :func:`only_value` shows if two sequences should ever share them."""
    acts = F.col(acts) if isinstance(acts, str) else acts
    tell = F.concat(F.array(F.size(acts).cast("string")), acts)
    return F.struct(F.xxhash64(tell).alias("x"), F.xxhash64(tell, F.lit(1)).alias("y"))


def only_value(column: str) -> Column:
    """The value that all rows of a group have; different ones raise."""
    told = F.raise_error(F.lit(f"{column}: different sequences with one fingerprint"))
    return F.when(F.min(column).eqNullSafe(F.max(column)), F.min(column)).otherwise(told)
