"""Levenshtein and Damerau-Levenshtein similarity of activity sequences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from tracecast.functions.sequences import fingerprint, only_value
from tracecast.storage import dealt, never_broadcast

#: First code of the per-pair alphabet and number of codes below the surrogate range.
_FIRST_CODE = 0x100
_CODES = 0xD800 - _FIRST_CODE
#: Labels that take as much memory as a short row.
LABELS_OF_A_ROW = 8
#: Pairs compared in one vectorised pass, at most, and numbers such a pass may hold.
_CHUNK = 1024
_NUMBERS = 1 << 23


def _or_blank(acts: Column) -> Column:
    """An empty sequence counts as one blank label."""
    return F.when(F.size(acts) == 0, F.array(F.lit(""))).otherwise(acts)


def _encode(acts: Column, alphabet: Column) -> Column:
    """One character per label: the label's position in ``alphabet``."""

    def character(label: Column) -> Column:
        code = F.hex(F.array_position(alphabet, label) + F.lit(_FIRST_CODE))
        return F.decode(F.unhex(F.lpad(code, 4, "0")), "UTF-16BE")

    return F.array_join(F.transform(acts, character), "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """``1 - distance / longer length``; stays in the JVM."""
    a, b = _or_blank(a), _or_blank(b)

    def similarity(alphabet: Column) -> Column:
        distance = F.levenshtein(_encode(a, alphabet), _encode(b, alphabet))
        too_many = F.raise_error(F.lit("more distinct labels in one pair than character codes")).cast("double")
        return F.when(F.size(alphabet) < _CODES, 1.0 - distance / F.greatest(F.size(a), F.size(b))).otherwise(too_many)

    # Bound to a lambda variable, the alphabet is built once per pair instead of once per label.
    return F.get(F.transform(F.array(F.array_distinct(F.concat(a, b))), similarity), F.lit(0))


def _padded(codes: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(codes), max(map(len, codes))), fill, dtype=np.int32)
    for row, code in zip(out, codes):
        row[: len(code)] = code
    return out


def _damerau_distances(left: list[np.ndarray], right: list[np.ndarray], n_labels: int) -> np.ndarray:
    """Unrestricted Damerau-Levenshtein distance of many pairs, one table cell at a time.

    Of the rows above, a swap needs the one before the last row of each label: one row per label is kept.
    """
    a, b = _padded(left, -1), _padded(right, -2)
    len_a, len_b = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    pairs, (n, m) = np.arange(len(left)), (a.shape[1], b.shape[1])
    far = n + m + 1
    # Column j + 1 is the distance to the first j labels; column 0 is a sentinel.
    above = np.vstack([np.full(len(left), far), np.arange(m + 1)[:, None].repeat(len(left), 1)]).astype(np.int32)
    kept = np.full((n_labels, m + 2, len(left)), far, dtype=np.int32)
    row_of_label = np.zeros((len(left), n_labels), dtype=np.int32)
    out = np.where(len_a == 0, len_b, 0).astype(np.int32)
    for i in range(1, n + 1):
        last_match = np.zeros(len(left), dtype=np.int32)
        row = np.empty_like(above)
        row[0], row[1] = far, i
        for j in range(1, m + 1):
            label = b[:, j - 1]
            seen_row = row_of_label[pairs, label]
            same = a[:, i - 1] == label
            swap = kept[label, last_match, pairs] + (i - seen_row - 1) + 1 + (j - last_match - 1)
            edit = np.minimum(above[j] + ~same, np.minimum(row[j], above[j + 1]) + 1)
            row[j + 1] = np.minimum(edit, swap)
            last_match[same] = j
        kept[a[:, i - 1], :, pairs] = above.T
        row_of_label[pairs, a[:, i - 1]] = i
        done = len_a == i
        out[done] = row[len_b[done] + 1, pairs[done]]
        above = row
    return out


def _damerau_batch(a: pd.Series, b: pd.Series) -> pd.Series:
    left, right = [], []
    for x, y in zip(a, b):  # only equality inside one pair matters, so codes start anew per pair
        labels: dict[str, int] = {}
        left.append(np.array([labels.setdefault(label, len(labels)) for label in x], dtype=np.int32))
        right.append(np.array([labels.setdefault(label, len(labels)) for label in y], dtype=np.int32))
    longest = np.array([max(len(x), len(y)) for x, y in zip(left, right)])
    result = np.zeros(len(left))
    by_size = np.lexsort(([len(y) for y in right], [len(x) for x in left]))
    start = 0
    while start < len(left):
        rows = by_size[start : start + _CHUNK]
        # Two spare labels take the padding codes -1 and -2.
        labels = np.array([max(left[r].max(), right[r].max()) + 3 for r in rows])
        held = np.maximum.accumulate(labels) * np.maximum.accumulate([len(right[r]) + 2 for r in rows]) * np.arange(1, len(rows) + 1)
        rows = rows[: max(1, int(np.searchsorted(held, _NUMBERS, side="right")))]
        found = _damerau_distances([left[r] for r in rows], [right[r] for r in rows], int(labels[: len(rows)].max()))
        result[rows] = 1.0 - found / longest[rows]
        start += len(rows)
    return pd.Series(result)


def damerau_similarity(a: Column, b: Column) -> Column:
    """``1 - distance / longer length`` with unrestricted transpositions (Arrow batches)."""
    return pandas_udf(_damerau_batch, T.DoubleType())(_or_blank(a), _or_blank(b))


def score_pairs(lines: DataFrame, guess: str = "suffix_guessed", truth: str = "suffix") -> DataFrame:
    """Adds both similarities to every line, computing each distinct pair once; ``lines`` is a written table, as it is read twice."""
    keyed = lines.withColumn("pair", F.struct(fingerprint(guess).alias("guess"), fingerprint(truth).alias("truth")))
    # Labels count: sequences are sorted here, and files of them are split by their compressed size.
    keyed = dealt(keyed, (F.size(guess) + F.size(truth)) / LABELS_OF_A_ROW + 1, "pair")
    pairs = keyed.groupBy("pair").agg(only_value(guess).alias(guess), only_value(truth).alias(truth))
    scored = pairs.select(
        "pair",
        damerau_similarity(F.col(guess), F.col(truth)).alias("damerau_similarity"),
        levenshtein_similarity(F.col(guess), F.col(truth)).alias("levenshtein_similarity"),
    )
    return keyed.join(never_broadcast(scored), "pair").drop("pair")
