import random

import pytest
from pyspark.sql import functions as F

from tracecast.functions.sequences import fingerprint, only_value
from tracecast.functions.similarity import damerau_similarity, levenshtein_similarity, score_pairs


def brute_damerau(a, b):
    """Unrestricted transpositions, by the textbook recurrence."""
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            best = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            for k in range(i):
                for m in range(j):
                    if a[k] == b[j] and a[i] == b[m]:
                        best = min(best, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
            d[i, j] = best
    return d[len(a) - 1, len(b) - 1]


def brute_levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def scores(spark, pairs):
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a array<string>, b array<string>")
    found = rows.select(
        "i", damerau_similarity(F.col("a"), F.col("b")).alias("d"), levenshtein_similarity(F.col("a"), F.col("b")).alias("l")
    ).collect()
    return {r.i: (r.d, r.l) for r in found}


def test_against_brute_force(spark):
    rng = random.Random(5)
    pairs = [
        ([rng.choice(["x", "yy", "z", "end"]) for _ in range(rng.randint(1, 8))] for _ in range(2)) for _ in range(1200)
    ]
    pairs = [tuple(p) for p in pairs]
    found = scores(spark, pairs)
    for i, (a, b) in enumerate(pairs):
        longest = max(len(a), len(b))
        assert abs(found[i][0] - (1 - brute_damerau(a, b) / longest)) < 1e-12
        assert abs(found[i][1] - (1 - brute_levenshtein(a, b) / longest)) < 1e-12


def test_empty_sequences_and_transpositions(spark):
    found = scores(spark, [([], []), ([], ["a"]), ([], ["a", "b"]), (list("ca"), list("abc")), (["1", "12"], ["12", "1"])])
    assert found[0] == (1.0, 1.0) and found[1] == (0.0, 0.0) and found[2] == (0.0, 0.0)
    assert abs(found[3][0] - (1 - 2 / 3)) < 1e-12 and found[4] == (0.5, 0.0)


def test_many_labels_and_symmetry(spark):
    a, b = [f"act{i}" for i in range(700)], [f"act{i}" for i in range(350, 1000)]
    found = scores(spark, [(a, b), (b, a)])
    assert found[0] == found[1] and 0 <= found[0][0] <= 1


def test_score_pairs_keeps_every_line(spark):
    rows = spark.createDataFrame([(i, ["a"], ["a", "b"]) for i in range(5)], "i int, suffix_guessed array<string>, suffix array<string>")
    assert [r.damerau_similarity for r in score_pairs(rows).collect()] == [0.5] * 5


def test_long_sequences_take_little_memory():
    import tracemalloc

    import pandas as pd

    from tracecast.functions import similarity

    rng = random.Random(1)
    left, right = ([[rng.choice("abcd") for _ in range(150)] for _ in range(400)] for _ in range(2))
    tracemalloc.start()
    similarity._damerau_batch(pd.Series(left), pd.Series(right))
    assert tracemalloc.get_traced_memory()[1] < 60_000_000
    tracemalloc.stop()


def test_fingerprints_tell_sequences_apart(spark):
    rows = [["a", "b"], ["ab"], ["b", "a"], [], ["", "ab"], ["a", "b", ""], ["1", "a"], ["a"]]
    frame = spark.createDataFrame([(r,) for r in rows + rows], "acts array<string>")
    found = frame.groupBy(fingerprint("acts").alias("f")).agg(only_value("acts").alias("acts"))
    assert sorted(r.acts for r in found.collect()) == sorted(rows)
    with pytest.raises(Exception, match="different sequences"):
        frame.groupBy().agg(only_value("acts").alias("acts")).collect()
