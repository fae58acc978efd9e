import hashlib
import random
import zlib

import numpy as np
import pytest

from tracecast.llm import periodic as p
from tracecast.llm.queries import op11_periodic_runs


def brute(words: list, least: int) -> list[tuple[int, int, int]]:
    """All runs by start and period, from every period's stretches of equal words."""
    n, found = len(words), {}
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(least, 3 * q):
                found.setdefault((start, i + q), q)
    return sorted((s, e, q) for (s, e), q in found.items())


def text_of(rng: random.Random, letters: int) -> list[int]:
    out: list[int] = []
    for _ in range(rng.randint(1, 6)):
        unit = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 13, 21, 40]))]
        if rng.random() < 0.3:  # periodic inside its period
            unit = unit[:2] * rng.randint(2, 20) + unit[2:]
        out += (unit * rng.randint(1, 8))[: rng.randint(1, 200)]
        out += [rng.randrange(letters) for _ in range(rng.randint(0, 10))]
    return out


@pytest.mark.parametrize("least", [6, 24])
def test_runs_equal_brute_force(least):
    rng = random.Random(least)
    for k in range(400):
        words = text_of(rng, rng.choice([1, 2, 3, 30]))
        got = list(map(tuple, p.find_runs(np.array(words, np.int64), p.RunSettings(least=least)).tolist()))
        assert got == brute(words, least), (k, words)


def test_nested_periods_and_fibonacci_words():
    a, b = [0], [0, 1]
    for _ in range(12):
        a, b = b, b + a
    for words in (b, (b[:60] + [2]) * 5, ([0] * 50 + [1]) * 7 + [0] * 49, ([0, 1] * 30 + [2]) * 6 + [0, 1] * 29 + [0, 0]):
        assert list(map(tuple, p.find_runs(np.array(words, np.int64)).tolist())) == brute(words, 24)


def test_wavelet_tree_finds_neighbours_in_ranges():
    rng = np.random.default_rng(3)
    for n in (1, 2, 64, 65, 200):
        values = rng.permutation(n)
        tree = p.WaveletTree(values)
        low = rng.integers(0, n + 1, 300)
        high = np.minimum(n, low + rng.integers(0, 20, 300))
        x = rng.integers(0, n + 1, 300)
        after, before = tree.successor(low, high, x), tree.predecessor(low, high, x)
        for a, b, y, s, t in zip(low, high, x, after, before):
            own = values[a:b]
            assert s == min(own[own >= y], default=-1) and t == max(own[own <= y], default=-1)


def expected(doc_id, text) -> tuple:
    words = (text or "").encode().split()
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        period = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % period] for i in range(n)]
    found = brute(words, 24)
    best = min(found, key=lambda r: (-(r[1] - r[0]) / r[2], r[0], r[2]), default=None)
    gone = {i for s, e, q in found for i in range(s + q, e)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    one = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{s},{e - s},{q}\n" for s, e, q in found).encode()
    return (doc_id, len(found), *one, sha(lines), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def corpus() -> list[tuple]:
    rng = random.Random(1)
    gaps = [" ", "\n", "\t\x0b ", "  "]
    rows = [(i, "".join(f"wö{w}{rng.choice(gaps)}" for w in text_of(rng, 20))) for i in range(120)]
    return rows + [(500, None), (501, ""), (502, "   x"), (503, "a " * 3000), (503, "a " * 3000), (None, "b c " * 20), (504, "z" * 100_000), (505, "a\u0085b " * 30)]


def test_query_equals_the_contract(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, runs string, words int, n_words int").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_periodic_runs(spark, str(tmp_path))
    names = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert sorted((tuple(x) for x in got.select(*names).collect()), key=repr) == sorted((expected(*r) for r in rows), key=repr)


def test_no_documents_and_a_very_long_text(spark):
    assert p.runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(1, "a b c " * 200_000), (2, " ".join(map(str, range(200_000))))]
    got = {x.doc_id: x for x in p.runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 600_000, 3)] and got[1].collapsed == "a b c"
    assert got[2].runs == [] and got[2].n_words == 200_000
