import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest

from tracecast.llm import codes


LONG = (1 << 63) - 1


def brute(rows: list[tuple], settings: codes.CodeSettings) -> list[tuple]:
    """The contract in plain Python, one part and one entry after the other."""
    kept = [(i, v, l) for i, v, l in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(settings.scale * x) for x in v], l) for i, v, l in kept]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // settings.parts)
    kept = [(i, v + [0] * (settings.parts * width - len(v)), l) for i, v, l in kept]
    cut = lambda v, j: v[j * width : (j + 1) * width]
    seeds = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[: settings.entries]
    books = [[cut(v, j) for _, v, _ in seeds] for j in range(settings.parts)]
    gap = lambda p, e: sum((x - y) ** 2 for x, y in zip(p, e))
    near = lambda p, book: min(range(len(book)), key=lambda k: (gap(p, book[k]), k))
    for _ in range(settings.rounds):
        for j, book in enumerate(books):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[near(cut(v, j), book)].append(cut(v, j))
            for k, own in groups.items():
                book[k] = [sum(x) // len(own) for x in zip(*own)]
    out, labels = [], defaultdict(int)
    for i, v, l in kept:
        best = [near(cut(v, j), books[j]) for j in range(settings.parts)]
        error = min(sum(gap(cut(v, j), books[j][k]) for j, k in enumerate(best)), LONG)
        labels[l] += error
        out.append((i, "".join(f"{k:02x}" for k in best), error, l))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, min(labels[l], LONG), sha) for i, c, e, l in out), key=repr)


def vectors(seed: int, n: int, size: int, spread: float) -> list[tuple]:
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(size)] for _ in range(6)]
    rows = [(i * 3 % n, [x + rng.gauss(0, spread) for x in rng.choice(centres)], rng.choice([1, 2, None])) for i in range(n)]
    return rows + [rows[0]] * 40 + [(n + 1, None, 1), (n + 2, [1.0, None], 1), (n + 3, [math.nan] * size, 2), (n + 4, [-math.inf] * size, 2), (None, centres[0], 3)]


FRAME = "vec_id long, embedding array<double>, label int, q string, place long"


def coded(spark, rows, settings):
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], FRAME).repartition(3)
    got = codes.encode(frame, settings).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted(map(tuple, got), key=repr)


@pytest.mark.parametrize("size, spread, scale", [(8, 0.01, 1024), (8, 0.5, 1024), (7, 0.1, 16), (4, 0.0, 1), (12, 0.2, 1 << 24), (8, 0.3, 1 << 40)])
def test_codes_equal_the_plain_version(spark, size, spread, scale):
    settings = codes.CodeSettings(entries=12, rounds=3, scale=scale, block_rows=4, chunk_bytes=2048)
    rows = vectors(size, 150, size, spread)
    assert coded(spark, rows, settings) == brute(rows, settings)


def test_fewer_rows_than_entries_ties_and_ragged_vectors(spark):
    rows = [(1, [0.5, 0.5], None), (1, [0.5], 1), (2, [], 1), (3, [-0.5, 0.25, 1.0, 2.0, 3.0], 1), (None, [0.5, 0.5], None)]
    settings = codes.CodeSettings(rounds=2)
    assert coded(spark, rows, settings) == brute(rows, settings)
    assert coded(spark, [(1, [], 1), (2, [], None)], settings) == brute([(1, [], 1), (2, [], None)], settings)


def test_no_usable_rows(spark):
    assert coded(spark, [(1, None, 1), (2, [math.nan], 1)], codes.CodeSettings()) == []


def test_errors_beyond_a_long_are_the_largest(spark):
    got = coded(spark, [(1, [1e300, 1.0], 1), (2, [-1e300, 2.0], 1), (3, [1e30, 3.0], 1)], codes.CodeSettings(entries=1, rounds=1))
    assert [r[0] for r in got] == [1, 2, 3] and {r[2] for r in got} == {LONG} == {r[3] for r in got}


def test_the_curve_visits_neighbours():
    grid = np.array([(x, y) for x in range(8) for y in range(8)])
    order = np.argsort(codes.hilbert_index(grid, np.zeros(2), np.full(2, 8.0), 6))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_blocks_far_from_all_entries_but_one_have_a_lone_shortlist():
    entries = np.array([[0, 0], [0, 0], [100, 100], [101, 101]])
    short = codes.shortlists(np.array([[0, 0], [90, 90]]), np.array([[5, 5], [110, 110]]), entries, 200)
    assert short.tolist() == [[True, False, False, False], [False, False, True, True]]
