import collections
import random
import re

import numpy as np
import pytest

from tracecast.llm import ngram_join as n
from tracecast.llm.components import components


def shingles(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """Class, links and copies by comparing all pairs."""
    parent = {k: k for k, _ in rows}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    sets = {k: shingles(t) for k, t in rows}
    links = collections.defaultdict(set)
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
                if sets[a] != sets[b]:
                    links[a].add(sets[b])
                    links[b].add(sets[a])
    return {k: (root(k), len(links[k]), sum(sets[j] == sets[k] for j in sets) if sets[k] else 1) for k in sets}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(40, 90))] for _ in range(6)]
    rows = []
    for i in range(90):
        words = list(base[min(5, int(rng.random() ** 3 * 6))])
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words)))
    return rows + [(100, None), (101, ""), (102, "two words"), (103, "two  words"), (104, "a b c d e"), (105, " \n\t")]


@pytest.mark.parametrize("rows", [2, 4096])
def test_classes_and_links_are_those_of_all_pairs(spark, rows):
    docs = corpus(rows)
    table = spark.createDataFrame([(*d, 1, "x") for d in [*docs, docs[0]]], "doc_id long, text string, size int, label string")
    got = n.join(table, n.JoinSettings(bucket_rows=rows, block_rows=min(rows, 256)))
    assert {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in got.collect()} == brute(docs)
    kept = n.one_of_each(table)
    assert kept.columns == table.columns
    want = brute(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in want if want[k][0] == k)


def test_no_documents_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert n.join(empty).collect() == [] == n.one_of_each(empty).collect()
    lone = spark.createDataFrame([(None, "a b c d e f g"), (1, "h i j k l m")], "doc_id long, text string")
    assert n.one_of_each(lone).count() == 2


def test_bands_reach_the_recall():
    s = n.JoinSettings()
    count, rows = s.bands()
    assert 1 - (1 - s.threshold**rows) ** count >= s.recall and count * rows <= s.max_hashes


def test_reaching_rows_one_by_one_is_the_same_as_comparing_all():
    rng = np.random.default_rng(0)
    for _ in range(100):
        sign = rng.integers(0, 3, (rng.integers(1, 40), 6)).astype(np.uint32)
        a, b = np.nonzero((sign[:, None] == sign[None]).mean(2) >= 0.6)
        assert (n._reached(sign, 0.6) == n._smallest_connected(len(sign), a, b)).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (32, 31), (40, 40)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(21)}, 30: 30, 31: 30, 32: 30}
