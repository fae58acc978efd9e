import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracecast.llm import quality as q


def plain(text):
    words = re.split(r"[\x20\x09-\x0D]+", text)
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    counts, inside = Counter(grams), set()
    for i, g in enumerate(grams):
        if counts[g] > 1:
            inside |= set(range(i, i + 5))
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), len(lines), len(set(words))


@given(st.text(alphabet="ab#é \n\t\x0b\x1c\xa0", max_size=120))
@settings(max_examples=600, deadline=None)
def test_statistics_are_those_of_the_definition(text):
    assert q.count_rules(text) == plain(text)


def good(rng):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(60)) + "."


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(1)
    rows = [(i, good(rng)) for i in range(120)]
    rows += [(1000 + i, " ".join(w + "###" for w in good(rng).split())) for i in range(12)]
    rows += [(2000, None), (2001, ""), (2002, "too short"), (2003, "one two three four five " * 6), (5, rows[5][1])]
    docs = spark.createDataFrame([(*r, 3, "x") for r in rows], "doc_id long, text string, n_words int, score string")
    labels = [(i, int(i < 1000)) for i, _ in rows[:90] + rows[120:126]] + [(7, None), (8, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int")


def test_unusual_documents_and_failing_ones_go(tables):
    judged = {r.doc_id: r for r in q.judge(*tables).collect()}
    assert all(judged[i].kept for i in range(120))
    assert not any(judged[i].kept for i in (*range(1000, 1012), 2000, 2001, 2002, 2003))
    assert [judged[i].base_failed for i in (1000, 2000, 2001, 2002, 2003)] == [False, True, True, True, True]
    kept = q.filtered(*tables)
    assert kept.columns == tables[0].columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted([*range(120), 5])


def test_without_labels_the_rules_decide(spark, tables):
    none = spark.createDataFrame([], "doc_id long, quality int")
    judged = q.judge(tables[0], none).collect()
    assert all(r.kept != r.base_failed and r.score is None for r in judged)
    assert q.judge(tables[0].limit(0), none).collect() == []


def test_path_lengths_against_a_walk():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 8))
    forest = q.grow(x, q.QualityRules(trees=5, tree_rows=32))

    def walk(tree, row, node=0):
        f = forest.feature[tree, node]
        return forest.length[tree, node] if f < 0 else walk(tree, row, 2 * node + 1 + int(row[f] >= forest.split[tree, node]))

    want = [2 ** (-np.mean([walk(t, row) for t in range(5)]) / forest.norm) for row in x]
    assert np.allclose(forest.scores(x), want)


def test_long_clean_texts_stay_and_unusual_ones_inside_the_old_ranges_go(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(60_000)]
    share = 1 / np.arange(3, len(words) + 3) ** 1.1  # a vocabulary that grows as that of natural language
    clean = lambda n: " ".join(words[i] for i in rng.choice(len(words), n, p=share / share.sum()))
    rows = [(i, clean(int(rng.integers(60, 400)))) for i in range(300)]
    rows += [(1000 + k, clean(n)) for k, n in enumerate((100_000, 400_000))]
    rows += [(2000, " ".join(w.ljust(9, "k") for w in rows[0][1].split())), (2001, " ".join(f"{w};" for w in rows[1][1].split()))]
    rows += [(2002, " ".join(w.title() if k % 2 else w for k, w in enumerate(rows[2][1].split())))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    judged = {r.doc_id: r for r in q.judge(docs, spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")).collect()}
    assert [judged[i].kept for i in (1000, 1001)] == [True, True]
    assert [judged[i].kept for i in (2000, 2001, 2002)] == [False] * 3
    assert [judged[i].base_failed for i in (2000, 2001, 2002)] == [False] * 3
    assert sum(judged[i].kept for i in range(300)) >= 299
