import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracecast.llm import classes as c
from tracecast.llm.queries import op12_class_bigrams

FRAME = "doc_id long, text string, train int, word string, block long"


def sentences(seed: int, n: int) -> list[tuple]:
    """Nouns, verbs and an ending take turns in one half of the texts, other words in the other half."""
    rng = random.Random(seed)
    nouns, verbs, others = ([f"{stem}{i}{rng.choice('abc')}" for i in range(30)] for stem in ("N", "ver", "öth"))
    rows = []
    for i in range(n):
        words = [rng.choice(others) for _ in range(rng.randint(3, 30))] if i % 2 else [w for _ in range(rng.randint(1, 12)) for w in (rng.choice(nouns), rng.choice(verbs), "end")]
        rows.append((i, rng.choice([" ", "\n "]).join(words)))
    return rows + [(900, None), (901, ""), (902, "never Seen\x0bWORDS ver1a"), (903, rows[0][1]), (903, rows[0][1]), (None, "ver1b end"), (904, "a\u0085b É"), (905, "x " * 40_000)]


def held_out(doc_id) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def tokens_of(text) -> list[str]:
    return [w.decode() for w in (text or "").encode().lower().split()] + [""]


def counts_of(rows) -> Counter:
    return Counter(w for i, t in rows if not held_out(i) for w in tokens_of(t))


def base(rows) -> dict:
    counts = counts_of(rows)
    total, words = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = tokens_of(t)
        score = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (words + 1))) for w in tokens)
        out.append((i, held_out(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, score))
    return out


def plain_scores(rows, word_class: dict, s: c.ClassSettings) -> list[float]:
    """The model written out, from the classes of the words."""
    counts, pairs, after = counts_of(rows), Counter(), Counter()
    for i, t in rows:
        if not held_out(i):
            of = [0] + [word_class[w] for w in tokens_of(t)]
            pairs.update(zip(of, of[1:]))
    for (a, _), n in pairs.items():
        after[a] += n
    total, words = sum(counts.values()), len(counts)
    mass, size = Counter(), Counter()
    for w, n in counts.items():
        mass[word_class[w]] += n
        size[word_class[w]] += 1
    d, m = s.smoothing, s.prior
    out = []
    for _, t in rows:
        score, before = 0.0, 0
        for w in tokens_of(t):
            k = word_class.get(w)
            unigram = ((mass[k] + d * size[k]) if k is not None else d) / (total + d * (words + 1))
            within = (counts[w] + d) / (mass[k] + d * size[k]) if k is not None else 1
            score += math.log10((pairs[before, k] + m * unigram) / (after[before] + m) * within)
            before = k
        out.append(score)
    return out


def key(row):
    return repr(row[:5]), round(row[5], 3)


@pytest.mark.parametrize("block_bytes", [500, 1 << 24])
def test_scores_equal_the_plain_version(spark, block_bytes):
    rows = sentences(block_bytes, 150)
    settings = c.ClassSettings(classes=8, rounds=3, block_bytes=block_bytes, group=4)
    docs = spark.createDataFrame([(*r, 0, "x", 7) for r in rows], FRAME).repartition(3)
    train = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True))
    model = c.fit(docs, train, settings)
    word_class = {r.word: r["class"] for r in c.word_classes(model).collect()}
    assert {r.word: r.n for r in c.word_classes(model).collect()} == counts_of(rows)
    assert word_class[""] == 0 and min(v for w, v in word_class.items() if w) > 0
    want = sorted(((*b[:4], 0, b[5], p) for b, p in zip(base(rows), plain_scores(rows, word_class, settings))), key=key)
    got = sorted(((r.doc_id, not r.train, r.n_tokens, r.n_known, 0, r.base_score, r.score) for r in c.score(model).collect()), key=key)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want])


def test_exchange_raises_the_likelihood_and_beats_the_base(spark):
    rows = sentences(5, 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = c.fit(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 != 0, F.lit(True)), c.ClassSettings(classes=6, rounds=4, group=8))
    assert max(model.likelihoods) > model.likelihoods[0]
    scored = c.score(model).where("not train").agg(F.sum("base_score"), F.sum("score")).first()
    assert scored[1] > scored[0] + 0.1 * abs(scored[0])


def test_probabilities_sum_to_one(spark):
    rows = sentences(2, 40)
    model = c.fit(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(True), c.ClassSettings(classes=5, rounds=1))
    given, unigram, within = (10.0**x for x in model.logarithms())
    words = c.word_classes(model).toPandas()
    in_class = np.bincount(words["class"], (words.n + 0.1) / within[words["class"]], 6)
    used = model.sizes > 0
    assert np.allclose(given.sum(1), 1) and np.allclose(unigram.sum(), 1) and np.allclose(in_class[:5][used], 1)


def test_a_word_goes_where_its_neighbours_are_known():
    bigrams = np.array([[0, 9, 0, 0], [0, 0, 90, 9], [9, 90, 0, 0], [0, 9, 9, 0]])
    like_two = np.array([[0, 5.0, 0, 0, 0, 5.0, 0, 0]])  # after and before class 1
    assert c.exchanged(like_two, np.array([3]), bigrams.astype(float)).tolist() == [2]


def test_a_word_of_many_blocks_and_batches_is_one(spark):
    settings = c.ClassSettings(classes=4, rounds=1, block_bytes=50)
    rows = [(i, f"the only words {i}") for i in range(3000)]
    model = c.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), F.lit(True), settings)
    n = {r.word: r.n for r in c.word_classes(model).where("n > 1").collect()}
    assert n == {"": 3000, "the": 3000, "only": 3000, "words": 3000}


def test_query_on_documents_nothing_to_learn_from_and_no_documents(spark, tmp_path):
    rows = sentences(1, 60)
    spark.createDataFrame([(*r, 0, "x", 7) for r in rows], FRAME).write.parquet(f"{tmp_path}/documents.parquet")
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    got = sorted((tuple(r) for r in op12_class_bigrams(spark, str(tmp_path)).select(*names).collect()), key=key)
    want = sorted(base(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want] and np.allclose([g[5] for g in got], [w[5] for w in want])
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lone = c.score(c.fit(docs, F.lit(None).cast("boolean"))).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in lone} == {(1, 3, 0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0)}
    assert c.score(c.fit(docs.limit(0), F.lit(True))).collect() == []
