"""Held-out accuracy of the trained models, and their edge cases."""

import random
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from tracecast.llm import langid, queries, toxicity

FOLDER = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")


@tables
def test_held_out_languages(spark):
    rows = queries.queries()["op8_language_id"](spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == r.lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice(a) for _ in range(5)) for _ in range(30)), lang) for i in range(40) for a, lang in (("abcde", "xx"), ("vwxyz", "yy"))]
    rows += [(100, None, "xx"), (101, "", "yy"), (102, "12 ## !", "xx"), (103, "abcab dedede", None), (104, "Ω", None), (104, "Ω", None)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, counts int, n int")
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [by[k].lang_pred for k in (100, 101, 102)] == ["und"] * 3 and by[100].score == 0
    assert by[103].lang_pred == "xx" and by[104].lang_pred in ("xx", "yy") and by[104].rejected
    nothing = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}
    assert langid.predict(docs.limit(0), nothing).collect() == []


@tables
def test_held_out_toxicity(spark):
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    rows = queries.queries()["op9_toxicity"](spark, FOLDER).join(labels, "doc_id").where("toxic is not null").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out]
    scores = {c: np.array([r.score for r in held if r.toxic == c]) for c in (0, 1)}
    assert (scores[1][:, None] > scores[0][None, :]).mean() > 0.8
    assert np.mean([r.predicted == r.toxic for r in held]) > 0.9


def test_toxicity_edge_cases(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(i, " ".join(word() for _ in range(20)) + (" Grumble!" if i % 3 == 0 else "")) for i in range(200)]
    rows += [(500, None), (501, ""), (502, "GRUMBLE"), (502, "GRUMBLE")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, toxic int, draw string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(150)] + [(3, 0), (4, None)], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(150, 200))
    assert got[502] > 0.5 and 0 <= got[500] == got[501] < 0.5
    one_class = toxicity.fit(docs, labels.where("toxic = 1"))
    assert all(r.score > 0.5 for r in toxicity.score(docs, one_class).collect())
    none = toxicity.fit(docs, labels.limit(0))
    assert all(r.score < 0.01 for r in toxicity.score(docs, none).collect())
    assert toxicity.score(docs.limit(0), none).collect() == []


def test_weights_are_those_of_a_plain_ftrl():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(60)]
    labels = np.array([float(3 in r) for r in rows])
    s = toxicity.ToxicitySettings(epochs=2, l1=0.3, alpha=0.4, l2=0.2, min_rows=1)
    names, w, bias = toxicity.ftrl(labels, rows, s)
    z, n = dict.fromkeys([*range(12), "bias"], 0.0), dict.fromkeys([*range(12), "bias"], 0.0)

    def weight(k):
        l1 = 0.0 if k == "bias" else s.l1
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - np.sign(z[k]) * l1) / ((s.beta + n[k] ** 0.5) / s.alpha + s.l2)

    order = np.random.default_rng(s.seed)
    for _ in range(2):
        for i in order.permutation(60):
            own = [*rows[i].tolist(), "bias"]
            w_own = {k: weight(k) for k in own}
            g = 1 / (1 + np.exp(-sum(w_own.values()))) - labels[i]
            for k in own:
                sigma = ((n[k] + g * g) ** 0.5 - n[k] ** 0.5) / s.alpha
                z[k] += g - sigma * w_own[k]
                n[k] += g * g
    assert np.isclose(bias, weight("bias"))
    assert dict(zip(names.tolist(), np.round(w, 9).tolist())) == {k: round(weight(k), 9) for k in range(12) if weight(k)}


def test_features_are_words_pairs_and_skipped_pairs():
    a, b, c = toxicity.word_features(pa.array(["one two three", "three", ""]))
    assert len(a) == 3 + 2 + 1 and len(b) == 1 and len(c) == 0 and set(b) < set(a)
