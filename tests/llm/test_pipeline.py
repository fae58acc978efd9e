"""The pipeline against brute force, stage by stage, on a small folder."""

import collections
import random

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.test_ngram_join import brute as classes
from tests.llm.test_pii import plain as personal
from tracecast.llm import packing, quality


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    rows = [(i, " ".join(word() for _ in range(rng.randint(20, 120))), "big" if i % 5 else "small") for i in range(150)]
    near = rows[1][1].split()
    near[7] = "other"
    rows += [(200, " ".join(near) if len(near) > 60 else rows[1][1], "small"), (201, rows[2][1], "big"), (202, rows[2][1] + "  ", "big")]
    rows += [(210, rows[4][1] + " mail jo.li@x.org or +49 (30) 1234-5678", "big"), (211, "card 4111 1111 1111 1111 " + rows[6][1][::-1], "small")]
    rows += [(300, "too short", "big"), (301, None, "small"), (302, "", None), (303, "a b c d e " * 20, "big")]
    rows += [(310 + i, " ".join(word() + "$$$" for _ in range(40)), None) for i in range(6)]
    folder = str(tmp_path_factory.mktemp("tables"))
    docs = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 300), 0) for i, _, _ in rows if i % 2 or i > 309]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


def test_stages(spark, folder, tmp_path):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, states = docs.columns, []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        states.append(docs.collect())
        assert i == 4 or docs.columns == columns
    texts = {k: t for k, t, _ in rows}

    kept = sorted(r.doc_id for r in states[0])
    passes = lambda t: (c := quality.count_rules(t or ""))[0] >= 10 and 100 * c[4] <= 20 * c[0]
    assert kept == sorted(k for k, t in texts.items() if passes(t) and not 310 <= k)

    groups = classes([(k, texts[k]) for k in kept])
    alone = sorted(r.doc_id for r in states[1])
    assert alone == [k for k in kept if groups[k][0] == k] and 201 not in alone and 202 not in alone

    for r in states[2]:
        text, out, done = texts[r.doc_id], [], 0
        for start, _, kind, end in personal(text):
            if start >= done:
                out += [text[done:start], f"[{kind.upper()}]"]
            done = max(done, end)
        assert r.text == "".join([*out, text[done:]]) and r.n_chars == len(r.text)
    assert sorted(r.doc_id for r in states[2]) == alone

    uses = collections.Counter(r.doc_id for r in states[3])
    assert sorted(uses) == alone and max(uses.values()) <= 2
    tokens = collections.Counter()
    for r in states[2]:
        tokens[r.source] += len(r.text.split())
    assert all(n == 1 for k, n in uses.items() if next(s for i, _, s in rows if i == k) == max(tokens, key=tokens.get))

    encode, want = packing.Encoder("byte_bpe_50k.tiktoken"), collections.Counter()
    for r in states[3]:
        want[r.doc_id] += len(encode(r.text)) // 4 + 1
    got = collections.Counter()
    for r in states[4]:
        got[r.doc_id] += r.length
    assert got == want
    used = collections.Counter()
    for r in states[4]:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 2048 and len(used) <= np.ceil(sum(want.values()) / 2048) * 1.1 + 1


def test_run_gives_the_rows_of_its_stages(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and {r.doc_id for r in rows} <= {k for k, _, _ in folder[1]}
